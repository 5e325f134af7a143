import pytest

from vecfactor.sources import payloads as P

PARAMS = ', "rank": 3, "iterations": 5, "lambda": 0.1'


def _parse(spark, payloads):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "upload_id string, payload string")
    parsed = P.parse_uploads(df)
    rows = {r["upload_id"]: r for r in parsed.collect()}
    flat = {}
    for r in P.flatten_ratings(parsed).collect():
        flat.setdefault(r["upload_id"], {})[(r["user"], r["item"])] = r["rating"]
    return [rows[str(i)] for i in range(len(payloads))], [flat.get(str(i), {}) for i in range(len(payloads))]


def test_reasons(spark):
    rows, _ = _parse(spark, [
        '{"ratings":{}}',
        '{oops',
        '[1, 2]',
        '{"ratings": {"1": {"x": 1}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": null}}' + PARAMS + '}',
        '{"ratings": {}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 3}}, "rank": "three", "iterations": 5, "lambda": 0.1}',
        '{"ratings": {"1": {"2": "nan"}}' + PARAMS + '}',
        '{"ratings": {"5000000000": {"2": 1}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 3}}, "rank": 0, "iterations": 5, "lambda": 0.1}',
        '{"ratings": {"1": {"2": 3}}, "rank": 2, "iterations": 5, "lambda": -1}',
        '{"ratings": {"1": 5}' + PARAMS + '}',
        '{"ratings": "abc"' + PARAMS + '}',
    ])
    reasons = [r["reason"] for r in rows]
    assert reasons == [
        "Missing fields ['rank', 'iterations', 'lambda']",
        "Invalid json", "Invalid json",
        "Rating data invalid", "Rating data invalid",
        "Empty ratings",
        "Invalid data types",
        "Rating data invalid", "Rating data invalid",
        "Invalid parameters", "Invalid parameters",
        "Rating data invalid", "Rating data invalid",
    ]
    assert all(r["n_ratings"] == 0 for r in rows)


def test_quoted_numbers_and_truncation(spark):
    rows, flat = _parse(spark, [
        '{"ratings": {"1": {"2": "4.5"}}, "rank": "3", "iterations": 2.9, "lambda": "0.5"}',
    ])
    assert rows[0]["reason"] is None
    assert (rows[0]["rank"], rows[0]["iterations"], rows[0]["reg"]) == (3, 2, 0.5)
    assert flat[0] == {(1, 2): 4.5}


def test_last_value_wins(spark):
    rows, flat = _parse(spark, [
        '{"ratings": {"1": {"2": 3, "2": 4}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 3}, "01": {"5": 1}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": "x", "2": 4}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 3, "02": 5, "2": 4}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 1}}, "ratings": {"7": {"8": 2}}' + PARAMS + '}',
        '{"ratings": {"1": {"2": 1}, "3": {}}' + PARAMS + '}',
    ])
    assert all(r["reason"] is None for r in rows)
    assert flat[0] == {(1, 2): 4.0}
    assert flat[1] == {(1, 5): 1.0}          # the later user block replaces the earlier whole
    assert flat[2] == {(1, 2): 4.0}          # an overwritten bad value does no harm
    assert flat[3] == {(1, 2): 5.0}          # dict order: "2" (first seen) then "02"
    assert flat[4] == {(7, 8): 2.0}          # repeated top-level key: last wins
    assert flat[5] == {(1, 2): 1.0}          # a user without items is fine


def test_word_lists(spark):
    df = spark.createDataFrame([(1, '["a", "b", null]'), (2, '{oops'), (3, '"abc"'), (4, '[1, "x"]')],
                               "list_id long, payload string")
    got = {r["list_id"]: (r["words"], r["reason"]) for r in P.parse_word_lists(df).collect()}
    assert got[1] == (["a", "b"], None)
    assert got[2][1] == "Invalid json" and got[3][1] == "Invalid json"
    assert got[4] == (["1", "x"], None)


@pytest.mark.parametrize("n_users", [1, 40])
def test_flatten_roundtrip(spark, n_users):
    import json
    data = {str(u): {str(i): float(u * 10 + i) for i in range(5)} for u in range(n_users)}
    payload = json.dumps({"ratings": data, "rank": 2, "iterations": 1, "lambda": 0.1})
    _, flat = _parse(spark, [payload])
    assert flat[0] == {(int(u), int(i)): v for u, items in data.items() for i, v in items.items()}
