"""Uploads against Python's own JSON-object semantics (the service loads the
body with ``json.loads`` and casts keys and values with ``int``/``float``)."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from vecfactor.sources import payloads as P

KEYS = st.sampled_from(["1", "01", "2", " 2", "+3", "3", "10", "x", "1.5"])
VALUES = st.one_of(st.integers(-5, 5).map(str), st.sampled_from(['"4.5"', '2.25', '"7"', '"bad"', 'null', '1e2']))


def _obj(pairs):
    return "{" + ", ".join(f'"{k}": {v}' for k, v in pairs) + "}"


users = st.lists(st.tuples(KEYS, st.lists(st.tuples(KEYS, VALUES), max_size=4)), max_size=4)


def expected(payload):
    """``(ok, {(user, item): rating})`` the way the service reads a body."""
    obj = json.loads(payload)
    out = {}
    try:
        for user, items in obj["ratings"].items():
            row = {}
            for item, value in items.items():
                row[int(item)] = float(value)
            out[int(user)] = row
    except (TypeError, ValueError):
        return False, {}
    flat = {(u, i): r for u, row in out.items() for i, r in row.items()}
    return True, flat


@settings(max_examples=25, deadline=None)
@given(st.lists(users, min_size=1, max_size=6))
def test_matches_python_semantics(spark, batch):
    payloads = [_obj([("ratings", _obj([(u, _obj(items)) for u, items in us])), ("rank", "2"),
                      ("iterations", "1"), ("lambda", "0.1")]) for us in batch]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "upload_id string, payload string")
    parsed = P.parse_uploads(df)
    reasons = {r["upload_id"]: r["reason"] for r in parsed.select("upload_id", "reason").collect()}
    got = {}
    for r in P.flatten_ratings(parsed).collect():
        got.setdefault(r["upload_id"], {})[(r["user"], r["item"])] = r["rating"]
    for i, p in enumerate(payloads):
        ok, flat = expected(p)
        reason = reasons[str(i)]
        if not ok:
            assert reason == "Rating data invalid", (p, reason)
        elif not flat:
            assert reason == "Empty ratings", (p, reason)
        else:
            assert reason is None, (p, reason)
            assert got.get(str(i), {}) == flat, p
