import glob
import json
import os
import time

from pyspark.sql import functions as F

from vecfactor.sources.payloads import parse_uploads, parse_word_requests
from vecfactor.sources.store import ModelStore, train_and_store
from vecfactor.streaming import feeds

BODY = '{"ratings": {"1": {"1": 5, "2": 1}, "2": {"1": 4}}, "rank": 2, "iterations": 2, "lambda": 0.1}'


def _vocab(spark):
    rows = [("x", 0, [1.0, 0.0]), ("yy", 1, [0.0, 3.0])]
    return spark.createDataFrame(rows, "word string, word_idx long, vec array<float>")


def _post(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write("".join(x + "\n" for x in lines))


def test_center_feed_restart_and_new_files(spark, tmpdir_shared):
    base = tmpdir_shared
    _post(f"{base}/in", "a.txt", ['{"list_id": 1, "words": ["x", "yy"]}', '{"list_id": 2, "payload": "[\\"x\\"]"}'])
    run = lambda: feeds.center_feed(spark, f"{base}/in", _vocab(spark), f"{base}/out", f"{base}/ckpt")
    q = run()
    q.awaitTermination()
    out = f"{base}/out/centers"
    first = {r["list_id"]: r["n_known"] for r in feeds.read_output(spark, out).collect()}
    assert first == {1: 2, 2: 1}
    # a restart on the same checkpoint processes nothing twice
    q = run()
    q.awaitTermination()
    assert feeds.read_output(spark, out).count() == 2
    # a new file is picked up as a new batch; what is no word list is rejected with its reason
    bad = ['{"list_id": 4, "payload": "[\\"x\\""}', '{"list_id": 5, "payload": "{\\"a\\": 1}"}', '{"list_id": 6',
           '{"payload": "[]"}', "[1]", '{"list_id": 7}']
    _post(f"{base}/in", "b.txt", ['{"list_id": 3, "words": ["yy", "zz"]}', *bad])
    q = run()
    q.awaitTermination()
    got = {r["list_id"]: (r["n_words"], r["n_known"]) for r in feeds.read_output(spark, out).collect()}
    assert got == {1: (2, 2), 2: (1, 1), 3: (2, 1)}
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) == 2
    rej = {r["request"]: (r["list_id"], r["reason"]) for r in feeds.read_output(spark, f"{base}/out/rejected").collect()}
    assert set(rej) == set(bad)
    assert rej[bad[0]] == (4, "Invalid json") and rej[bad[1]] == (5, "Invalid json")
    assert rej[bad[2]] == (None, "Invalid json") and rej[bad[3]] == (None, "Missing list id")
    assert rej[bad[5]] == (7, "Invalid json")


def test_word_requests(spark):
    lines = ['{"list_id": "12", "words": ["a", null, "b"]}', '{"list_id": 1, "payload": "[]"}', "", None]
    got = parse_word_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["list_id"], r["words"], r["reason"]) for r in got[:2]] == [(12, ["a", "b"], None), (1, [], None)]
    assert [r["reason"] for r in got[2:]] == ["Invalid json"] * 2


def _uploads(path, name, rows):
    _post(path, name, [json.dumps({"upload_id": u, "model_name": m, "payload": p}) for u, m, p in rows])


def test_the_later_upload_wins_by_arrival(spark, tmpdir_shared):
    base = tmpdir_shared
    other = BODY.replace('"2": 1}', '"7": 1}')
    _uploads(f"{base}/in", "1.json", [("u9", "m", BODY)])
    time.sleep(0.05)
    _uploads(f"{base}/in", "0.json", [("u10", "m", other)])            # later, but less as a text
    st = ModelStore(spark, f"{base}/store")
    feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", store=st).awaitTermination()
    assert [(r["upload_id"], r["version"]) for r in st.latest().collect()] == [("u10", 1)]
    assert {r["id"] for r in st.features(["m"]).where("kind = 'item'").collect()} == {1, 7}


def test_a_replayed_batch_changes_nothing(spark, tmpdir_shared):
    base = tmpdir_shared
    _uploads(f"{base}/in", "1.json", [("a", "m", BODY), ("b", None, BODY), ("c", None, "{oops")])
    st = ModelStore(spark, f"{base}/store")
    for k in range(2):      # the second start has lost its progress: batch 0 comes again
        feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt{k}", store=st, feed_id="f").awaitTermination()
        now = sorted((r["upload_id"], r["model_name"], r["version"]) for r in st.latest().collect())
        assert k == 0 or now == first
        first = now
    assert [x[0] for x in first] == ["a", "b"] and all(x[2] == 1 for x in first)
    assert st.commits().count() == 1 and len(os.listdir(f"{base}/store/factors")) < 4


def test_many_files_come_in_bounded_batches(spark, tmpdir_shared):
    base = tmpdir_shared
    for i in range(3):
        _uploads(f"{base}/in", f"{i}.json", [(f"u{i}", "m", BODY)])
    st = ModelStore(spark, f"{base}/store")
    feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", store=st,
                      max_files_per_trigger=2).awaitTermination()
    assert st.latest().first()["version"] == 2 and st.commits().count() == 2


def test_equal_uploads_are_one(spark, tmpdir_shared):
    st = ModelStore(spark, tmpdir_shared + "/s")
    rows = [("a", "m", BODY), ("a", "m", BODY), (None, "n", BODY), (None, "n", BODY)]
    ups = spark.createDataFrame(rows, "upload_id string, model_name string, payload string")
    train_and_store(st, parse_uploads(ups).checkpoint())
    assert sorted((r["model_name"], r["n_ratings"]) for r in st.latest().collect()) == [("m", 3), ("n", 3)]
    assert st.features(["n"]).count() == 4


def test_two_writers_never_share_a_version(spark, tmpdir_shared):
    """While a writer derives its versions another one commits: it must try again."""
    st, other = (ModelStore(spark, tmpdir_shared + "/s") for _ in range(2))

    def model(x):
        f = spark.createDataFrame([("m", "user", 1, [x])], "model_name string, kind string, id int, features array<float>")
        return f, spark.createDataFrame([("m", 1, 1, 0.1, 1)], "model_name string, rank int, iterations int, reg double, "
                                        "n_ratings long")
    plain, calls = st._with_versions, []

    def slow(names):
        rows = plain(names).checkpoint(eager=True)      # versions are read ...
        if not calls:
            calls.append(1)
            other.save(*model(2.0))                     # ... and the other writer is faster
        return rows
    st._with_versions = slow
    mine = st.save(*model(1.0)).collect()
    assert [r["version"] for r in mine] == [2] and calls
    assert st.index().groupBy("model_name", "version").count().where("count > 1").isEmpty()
    assert [r["features"] for r in st.features(["m"]).collect()] == [[1.0]]
    assert st.commits().agg(F.max("seq")).first()[0] == 2


def _tables(spark, base, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{base}/t/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>") \
        .write.parquet(f"{base}/t/embeddings.parquet")
    return f"{base}/t"


def test_posted_lists_come_in_files_of_bounded_size(spark, tmpdir_shared, monkeypatch):
    """four files whatever the input made every task read a quarter of it."""
    from vecfactor.plans import catalog
    docs = [(i, f"word{i % 7} other{i % 5} " * 10) for i in range(200)] + [(202, None), (203, "")]
    d = _tables(spark, tmpdir_shared, docs)
    monkeypatch.setattr(feeds, "FILE_BYTES", 2_000)
    out = catalog._center_feed(spark, d)
    sizes = [os.path.getsize(f) for f in glob.glob(out.removeprefix("file:").rsplit("/", 1)[0] + "/in/part-*")]
    assert len(sizes) > 10 and max(sizes) < 3 * 2_000
    cen = feeds.read_output(spark, f"{out}/centers")
    assert cen.count() == len(docs) - 1 and cen.where("n_known > 0").count() == 200
    assert len(glob.glob(out.removeprefix("file:") + "/centers/batch_id=*")) == 2
    assert feeds.read_output(spark, f"{out}/rejected").count() == 21 + 2 + 1     # a null text is no list


def test_uploads_are_derived_once_for_all_posts(spark, tmpdir_shared, monkeypatch):
    """every post aggregated the events again and came in two files whatever its size."""
    from vecfactor.plans import catalog
    rows = [(i, i % 40, '{"k": %d}' % (i % 149), float(i % 9), "view") for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, props string, value double, event_type string")
    ev.withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.parquet(f"{tmpdir_shared}/t/events.parquet")
    plans, stage = [], feeds.stage_files

    def staged(df, path, n_files):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), n_files))
        stage(df, path, n_files=n_files)
    monkeypatch.setattr(feeds, "stage_files", staged)
    monkeypatch.setattr(feeds, "FILE_BYTES", 5_000)
    catalog._stage_uploads(spark, f"{tmpdir_shared}/t", f"{tmpdir_shared}/in", nameless=True)
    assert len(plans) == 3 and all("Aggregate" not in p and n > 2 for p, n in plans)
    got = spark.read.schema(feeds.UPLOAD_SCHEMA).json(f"{tmpdir_shared}/in")
    want = catalog.FX.rating_uploads(spark, f"{tmpdir_shared}/t")
    assert sorted((r[0], r[1]) for r in got.select("upload_id", "payload").collect()) == \
        sorted((r[0], r[1]) for r in want.select("upload_id", "payload").collect())
    assert {r[0] for r in got.select("model_name").distinct().collect()} == {None} | {f"m{u}" for u in range(0, 40, 2)}
