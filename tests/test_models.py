import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfactor.functions.names import NAME_ALPHABET, NAME_LENGTH, generate_name, generated_names, valid_name
from vecfactor.operators import factors as MF
from vecfactor.sources.store import InvalidModelName, ModelStore


def _planted(spark, n_users=40, n_items=30, rank=3, seed=0):
    rng = np.random.default_rng(seed)
    U, V = rng.normal(size=(n_users, rank)), rng.normal(size=(n_items, rank))
    R = U @ V.T
    rows = [(u, i, float(R[u, i])) for u in range(n_users) for i in range(n_items)]
    return spark.createDataFrame(rows, "user int, item int, rating double")


def test_als_recovers_planted_matrix(spark):
    r = _planted(spark)
    model = MF.train(r, rank=3, iterations=15, reg=0.001, num_blocks=2)
    m = MF.mse(MF.score_pairs(r, MF.user_factors(model), MF.item_factors(model))).first()
    assert m["n"] == 40 * 30 and m["n_unknown"] == 0
    assert m["mse"] < 1e-2
    assert MF.user_factors(model).count() == 40
    assert set(len(r["features"]) for r in MF.item_factors(model).collect()) == {3}


def test_score_unknown_ids(spark):
    uf = spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<float>")
    itf = spark.createDataFrame([(7, [3.0, 4.0])], "id int, features array<float>")
    pairs = spark.createDataFrame([(1, 7, 12.0), (2, 7, 1.0), (1, 8, 1.0)], "user int, item int, rating double")
    m = MF.mse(MF.score_pairs(pairs, uf, itf)).first()
    assert (m["n"], m["n_unknown"]) == (1, 2) and m["mse"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        MF.mse(MF.score_pairs(pairs, uf, itf), strict=True)
    empty = MF.mse(MF.score_pairs(pairs.where("user = 99"), uf, itf)).first()
    assert empty["n"] == 0 and empty["mse"] is None


def _factors(spark, name, scale):
    f = spark.createDataFrame([(name, "user", 1, [scale, 0.0]), (name, "item", 2, [1.0, 1.0])],
                              "model_name string, kind string, id int, features array<float>")
    meta = spark.createDataFrame([(name, 2, 5, 0.1, 1)],
                                 "model_name string, rank int, iterations int, reg double, n_ratings long")
    return f, meta


def test_store_lifecycle(spark, tmpdir_shared):
    st = ModelStore(spark, tmpdir_shared + "/store")
    assert st.latest().count() == 0
    f, m = _factors(spark, "alpha", 1.0)
    assert [r["version"] for r in st.save(f, m).collect()] == [1]
    f, m = _factors(spark, "alpha", 2.0)
    assert [r["version"] for r in st.save(f, m).collect()] == [2]
    feats = {(r["kind"], r["id"]): r["features"] for r in st.features(["alpha"]).collect()}
    assert feats[("user", 1)] == [2.0, 0.0]                 # latest version only
    pairs = spark.createDataFrame([("alpha", 1, 2, 3.0), ("alpha", 5, 2, 1.0)],
                                  "model_name string, user int, item int, rating double")
    ev = st.evaluate(pairs).first()
    assert (ev["n"], ev["n_unknown"], ev["mse"]) == (1, 1, pytest.approx(1.0))
    assert st.latest_evaluations().count() == 1
    names = spark.createDataFrame([("alpha",), ("beta",)], "model_name string")
    got = {r["model_name"]: r["deleted"] for r in st.delete(names).collect()}
    assert got == {"alpha": True, "beta": False}
    assert st.latest().count() == 0
    assert {r["model_name"]: r["deleted"] for r in st.delete(names).collect()}["alpha"] is False
    docs = st.features_json().count()
    assert docs == 0


def test_store_refuses_bad_names(spark, tmpdir_shared):
    st = ModelStore(spark, tmpdir_shared + "/store2")
    for bad in ["", "..", "a/b"]:
        f, m = _factors(spark, bad, 1.0)
        with pytest.raises(InvalidModelName):
            st.save(f, m)
    with pytest.raises(InvalidModelName):
        st.features(["../x"])


def test_names(spark):
    n = generate_name()
    assert len(n) == NAME_LENGTH and set(n) <= set(NAME_ALPHABET)
    df = spark.createDataFrame([("ok_name-1",), ("a/b",), ("",), ("..",)], "n string")
    assert [r["v"] for r in df.select(valid_name("n").alias("v")).collect()] == [True, False, False, False]
    g = spark.range(5).select(generated_names("id").alias("g")).collect()
    assert all(len(r["g"]) == NAME_LENGTH and set(r["g"]) <= set(NAME_ALPHABET) for r in g)
    assert len({r["g"] for r in g}) == 5
    assert F is not None


def test_failed_save_leaves_no_trace(spark, tmpdir_shared):
    st = ModelStore(spark, tmpdir_shared + "/store3")
    f, m = _factors(spark, "gamma", 1.0)
    st.save(f, m)
    # a save that died after writing its factor files but before its index row
    orphan = spark.createDataFrame([("user", 9, [7.0, 7.0], "gamma", "dead")],
                                   "kind string, id int, features array<float>, model_name string, "
                                   "attempt string")
    orphan.write.mode("append").partitionBy("attempt").parquet(st.factors_path)
    assert {r["id"] for r in st.features().collect()} == {1, 2}
    f, m = _factors(spark, "gamma", 3.0)
    assert [r["version"] for r in st.save(f, m).collect()] == [2]
    feats = {(r["kind"], r["id"]): r["features"] for r in st.features().collect()}
    assert feats == {("user", 1): [3.0, 0.0], ("item", 2): [1.0, 1.0]}


def test_train_and_store_names(spark, tmpdir_shared):
    from vecfactor.sources.payloads import parse_uploads
    from vecfactor.sources.store import train_and_store
    body = '{"ratings": {"1": {"1": 5, "2": 1}, "2": {"1": 4}}, "rank": 2, "iterations": 3, "lambda": 0.1}'
    ups = spark.createDataFrame([("a", "alpha", body), ("b", "alpha", body.replace('"2": 1', '"3": 1')),
                                 ("c", None, body), ("d", None, "{oops")],
                                "upload_id string, model_name string, payload string")
    st = ModelStore(spark, tmpdir_shared + "/store4")
    out = {r["upload_id"]: r for r in train_and_store(st, parse_uploads(ups).checkpoint()).collect()}
    assert set(out) == {"b", "c"}                      # latest upload per name; bad upload skipped
    assert out["b"]["model_name"] == "alpha" and out["b"]["version"] == 1
    gen = out["c"]["model_name"]
    assert len(gen) == NAME_LENGTH and set(gen) <= set(NAME_ALPHABET)
    items = {r["id"] for r in st.features(["alpha"]).where("kind = 'item'").collect()}
    assert items == {1, 3}                             # full retrain on the winning upload only


def test_features_json_documents(spark, tmpdir_shared):
    import json
    st = ModelStore(spark, tmpdir_shared + "/store5")
    f, m = _factors(spark, "delta", 0.5)
    st.save(f, m)
    doc = json.loads(st.features_json().first()["document"])
    assert doc == {"userFeatures": {"1": [0.5, 0.0]}, "productFeatures": {"2": [1.0, 1.0]}}
    fixed = json.loads(st.features_json(decimals=6).first()["document"])
    assert fixed == doc


def test_als_matches_the_rdd_api_with_equal_seed_and_blocks(spark):
    """The service trained with the RDD API; with the same seed and block
    counts the DataFrame ALS gives the same factors."""
    from pyspark.mllib.recommendation import ALS as RddALS
    r = _planted(spark, n_users=30, n_items=20, rank=3, seed=5)
    model = MF.train(r, rank=3, iterations=8, reg=0.05, seed=11, num_blocks=3)
    rdd_model = RddALS.train(r.rdd.map(lambda x: (x["user"], x["item"], x["rating"])),
                             3, 8, 0.05, blocks=3, seed=11)
    ours = {row["id"]: np.array(row["features"]) for row in MF.user_factors(model).collect()}
    theirs = {u: np.array(f) for u, f in rdd_model.userFeatures().collect()}
    assert set(ours) == set(theirs)
    assert max(np.abs(ours[k] - theirs[k]).max() for k in ours) < 1e-4
