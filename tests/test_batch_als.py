import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfactor.operators import batch_als as B
from vecfactor.operators import factors as MF


def _planted(spark, n_users=20, n_items=15, rank=2, seed=3):
    rng = np.random.default_rng(seed)
    R = rng.normal(size=(n_users, rank)) @ rng.normal(size=(n_items, rank)).T
    rows = [(u, i, float(R[u, i])) for u in range(n_users) for i in range(n_items)]
    return spark.createDataFrame(rows, "user int, item int, rating double")


def _named(r, name, rank=2, iterations=5, reg=0.01):
    return r.select(F.lit(name).alias("model_name"), "user", "item", "rating", F.lit(rank).alias("rank"),
                    F.lit(iterations).alias("iterations"), F.lit(reg).alias("reg"))


def _vectors(f):
    return {(r["model_name"], r["kind"], r["id"]): np.array(r["features"]) for r in f.collect()}


def _numpy_als(rows, rank, iterations, reg, start):
    """Plain alternating least squares from given start factors (items first)."""
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    x = {"user": {u: start["m", "user", u] for u in users}, "item": {i: start["m", "item", i] for i in items}}
    for _ in range(iterations):
        for side, other, at in (("item", "user", 1), ("user", "item", 0)):
            new = {}
            for key in x[side]:
                own = [r for r in rows if r[at] == key]
                v = np.array([x[other][r[1 - at]] for r in own])
                a = v.T @ v + reg * len(own) * np.eye(rank)
                new[key] = np.linalg.solve(a, v.T @ np.array([r[2] for r in own]))
            x[side] = new
    return {("m", side, k): v for side in x for k, v in x[side].items()}


@pytest.mark.parametrize("k", [3, 12])        # 12: more sums than one compiled aggregate takes
def test_against_plain_als(spark, k):
    r = _planted(spark, 9, 7).where("(user + item) % 3 != 0")
    rows = [(x["user"], x["item"], x["rating"]) for x in r.collect()]
    start = _vectors(B.train_many(_named(r, "m", k, 0, 0.1)))
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in start.values())     # no iteration: the unit start vectors
    got = _vectors(B.train_many(_named(r, "m", k, 4, 0.1), cut=2))
    # the plain run starts from double vectors
    start = {("m", side, x["id"]): np.array(x["vec"]) for side in ("user", "item")
             for x in B.start_factors(_named(r, "m", k, 0, 0.1), side, B.DEFAULT_SEED).collect()}
    want = _numpy_als(rows, k, 4, 0.1, start)
    assert set(got) == set(want) and max(np.abs(got[k] - want[k]).max() for k in want) < 1e-5


def test_a_model_does_not_depend_on_its_neighbours(spark):
    r = _planted(spark)
    a = _named(r, "a")
    others = (_named(_planted(spark, 30, 9, seed=8), "0first", 3, 5, 0.2)
              .unionByName(_named(r.where("user < 10"), "b", 2, 5, 0.01))
              .unionByName(_named(r.where("item > 3"), "z", 5, 2, 0.0)))
    alone, both = _vectors(B.train_many(a)), _vectors(B.train_many(others.unionByName(a)))
    assert {k[0] for k in both} == {"a", "b", "z", "0first"}
    assert max(np.abs(alone[k] - both[k]).max() for k in alone) < 1e-5
    assert {len(v) for k, v in both.items() if k[0] == "z"} == {5}

    def mse(f):
        one = f.where("model_name = 'a'")
        return MF.mse(MF.score_pairs(r, *[one.where(F.col("kind") == k).select("id", "features")
                                          for k in ("user", "item")])).first()["mse"]
    m1, m2 = mse(B.train_many(a)), mse(B.train_many(others.unionByName(a)))
    assert m1 == pytest.approx(m2, rel=1e-6) and m1 < 0.02


def test_residuals_of_the_last_solved_side(spark):
    r = _named(_planted(spark).where("(user * item) % 4 != 1"), "a", 2, 3, 0.05)
    f = B.train_many(r)
    top = {s: B.normal_residuals(r, f, s).agg(F.max("residual"), F.count("id")).first() for s in ("user", "item")}
    assert top["user"][0] < 1e-5 and top["user"][1] == 20
    assert top["item"][0] > 1e-5                     # solved before the users moved
    model = MF.train(r, 2, 3, 0.05)                  # Spark's own ALS ends with the users as well
    own = (MF.user_factors(model).select(F.lit("a").alias("model_name"), F.lit("user").alias("kind"), "id", "features")
           .unionByName(MF.item_factors(model).select(F.lit("a").alias("model_name"), F.lit("item").alias("kind"), "id",
                                                      "features")))
    assert B.normal_residuals(r, own).agg(F.max("residual")).first()[0] < 1e-4
    bad = f.withColumn("features", F.transform("features", lambda x: x * 1.01))
    assert B.normal_residuals(r, bad).agg(F.max("residual")).first()[0] > 1e-3


def test_many_parameter_sets_are_one_plan(spark):
    r = _planted(spark, 4, 4)
    names = spark.range(200).select(F.concat(F.lit("m"), "id").alias("model_name"), (F.col("id") / 100 + 0.01).alias("reg"))
    rows = names.crossJoin(_named(r, "x", 2, 3).drop("model_name", "reg")).select(*B.RATING_COLUMNS)
    t = time.time()
    f = B.train_many(rows)
    assert f.groupBy("model_name").count().where("count = 8").count() == 200
    assert time.time() - t < 60
    assert B.normal_residuals(rows, f).agg(F.max("residual")).first()[0] < 1e-4


def test_singular_and_empty(spark):
    one = spark.createDataFrame([(1, 1, 2.0)], "user int, item int, rating double")
    got = _vectors(B.train_many(_named(one, "s", 3, 4, 0.0)))
    assert np.dot(got["s", "user", 1], got["s", "item", 1]) == pytest.approx(2.0, rel=1e-5)
    assert B.train_many(_named(one.where("user = 2"), "s")).count() == 0
