import os
import time

import pytest
from pyspark.sql import functions as F

from vecfactor.sources.store import ModelStore


def _models(spark, names, value=1.0):
    factors = spark.createDataFrame([(n, k, i, [value, float(i)]) for n in names for k in ("user", "item")
                                     for i in range(3)], "model_name string, kind string, id int, features array<double>")
    meta = spark.createDataFrame([(n, 2, 1, 0.1, 3) for n in names],
                                 "model_name string, rank int, iterations int, reg double, n_ratings long")
    return factors, meta


def _seen(st):
    live = sorted(map(repr, st.latest().drop("created_at").collect()))
    return live, sorted(map(repr, st.features().collect()))


def _files(path):
    return [f for f in os.listdir(path) if not f.startswith(("_", "."))] if os.path.isdir(path) else []


@pytest.fixture()
def store(spark, tmpdir_shared):
    return ModelStore(spark, f"{tmpdir_shared}/vacuum{time.time_ns()}")


def test_vacuum_bounds_files_and_changes_nothing(spark, store):
    for x in range(6):
        store.save(*_models(spark, ["a", f"b{x % 2}"], float(x)))
    store.delete(spark.createDataFrame([("b1",)], "model_name string"))
    before = _seen(store)
    assert len(_files(store.factors_path)) == 6
    assert store.vacuum(0.0)["folders"] == 4  # the newest save of a, and of b0, are left
    assert _seen(store) == before
    done = store.vacuum(0.0)
    assert done["files"] > 6 and _seen(store) == before
    assert len(_files(store.factors_path)) == 2 and len(_files(store.index_path)) == 1
    assert len(_files(store.commits_path)) == 2
    for _ in range(2):  # nothing left to do
        assert store.vacuum(0.0) == {"folders": 0, "files": 0, "merged": 0}
    # numbers keep growing, also those of a deleted model
    saved = {r["model_name"]: r["version"] for r in store.save(*_models(spark, ["a", "b1", "c"])).collect()}
    assert saved == {"a": 7, "b1": 5, "c": 1}
    assert store.commits().agg(F.max("seq")).first()[0] == 8


def test_vacuum_keeps_what_the_retention_covers(spark, store):
    store.save(*_models(spark, ["a"]))
    time.sleep(2)
    old = store.features().where("model_name = 'a'")  # planned on the first version
    store.save(*_models(spark, ["a"], 2.0))
    # the first version was live within the last second or so, though saved before: it stays
    assert store.vacuum(3600.0) == {"folders": 0, "files": 0, "merged": 0}
    kept = store.vacuum(time.time() - os.path.getmtime(f"{store.commits_path}/{1:020d}.json") - 1)
    assert kept["folders"] == 0 and old.count() == 6
    assert store.vacuum(0.0)["folders"] == 1


def test_vacuum_removes_saves_that_died(spark, store):
    factors, meta = _models(spark, ["a"])
    store.save(factors, meta)
    store._write_factors(factors, meta, "dead")  # neither index rows nor a commit
    store._with_versions(meta).select(
        "model_name", "version", F.lit("save").alias("op"), F.current_timestamp().alias("created_at"), "rank",
        "iterations", "reg", "n_ratings", F.lit(None).cast("string").alias("upload_id"), F.lit("dead").alias("attempt"),
        F.lit("nocommit").alias("entry")).write.mode("append").parquet(store.index_path)
    before = _seen(store)
    assert store.vacuum(3600.0)["folders"] == 0
    assert store.vacuum(0.0)["folders"] == 1 and "attempt=dead" not in os.listdir(store.factors_path)
    store.vacuum(0.0)
    assert _seen(store) == before
    assert spark.read.parquet(store.index_path).where("entry = 'nocommit'").count() == 0


def test_replay_after_vacuum_has_no_effect(spark, store):
    store.save(*_models(spark, ["a", "b"]), batch_key="k1")
    store.save(*_models(spark, ["a"]), batch_key="k2")
    store.save(*_models(spark, ["c"]))
    store.vacuum(0.0)
    # merged rows stand twice until the next vacuum
    assert [tuple(r) for r in store.save(*_models(spark, ["a"]), batch_key="k2").collect()] == [("a", 2)]
    store.vacuum(0.0)
    before = _seen(store)
    assert [tuple(r) for r in store.save(*_models(spark, ["a", "b"]), batch_key="k1").collect()] == [("b", 1)]
    assert _seen(store) == before


def test_vacuum_of_an_empty_store(store):
    assert store.vacuum(0.0) == {"folders": 0, "files": 0, "merged": 0}
