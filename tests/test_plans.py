"""Plan-level checks: the size check decides broadcast vs shuffle, and both
paths give the same answer; small scans are spread over all task slots."""

import io
import contextlib

import numpy as np

from vecfactor.operators import centers as C
from vecfactor.plans import fixtures as FX
from vecfactor.plans.sizing import spread

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_broadcast_only_under_the_measured_limit(spark):
    vocab = FX.vocabulary(spark, SF).checkpoint()
    lists = FX.word_lists(spark, SF)
    small = C.centers(lists, vocab)
    assert "BroadcastExchange" in _plan(small)
    spark.conf.set("vecfactor.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = C.centers(lists, vocab)
        plan = _plan(big)
        assert "SortMergeJoin" in plan
        kc_big = {r["list_id"]: (r["n_words"], r["n_known"]) for r in C.known_counts(lists, vocab).collect()}
        got_big = {r["list_id"]: r for r in big.collect()}
    finally:
        spark.conf.unset("vecfactor.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kc_small = {r["list_id"]: (r["n_words"], r["n_known"]) for r in C.known_counts(lists, vocab).collect()}
    assert kc_big == kc_small
    got_small = {r["list_id"]: r for r in small.collect()}
    assert set(got_big) == set(got_small)
    for k, r in got_small.items():
        assert (r["n_words"], r["n_known"]) == (got_big[k]["n_words"], got_big[k]["n_known"])
        if r["center"] is None:
            assert got_big[k]["center"] is None
        else:
            assert np.allclose(r["center"], got_big[k]["center"])


def test_spread_only_small_inputs(spark):
    one = spark.range(0, 100, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, numPartitions=64)
    assert spread(many).rdd.getNumPartitions() == 64
