"""Explicit size checks before a broadcast.

A side is only broadcast after a measured byte bound says it fits; otherwise
the caller takes the shuffle (sort-merge) path. The bound is computed by one
aggregate over the side itself, so it is a proof, not an estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# default ceiling for anything we broadcast ourselves (bytes)
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024


def broadcast_limit(spark: SparkSession) -> int:
    v = spark.conf.get("vecfactor.broadcast.maxBytes", None)
    return int(v) if v else DEFAULT_BROADCAST_BYTES


def vector_table_bytes(df: DataFrame, vec_col: str = "vec", key_col: str = "word") -> int:
    """Upper bound of the in-memory size of a (key, vector) table."""
    row = df.agg(F.sum(F.coalesce(F.size(vec_col), F.lit(0)) * 8
                       + F.coalesce(F.octet_length(key_col), F.lit(0)) + 48).alias("b")).first()
    return int(row["b"] or 0)


def maybe_broadcast(df: DataFrame, nbytes: int, limit: int) -> tuple[DataFrame, bool]:
    if nbytes <= limit:
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a small input over all task slots.

    A scan with fewer splits than the cluster has cores (one small file, one
    row group) would run all per-row work before the first shuffle in a few
    tasks. Only then are its rows redistributed round-robin (whole rows, so a
    document's tokens stay together); a large input keeps its scan splits and
    pays nothing.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
