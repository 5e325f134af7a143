"""ALS training, pair scoring and squared-error evaluation.

Scoring takes factor *DataFrames* (``id, features``), not a model object, so
the same plan scores a freshly trained model, a stored version, or fixed
factors, and is checkable in SQL. A prediction is the dot product of the
user and item factors; the two lookups are hash joins, each factor side
broadcast only when its measured size fits.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfactor.functions.vectors import dot
from vecfactor.plans.sizing import broadcast_limit, maybe_broadcast, vector_table_bytes

DEFAULT_SEED = 42


def train(ratings: DataFrame, rank: int, iterations: int, reg: float, seed: int = DEFAULT_SEED,
          num_blocks: int = 10, checkpoint_interval: int = 10) -> ALSModel:
    """Explicit-feedback ALS with the reference's positional parameters.

    ``seed`` and the block counts are fixed so a retrain on the same data gives
    the same factors. Intermediate RDDs are checkpointed every
    ``checkpoint_interval`` iterations into the shared checkpoint folder, which
    cuts lineage and lets a long fit survive lost executors.
    """
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="user", itemCol="item",
              ratingCol="rating", implicitPrefs=False, nonnegative=False, seed=seed,
              numUserBlocks=num_blocks, numItemBlocks=num_blocks,
              checkpointInterval=checkpoint_interval, coldStartStrategy="drop")
    return als.fit(ratings.select("user", "item", F.col("rating").cast("float").alias("rating")))


def user_factors(model: ALSModel) -> DataFrame:
    return model.userFactors.select(F.col("id").cast("int").alias("id"), "features")


def item_factors(model: ALSModel) -> DataFrame:
    return model.itemFactors.select(F.col("id").cast("int").alias("id"), "features")


def _side(f: DataFrame, broadcast: bool | None, vec_col: str) -> DataFrame:
    if broadcast is None:
        nbytes = vector_table_bytes(f.withColumn("_k", F.lit("")), vec_col, "_k")
        side, _ = maybe_broadcast(f, nbytes, broadcast_limit(f.sparkSession))
        return side
    return F.broadcast(f) if broadcast else f


def score_pairs(pairs: DataFrame, user_f: DataFrame, item_f: DataFrame,
                broadcast: bool | None = None) -> DataFrame:
    """``user, item, rating, prediction, known`` for every pair (left joins).

    ``known`` is false when either factor is missing (the reference's
    ``predict`` raises there); the prediction is then NULL.
    """
    u = _side(user_f.select(F.col("id").alias("user"), F.col("features").alias("uf")), broadcast, "uf")
    i = _side(item_f.select(F.col("id").alias("item"), F.col("features").alias("itf")), broadcast, "itf")
    j = pairs.join(u, "user", "left").join(i, "item", "left")
    known = F.col("uf").isNotNull() & F.col("itf").isNotNull()
    return j.select("user", "item", F.col("rating").cast("double").alias("rating"),
                    F.when(known, dot("uf", "itf")).alias("prediction"), known.alias("known"))


def squared_errors(scored: DataFrame) -> DataFrame:
    return scored.where("known").select(
        "user", "item", ((F.col("rating") - F.col("prediction")) ** 2).alias("se"))


def mse(scored: DataFrame, strict: bool = False) -> DataFrame:
    """One row ``n, n_unknown, mse``; mse is the true mean, NULL when n = 0."""
    out = scored.agg(
        F.count(F.when(F.col("known"), 1)).alias("n"),
        F.count(F.when(~F.col("known"), 1)).alias("n_unknown"),
        F.avg(F.when(F.col("known"), (F.col("rating") - F.col("prediction")) ** 2)).alias("mse"))
    if strict:
        row = out.first()
        if row["n_unknown"] > 0:
            raise ValueError(f"{row['n_unknown']} pairs have no factor in the model")
    return out
