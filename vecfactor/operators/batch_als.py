"""Alternating least squares for many models in one plan.

Every model of a batch has its own ids, rank, number of iterations and
regularisation; nothing is shared between models, so a model comes out the same
whether it is trained alone or with any others:

* start factors are unit vectors drawn from a hash of (seed, kind, id, dimension);
* a half step joins the ratings with the factors of the other side on (model, id)
  and sums ``v v'`` and ``r v`` per (model, id): k (k + 1) / 2 + k sums in compiled
  hash aggregates (:mod:`vecfactor.operators.sums`), combined inside each task before
  the shuffle, so an id with any share of the ratings sends one row per task;
* each (model, id) then solves ``(sum v v' + reg n I) x = sum r v`` for its n
  ratings. This small dense solve is the only Python step (NumPy on Arrow batches
  of systems); everything else stays in the JVM.

The plan grows by two half steps per iteration whatever the number of models or of
parameter sets: models that have had their iterations leave the ratings. Factors
are written to the shared folder whenever a model is finished, and every ``cut``
iterations, which bounds the lineage and what a lost executor costs.

Results: a singular system (``reg`` 0) gets its least-norm solution; 0 iterations
give the start factors; an empty batch gives an empty table. Sums are doubles,
stored factors floats. One very large model alone is better trained by
:func:`vecfactor.operators.factors.train` (Spark's blocked ALS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfactor.functions.vectors import dot
from vecfactor.operators.sums import WIDTH, sum_arrays
from vecfactor.plans.sizing import spread
from vecfactor.session import shared_path

DEFAULT_SEED = 42
RATING_COLUMNS = ["model_name", "user", "item", "rating", "rank", "iterations", "reg"]
_FACTOR = "model_name string, iterations int, id int, vec array<double>"


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1] from a hash (53 bits)."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 1).cast("double") / F.lit(float(1 << 53))


def start_factors(ratings: DataFrame, kind: str, seed: int) -> DataFrame:
    """Unit vectors for every (model, id) of one side."""
    def normal(d):
        u, v = (_uniform(F.lit(seed), F.lit(f"{kind}{i}"), F.col("id"), d) for i in (1, 2))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * float(np.pi) * v)
    ids = ratings.groupBy("model_name", F.col(kind).alias("id")).agg(
        F.first("rank").alias("k"), F.first("iterations").alias("iterations"))
    raw = ids.withColumn("g", F.transform(F.sequence(F.lit(0), F.col("k") - 1), normal))
    norm = F.sqrt(dot("g", "g"))
    return raw.withColumn("norm", norm).select(
        "model_name", "iterations", "id", F.transform("g", lambda x: x / F.col("norm")).alias("vec"))


def normal_equations(ratings: DataFrame, factors: DataFrame, side: str, other: str, top: int) -> DataFrame:
    """(model_name, iterations, id, reg, n, sums): the upper triangle of ``sum v v'`` row by
    row, then ``sum r v``, over the ratings of each id of ``side``; ``top`` is the largest rank."""
    f = factors.select("model_name", F.col("id").alias(other), "vec")
    j = ratings.join(f, ["model_name", other])
    j = j.withColumnRenamed(side, "id")
    extras = {"iterations": F.first("iterations"), "reg": F.first("reg"), "n": F.count(F.lit(1))}
    size, elements = top * (top + 3) // 2, None
    if size <= WIDTH:
        v = [F.get("vec", F.lit(i)) for i in range(top)]
        elements = [v[a] * v[b] for a in range(top) for b in range(a, top)] + [x * F.col("rating") for x in v]
    else:
        k = F.size("vec")
        upper = F.flatten(F.transform("vec", lambda x, i: F.transform(F.slice("vec", i + 1, k - i), lambda y: x * y)))
        j = j.withColumn("sums", F.concat(upper, F.transform("vec", lambda x: x * F.col("rating"))))
    # positions beyond the rank of a smaller model stay null
    return sum_arrays(j, ["model_name", "id"], "sums", size, extras, elements=elements) \
        .withColumn("sums", F.filter("sums", lambda x: x.isNotNull()))


def _solve(sums: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Solutions of systems of one size, given as rows of ``sums``."""
    k = int((np.sqrt(9 + 8 * sums.shape[1]) - 3) / 2 + 0.5)
    a = np.zeros((len(sums), k, k))
    at = np.triu_indices(k)
    a[:, at[0], at[1]] = sums[:, :len(at[0])]
    a[:, at[1], at[0]] = sums[:, :len(at[0])]
    a[:, np.arange(k), np.arange(k)] += ridge[:, None]
    b = sums[:, len(at[0]):, None]
    try:
        return np.linalg.solve(a, b)[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(a, hermitian=True) @ b)[..., 0]


def solved(equations: DataFrame) -> DataFrame:
    """(model_name, iterations, id, vec) from the normal equations."""
    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("sums"))
            ridge = np.asarray(b.column(b.schema.get_field_index("reg"))) * np.asarray(
                b.column(b.schema.get_field_index("n")))
            size = np.diff(np.asarray(col.offsets))
            start, flat = np.asarray(col.offsets)[:-1], np.asarray(col.values)
            vecs = np.empty(len(size), dtype=object)
            for s in np.unique(size):                       # one size per rank
                at = np.flatnonzero(size == s)
                for i, x in zip(at, _solve(flat[start[at][:, None] + np.arange(s)], ridge[at]), strict=True):
                    vecs[i] = x
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in ("model_name", "iterations", "id")]
                + [pa.array(list(vecs), pa.list_(pa.float64()))], ["model_name", "iterations", "id", "vec"])
    return equations.mapInArrow(run, _FACTOR)


def train_many(ratings: DataFrame, seed: int = DEFAULT_SEED, cut: int = 2) -> DataFrame:
    """Fit one model per ``model_name``: ``model_name, kind, id, features``.

    ``ratings``: ``model_name, user, item, rating, rank, iterations, reg``; the
    parameters are equal on all rows of a model.
    """
    spark, base = ratings.sparkSession, shared_path(ratings.sparkSession, "batch_als")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    rows = written(spread(ratings).select(*[F.col(c).cast("double" if c in ("rating", "reg") else
                                                  "string" if c == "model_name" else "int").alias(c)
                                    for c in RATING_COLUMNS]), "ratings")
    stops = sorted(r[0] for r in rows.select("iterations").distinct().collect())  # one number per step at most
    top = rows.agg(F.max("rank")).first()[0]
    users, items = (start_factors(rows, kind, seed) for kind in ("user", "item"))
    done = []
    for step in range((stops[-1] if stops else -1) + 1):
        if step:
            items = solved(normal_equations(rows, users, "item", "user", top))
            if step in stops or step % cut == 0:
                items = written(items, f"items{step}")
            users = solved(normal_equations(rows, items, "user", "item", top))
            if step in stops or step % cut == 0:
                users = written(users, f"users{step}")
        if step in stops:
            done += [f.where(F.col("iterations") == step).select(
                "model_name", F.lit(kind).alias("kind"), "id", F.col("vec").cast("array<float>").alias("features"))
                for kind, f in (("user", users), ("item", items))]
            rows = rows.where(F.col("iterations") > step)
    if not done:
        return spark.createDataFrame([], "model_name string, kind string, id int, features array<float>")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def normal_residuals(ratings: DataFrame, factors: DataFrame, side: str = "user") -> DataFrame:
    """How well trained factors solve their own normal equations: ``model_name, id, n, residual``.

    ``ratings``: ``model_name, user, item, rating, reg``; ``factors``: ``model_name, kind,
    id, features``. The gradient ``sum (v.x - r) v + reg n x`` of each id of ``side`` is 0
    after its own half step; ``residual`` is its length over that of its terms. Sums are
    taken per dimension, so no matrix is formed.
    """
    other = "item" if side == "user" else "user"

    def vectors(kind, name):
        return factors.where(F.col("kind") == kind).select(
            "model_name", F.col("id").alias(kind), F.col("features").cast("array<double>").alias(name))
    j = ratings.join(vectors(other, "v"), ["model_name", other]).join(vectors(side, "x"), ["model_name", side])
    error = dot("v", "x") - F.col("rating")
    rows = j.select("model_name", F.col(side).alias("id"), "reg", "x", error.alias("e"), "v",
                    F.col("rating").cast("double").alias("rating"))
    rows = rows.withColumn("s", F.transform("v", lambda y: y * F.col("e")))
    top = factors.agg(F.max(F.size("features"))).first()[0] or 1
    g = sum_arrays(rows, ["model_name", "id"], "s", top, {
        "x": F.first("x"), "reg": F.first("reg"), "n": F.count(F.lit(1)),
        "scale": F.sum((F.abs("rating") + F.abs("e")) * F.sqrt(dot("v", "v")))})
    g = g.withColumn("g", F.zip_with(F.slice("s", 1, F.size("x")), "x", lambda a, b: a + F.col("reg") * F.col("n") * b))
    return g.select("model_name", "id", "n", (F.sqrt(dot("g", "g")) / (F.col("scale") + 1e-12)).alias("residual"))
