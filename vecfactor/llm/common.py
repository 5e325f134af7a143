"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.session import ensure_checkpoint_dir

# words are runs of anything but these six characters (space, \t \n \v \f \r)
SPACES = " \t\n\u000b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder of ``spark.checkpoint.dir``; later
    reads survive lost executors and never recompute the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """All words of a non-null text, in order; an empty array without words."""
    t = F.btrim(text, F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def with_row(df: DataFrame, **own: Column) -> DataFrame:
    """The input row as one struct ``_row`` beside the operator's own columns.

    Own columns can then have any name without clashing; ``select("_row.*")``
    gives the input columns back.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*cols).alias("_row"), *[c.alias(n) for n, c in own.items()])


def sealed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator. A filter on a computed column is otherwise pushed
    below the projections that compute it and evaluates every step again, once for each
    use of it; filters do not cross a generator."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_sealed")) \
        .select("_sealed.*")


def unit_hash(*cols, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from the columns (53 bits of a 64-bit hash)."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def crc32_text(col) -> Column:
    """Unsigned crc32 of the column written as text, as the contracts' folds use it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))
