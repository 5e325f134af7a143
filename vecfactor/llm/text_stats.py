"""Per-document text statistics as Spark expressions, computed in the row.

``add_word_stats`` adds, for a frame with a ``text`` column: ``n_words``,
``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``. A null
text counts as empty, and an empty text has all statistics 0. No shuffle, no
Python: every step is an array expression, linear in the text but for one sort
of the windows of texts in which some window repeats. The result is sealed: a
filter on a statistic does not evaluate the steps again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfactor.llm.common import SPACES, sealed, text_or_empty, words

WORD_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def add_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_t`` (text, never null) and ``_w`` (its words)."""
    return df.withColumn("_t", text_or_empty(text)).withColumn("_w", words(F.col("_t")))


def n_symbols(t: Column) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")


def n_dup_lines(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def add_repeat_words(df: DataFrame, w: str = "_w", out: str = "n_repeat_words") -> DataFrame:
    """Count the words that lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash inside one document. Only documents
    with a repeated window (a cheap distinct count tells) sort their windows;
    equal neighbours after the sort mark the repeated ones.
    """
    n = F.size(w)
    tri = F.when(n >= 3, F.transform(
        F.slice(F.col(w), F.lit(1), n - 2),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("_tri", tri)
    repeated = F.size(F.array_distinct("_tri")) < F.size("_tri")
    df = df.withColumn("_srt", F.when(repeated, F.sort_array(
        F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_srt", lambda e, j: (
        F.coalesce(F.get("_srt", j - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("_srt", j + 1)["h"] == e["h"], F.lit(False))))
    covered = F.array_distinct(F.flatten(F.transform(
        twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return (df.withColumn(out, F.when(F.col("_srt").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
            .drop("_tri", "_srt"))


def with_word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``add_word_stats`` without the seal, for callers that seal what they make of it."""
    df = add_words(df, text)
    df = add_repeat_words(df)
    return (df.withColumn("n_words", F.size("_w").cast("long"))
            .withColumn("word_chars", F.length(F.concat_ws("", "_w")).cast("long"))
            .withColumn("n_symbols", n_symbols(F.col("_t")))
            .withColumn("n_dup_lines", n_dup_lines(F.col("_t"))))


def add_word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return sealed(with_word_stats(df, text))
