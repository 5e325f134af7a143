"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds for the sample, timed) and selectivity (share of the
sample it rejects) are measured on a hashed sample of the documents; rules then
run in order of rejections per second of cost, and a rejected document skips the
rest. The order changes only the work done, never the verdict, which is "no rule
fails".

* ``cascade_filter`` drops rejected rows rule by rule, with a generator for each
  rule (a filter would be pushed below the statistics and repeat them): what a rule
  needs is computed for the rows that all rules before it kept.
* ``cascade_verdict`` keeps all rows. From the first rule that rejects a row on, its
  text and words are null for the later rules, so their statistics cost nothing.
* ``quality_report`` returns the base statistics of every row, so these are computed
  for all; only what the other rules need is skipped for rejected rows.

Null texts count as empty (0 words: the length rule rejects them); equal rows
get equal verdicts; an empty table gives an empty result. Texts of any length
are read whole.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfactor.llm import text_stats as S
from vecfactor.llm.common import materialise, sealed, text_or_empty, with_row, words


@dataclass
class Rule:
    """``fails`` is a boolean column over ``_t`` (text), ``_w`` (words) and the
    columns that ``prepare`` adds; ``prepare`` may be left out."""
    name: str
    fails: Callable[[], Column]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)


def _stat(name: str, expr: Callable[[], Column]):
    """A step that adds a statistic unless it is already there."""
    return lambda df: df if name in df.columns else df.withColumn(name, expr())


def _n_words(df: DataFrame) -> DataFrame:
    return _stat("n_words", lambda: F.size("_w").cast("long"))(df)


def _repeat(df: DataFrame) -> DataFrame:
    df = _n_words(df)
    return df if "n_repeat_words" in df.columns else S.add_repeat_words(df)


def length_rule(min_words: int = 50) -> Rule:
    return Rule("length", lambda: F.col("n_words") < min_words, _n_words)


def repetition_rule(max_percent: int = 50) -> Rule:
    return Rule("repetition", lambda: 100 * F.col("n_repeat_words") > max_percent * F.col("n_words"), _repeat)


def symbol_rule(max_per_100_words: int = 10) -> Rule:
    return Rule("symbols", lambda: 100 * F.col("n_symbols") > max_per_100_words * F.col("n_words"),
                lambda df: _n_words(_stat("n_symbols", lambda: S.n_symbols(F.col("_t")))(df)))


def duplicate_line_rule(max_percent: int = 40, min_dup_lines: int = 3) -> Rule:
    """Repeated lines as a share of all lines with a word, from a few repeats on."""
    def prepare(df: DataFrame) -> DataFrame:
        df = _stat("n_dup_lines", lambda: S.n_dup_lines(F.col("_t")))(df)
        return _stat("_lines", lambda: F.size(F.filter(
            F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(S.SPACES)) != "")))(df)
    return Rule("duplicate_lines", lambda: (F.col("n_dup_lines") >= min_dup_lines)
                & (100 * F.col("n_dup_lines") > max_percent * F.col("_lines")), prepare)


def word_length_rule(low: int = 2, high: int = 15) -> Rule:
    """Mean word length outside [low, high] code points."""
    return Rule("word_length", lambda: (F.col("word_chars") < low * F.col("n_words"))
                | (F.col("word_chars") > high * F.col("n_words")),
                lambda df: _n_words(_stat("word_chars", lambda: F.length(F.concat_ws("", "_w")).cast("long"))(df)))


def capitals_rule(max_percent: int = 60, min_letters: int = 20) -> Rule:
    """Capital letters (A-Z) as a share of all ASCII letters."""
    def prepare(df: DataFrame) -> DataFrame:
        df = _stat("_upper", lambda: F.length(F.regexp_replace("_t", "[^A-Z]+", "")))(df)
        return _stat("_letters", lambda: F.length(F.regexp_replace("_t", "[^A-Za-z]+", "")))(df)
    return Rule("capitals", lambda: (F.col("_letters") >= min_letters)
                & (100 * F.col("_upper") > max_percent * F.col("_letters")), prepare)


def production_rules() -> list[Rule]:
    return [length_rule(), repetition_rule(), symbol_rule(), duplicate_line_rule(), word_length_rule(),
            capitals_rule()]


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(text_or_empty(text_col).alias("_t")).withColumn("_w", words(F.col("_t")))


def plan_cascade(df: DataFrame, rules: list[Rule], text_col: str = "text",
                 sample_rows: int = 2000) -> list[tuple[Rule, float, float]]:
    """Rules with (cost in seconds, rejected share), best first.

    The sample takes about ``sample_rows`` rows by a hash of the row's position
    (not of its text: copies of one text may be a third of all rows); the rules
    are timed on it in one task, less the time that reading it takes.
    """
    n = df.count()
    step = max(1, n // sample_rows)
    t = text_or_empty(text_col)
    sample = materialise(df.select(t.alias("text"))
                         .where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(step)) == 0)
                         .repartition(1))  # only the sampled rows move

    def timed(frame: DataFrame, cond: Column):
        """Least of three runs after a first one that compiles the code."""
        secs = []
        for _ in range(4):
            t0 = time.perf_counter()
            r = frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(cond).alias("bad")).first()
            secs.append(time.perf_counter() - t0)
        return min(secs[1:]), r["n"], r["bad"]

    base = _texts(sample, "text")
    floor = timed(base, F.size("_w") < 0)[0]
    out = []
    for rule in rules:
        secs, rows, bad = timed(rule.prepare(base), rule.fails())
        # differences below half of the reading time are noise; so are factors below 4
        cost = 4.0 ** round(math.log(max(secs - floor, floor / 2), 4))
        out.append((rule, cost, bad / rows if rows else 0.0))
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade_filter(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the input's columns."""
    cur = with_row(df, _t=text_or_empty(text_col)).withColumn("_w", words(F.col("_t")))
    for rule in rules:
        ready = rule.prepare(cur)
        passed = F.when(~_failed(rule), F.array(F.struct(*ready.columns)))
        cur = ready.select(F.explode(passed).alias("_passed")).select("_passed.*")
    return cur.select("_row.*")


def _failed(rule: Rule) -> Column:
    return F.coalesce(rule.fails(), F.lit(False))


def cascade_verdict(df: DataFrame, rules: list[Rule], out: str = "kept") -> DataFrame:
    """Add the verdict to a frame that has ``_t``, ``_w``; these are null afterwards for
    rows that were rejected."""
    df = df.withColumn(out, F.lit(True))
    for rule in rules:
        for c in ("_t", "_w"):
            df = df.withColumn(c, F.when(F.col(out), F.col(c)))
        df = rule.prepare(df)
        df = df.withColumn(out, F.col(out) & ~_failed(rule))
    return df


def ordered_rules(df: DataFrame, text_col: str = "text") -> list[Rule]:
    return [r for r, _, _ in plan_cascade(df, production_rules(), text_col)]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base statistics, ``base_failed`` and ``kept``."""
    rules = ordered_rules(docs, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = cascade_verdict(S.add_word_stats(d), rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return sealed(d.select("doc_id", *S.WORD_STATS, failed.alias("base_failed"),
                           (~failed & F.col("kept")).alias("kept")))
