"""Mixing sources to target weights by iterative proportional fitting (raking).

1. One aggregate gives the tokens of every cell (source, language, topic).
2. Raking scales the cells' weights to each target marginal in turn, for a fixed
   number of sweeps. Cells live in ``ceil(cells / 100,000)`` partitions; a
   rescaling is a window sum over one dimension, so a small cell table is
   raked in one task without any shuffle and a large one is distributed.
3. A cell with tokens T and calibrated weight w is sampled with probability
   ``min(1, rate * w / T)``; the rate makes the expected tokens meet the budget.
4. Each document is kept if a uniform hash of its id lies below its cell's
   probability: a document's fate depends on its id and its cell alone.

A null source, language or topic is a value of its own; documents without words
carry no weight but share their cell's probability (0 if the whole cell has no
words); repeated rows of one id are kept or left together; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.common import materialise, text_or_empty, words

CELLS_PER_PARTITION = 100_000
CELL_BROADCAST_ROWS = 200_000


def cell_table(docs: DataFrame, dims: list[str], tokens: str) -> DataFrame:
    cells = materialise(docs.groupBy(*dims).agg(F.sum(tokens).alias("cell_tokens"),
                                                F.count(F.lit(1)).alias("cell_docs")))
    return cells.coalesce(max(1, -(-cells.count() // CELLS_PER_PARTITION)))


def power_targets(cells: DataFrame, exponents: dict[str, float]) -> DataFrame:
    """Attach target shares: each marginal's token share to a power, normalised
    (1: as in the corpus, 0: uniform). Adds ``_target_<dim>``."""
    for dim, e in exponents.items():
        margin = F.sum("cell_tokens").over(Window.partitionBy(dim))
        members = F.count(F.lit(1)).over(Window.partitionBy(dim))
        power = F.when(margin > 0, F.pow(margin.cast("double"), F.lit(float(e)))).otherwise(F.lit(0.0))
        cells = cells.withColumn("_p", power).withColumn("_m", members)
        total = cells.agg(F.sum(F.col("_p") / F.col("_m")).alias("s")).first()["s"] or 1.0
        cells = cells.withColumn(f"_target_{dim}", F.col("_p") / F.lit(float(total))).drop("_p", "_m")
    return cells


def given_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Attach target shares given as tables (value, share) by dimension; a value
    that a table lacks gets share 0."""
    for dim, t in targets.items():
        t = t.select(F.col("value").alias("_v"), F.col("share").cast("double").alias(f"_target_{dim}"))
        cells = (cells.join(t, F.col(dim).eqNullSafe(F.col("_v")), "left").drop("_v")
                 .withColumn(f"_target_{dim}", F.coalesce(f"_target_{dim}", F.lit(0.0))))
    return cells


def rake(cells: DataFrame, dims: list[str], sweeps: int = 20, sweeps_per_job: int = 4) -> DataFrame:
    """Add ``weight``: the raked share of every cell. Every few sweeps the table
    is written to the shared folder, which keeps the plan short."""
    cur = cells.withColumn("weight", F.col("cell_tokens").cast("double"))
    parts = max(1, -(-cells.count() // CELLS_PER_PARTITION))
    for s in range(sweeps):
        for dim in dims:
            margin = F.sum("weight").over(Window.partitionBy(dim))
            cur = cur.withColumn("weight", F.when(margin > 0, F.col("weight") * F.col(f"_target_{dim}") / margin)
                                 .otherwise(F.lit(0.0)))
        if (s + 1) % sweeps_per_job == 0 or s + 1 == sweeps:
            cur = materialise(cur).coalesce(parts)
    return cur


def sampling_rate(cells: DataFrame, budget_share: float) -> float:
    """The rate at which ``sum(min(T, rate * w))`` meets the budget.

    The sum is concave and piecewise linear in the rate; Newton steps from the
    left reach the solution after finitely many steps.
    """
    first = cells.agg(F.sum("cell_tokens").alias("t"), F.sum("weight").alias("w"),
                      F.sum(F.when(F.col("weight") > 0, F.col("cell_tokens"))).alias("reach")).first()
    budget = budget_share * float(first["t"] or 0)
    if not first["w"] or budget >= float(first["reach"] or 0):
        return math.inf
    rate = budget / first["w"]
    while True:
        full = (F.col("weight") > 0) & (F.col("cell_tokens") <= F.lit(rate) * F.col("weight"))
        r = cells.agg(F.sum(F.when(full, F.col("cell_tokens"))).alias("t"),
                      F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            return math.inf
        nxt = (budget - float(r["t"] or 0)) / r["w"]
        if nxt <= rate * (1 + 1e-12):
            return rate
        rate = nxt


def cell_probability(cells: DataFrame, rate: float) -> DataFrame:
    if math.isinf(rate):
        p = F.when((F.col("weight") > 0) & (F.col("cell_tokens") > 0), F.lit(1.0))
    else:
        p = F.when(F.col("cell_tokens") > 0, F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("cell_tokens")))
    return cells.withColumn("prob", F.coalesce(p, F.lit(0.0)))


def uniform(id_col: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from the id: 52 bits of an md5, so that other
    engines can repeat the draw."""
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated_cells(docs: DataFrame, exponents: dict[str, float], tokens: str, budget_share: float,
                     sweeps: int = 20) -> DataFrame:
    dims = list(exponents)
    cells = rake(power_targets(cell_table(docs, dims, tokens), exponents), dims, sweeps)
    return cell_probability(cells, sampling_rate(cells, budget_share))


def attach_probability(docs: DataFrame, cells: DataFrame, dims: list[str]) -> DataFrame:
    """Join each row with its cell. The cell table is broadcast only below a
    counted bound; beyond it the join shuffles and skewed cells are split."""
    c = cells.select(*[F.col(d).alias(f"_c_{d}") for d in dims], "prob")
    if cells.count() <= CELL_BROADCAST_ROWS:
        c = F.broadcast(c)
    on = [F.col(d).eqNullSafe(F.col(f"_c_{d}")) for d in dims]
    return docs.join(c, on, "left").drop(*[f"_c_{d}" for d in dims]).withColumn("prob", F.coalesce("prob", F.lit(0.0)))


# topics of a text by its marks, first match wins
TOPIC_MARKS = [("table", "|"), ("symbols", "###"), ("shout", "!!"), ("contact", "@"), ("link", "http"),
               ("license", "icense")]
EXPONENTS = {"source": 0.7, "lang": 0.5, "topic": 0.3}
BUDGET_SHARE = 0.5
SWEEPS = 20


def topic_of(text: Column) -> Column:
    """A cheap topic label; any other label column serves as well."""
    t = F.lit("prose")
    for name, mark in reversed(TOPIC_MARKS):
        t = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(t)
    return t


def mix_documents(docs: DataFrame, exponents: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE,
                  seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its cell, ``n_tokens``, ``prob`` and ``kept``."""
    exponents = exponents or EXPONENTS
    t = text_or_empty(text_col)
    d = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col("source").alias("source"),
                                F.col("lang").alias("lang"), topic_of(t).alias("topic"),
                                F.size(words(t)).cast("long").alias("n_tokens")))
    cells = materialise(calibrated_cells(d, exponents, "n_tokens", budget_share, SWEEPS))
    out = attach_probability(d, cells, list(exponents))
    return out.withColumn("kept", uniform(F.col("doc_id"), seed) < F.col("prob"))


def mixed_rows(docs: DataFrame, exponents: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE,
               seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows with the input's columns. The verdict is a function of id
    and cell, so the second pass over the texts joins only the bounded cell
    table: no text is shuffled."""
    exponents = exponents or EXPONENTS
    t = text_or_empty(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select(row, F.col(id_col).alias("doc_id"), F.col("source").alias("source"), F.col("lang").alias("lang"),
                    topic_of(t).alias("topic"), F.size(words(t)).cast("long").alias("n_tokens"))
    cells = materialise(calibrated_cells(d.drop("_row"), exponents, "n_tokens", budget_share, SWEEPS))
    out = attach_probability(d.drop("n_tokens"), cells, list(exponents))
    return out.where(uniform(F.col("doc_id"), seed) < F.col("prob")).select("_row.*")


def mix_sql() -> str:
    """DuckDB SQL for ``mix_documents`` on ``documents``."""
    cases = " ".join(f"WHEN contains(t, '{m}') THEN '{n}'" for n, m in TOPIC_MARKS)
    ctes = [f"""d AS (SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic,
  len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
            """c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tk FROM d GROUP BY ALL)"""]
    for dim, e in EXPONENTS.items():
        ctes.append(f"""t_{dim} AS (SELECT {dim}, p / sum(p) OVER () AS share FROM
  (SELECT {dim}, CASE WHEN sum(tk) > 0 THEN pow(sum(tk), {e}) ELSE 0 END AS p FROM c GROUP BY {dim}))""")
    ctes.append("""s0 AS (SELECT c.*, tk AS w, t_source.share AS g_source, t_lang.share AS g_lang,
  t_topic.share AS g_topic FROM c
  JOIN t_source ON c.source IS NOT DISTINCT FROM t_source.source
  JOIN t_lang ON c.lang IS NOT DISTINCT FROM t_lang.lang
  JOIN t_topic ON c.topic IS NOT DISTINCT FROM t_topic.topic)""")
    n = 0
    for _ in range(SWEEPS):
        for dim in EXPONENTS:
            ctes.append(f"""s{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0
  THEN w * g_{dim} / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w) FROM s{n})""")
            n += 1
    ctes.append(f"""f AS (SELECT *, CASE WHEN w > 0 THEN tk / w END AS r,
  ({BUDGET_SHARE} * sum(tk) OVER ()
   - coalesce(sum(tk) OVER (ORDER BY tk / nullif(w, 0) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY tk / nullif(w, 0)
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lam FROM s{n} WHERE w > 0)""")
    ctes.append("rate AS (SELECT min_by(lam, r) AS lam FROM f WHERE lam <= r)")
    ctes.append(f"""p AS (SELECT source, lang, topic,
  CASE WHEN tk > 0 AND w > 0 THEN least(1.0, coalesce((SELECT lam FROM rate) * w / tk, 1.0)) ELSE 0.0 END AS prob
  FROM s{n})""")
    return "WITH " + ",\n".join(ctes) + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.prob, 9) AS prob,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < p.prob AS kept
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang
 AND d.topic IS NOT DISTINCT FROM p.topic"""
