"""Packing by optimal length buckets.

1. One aggregate gives the global histogram of token lengths (exact up to
   ``exact_to`` tokens, in steps of 1/1024 of the length above, so it has a few
   thousand bins whatever the data).
2. Dynamic programming over the histogram chooses at most ``buckets`` upper
   bounds with the least total padding when each row is padded to its bucket's
   bound.
3. Inside each bucket, rows fill batches of ``budget // bound`` rows (at least
   one), so that a padded batch stays within the token budget. Row numbers come
   from (bucket, salt) groups plus offsets: no task ever holds a whole bucket.

Texts without words have length 0 and lie in the first bucket; null texts count
as empty; repeated rows are packed one by one; an empty table gives an empty
result. A text longer than the budget is a batch of its own, never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.common import materialise, text_or_empty, words


def choose_bounds(hist: list[tuple[int, int]], buckets: int) -> tuple[list[int], int]:
    """Bucket upper bounds with the least padding, and that padding.

    ``hist``: (length, rows), ascending. With the bins cut into runs, a run's
    padding is its bound times its rows less its tokens, so the best total
    for the first j bins and k buckets is
    ``f_k(j) = min_i f_{k-1}(i) + L_j (R_j - R_i) - (S_j - S_i)``: lines in
    ``L_j`` with slope ``-R_i``. Bounds ascend, so the lower envelope is walked
    once per k: O(buckets * bins).
    """
    if not hist:
        return [], 0
    n = len(hist)
    L = [x for x, _ in hist]
    R, S = [0], [0]
    for x, c in hist:
        R.append(R[-1] + c)
        S.append(S[-1] + x * c)
    best = [L[j] * R[j + 1] - S[j + 1] for j in range(n)]  # one bucket for bins 0..j
    back = [[-1] * n]
    for _ in range(1, min(buckets, n)):
        cur, prev = [0] * n, [0] * n
        lines: list[tuple[int, int, int]] = []  # slope -R, value f + S, first bin of the run - 1
        head = 0
        for j in range(n):
            if j:  # a run that starts after bin j - 1 becomes available
                m, b = -R[j], best[j - 1] + S[j]
                while len(lines) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        lines.pop()
                    else:
                        break
                lines.append((m, b, j - 1))
            x = L[j]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            cur[j], prev[j] = best[j], -1
            if len(lines) > head:
                m, b, i = lines[head]
                v = m * x + b + x * R[j + 1] - S[j + 1]
                if v < cur[j]:
                    cur[j], prev[j] = v, i
        best = cur
        back.append(prev)
    bounds, j, k = [], n - 1, len(back) - 1
    while j >= 0:
        bounds.append(L[j])
        j, k = back[k][j], k - 1
    return bounds[::-1], best[n - 1]


def length_bin(n: Column, exact_to: int = 4096) -> Column:
    """The histogram's bin: the length, rounded up to 1/1024 of its power of two
    above ``exact_to``."""
    step = F.greatest(F.lit(1), F.shiftright(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1))))).cast("long"), 10))
    return F.when(n <= exact_to, n).otherwise(F.ceil(n / step).cast("long") * step)


def pack(df: DataFrame, tokens: Column, keep: list[str], buckets: int = 16, budget: int = 65_536,
         group_rows: int = 2_000, exact_to: int = 4096) -> DataFrame:
    """Columns ``keep`` plus ``n_tokens``, ``bucket``, ``bound`` (padded length),
    ``batch`` (from 0 in each bucket), ``slot`` (from 0 in each batch) and
    ``padding``.

    ``keep`` should be narrow (ids): these rows are shuffled once.
    """
    spark = df.sparkSession
    base = materialise(df.select(*[F.col(f"`{c}`") for c in keep], tokens.cast("long").alias("n_tokens"))
                       .withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_bin", length_bin(F.col("n_tokens"), exact_to)))
    hist = (base.groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("top"))
            .orderBy("_bin").collect())  # bounded: exact_to + about 1024 bins per doubling
    rows = sum(r["n"] for r in hist)
    bounds, _ = choose_bounds([(r["top"], r["n"]) for r in hist], buckets)
    caps = [max(1, budget // max(1, b)) for b in bounds]
    arr = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(arr, lambda b: b < F.col("n_tokens")))
    salts = max(1, -(-rows // group_rows))
    salted = (base.drop("_bin").withColumn("bucket", bucket.cast("int"))
              .withColumn("_salt", F.pmod(F.xxhash64("_mid", "n_tokens"), F.lit(salts)).cast("int")))
    before = Window.partitionBy("bucket").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("bucket", "_salt").agg(F.count(F.lit(1)).alias("_n"))
               .select("bucket", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    rank = Window.partitionBy("bucket", "_salt").orderBy("_mid")
    bound_cap = F.broadcast(spark.createDataFrame(  # one row per bucket
        list(zip(range(len(bounds)), bounds, caps)), "bucket int, bound long, _cap long"))
    rn = F.col("_off") + F.col("_rn") - 1
    return (salted.withColumn("_rn", F.row_number().over(rank))
            .join(offsets, ["bucket", "_salt"])
            .join(bound_cap, "bucket")
            .select(*[F.col(f"`{c}`") for c in keep], "n_tokens", "bucket", "bound",
                    F.floor(rn / F.col("_cap")).cast("long").alias("batch"),
                    F.pmod(rn, F.col("_cap")).cast("long").alias("slot"),
                    (F.col("bound") - F.col("n_tokens")).alias("padding")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16,
                   budget: int = 65_536) -> DataFrame:
    """Documents packed by their number of words."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return pack(d, F.size(words(F.col("text"))), ["doc_id"], buckets, budget)
