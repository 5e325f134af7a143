"""Preference formatting of (chosen, rejected) conversations.

For every pair the longest common prefix of turns becomes the prompt, rendered
once; what follows it on either side becomes that side's completion, with the
character spans of its assistant texts as loss mask.

Turns are numbered per conversation by (turn, role, text); a turn that is
repeated in every column counts once. Output rows hold blocks of ``block_turns``
turns: a pair whose conversations have at most that many is one row (block 0); a
longer one goes on in blocks 1, 2, ..., whose strings follow one another. So no
row, group or task grows with a conversation's length.

A null role renders as ``unknown``, a null text as empty; a null pair id is an id
like any other; a pair with one side only has an empty prefix and one empty
completion; equal sides give two empty completions; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.common import materialise, words

OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"
NUMBER_BLOCK = 64  # turns are numbered in groups of this range of turn values


def number_turns(t: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``pos``, 0-based in (turn, role, text) order per conversation: offsets
    of ranges of ``turn`` plus a row number inside the range."""
    t = t.withColumn("_range", F.floor(F.col("turn") / NUMBER_BLOCK))
    counts = t.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_range").orderBy("turn", "role", "text")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range").eqNullSafe(F.col("_r"))]
    return (t.withColumn("_rn", F.row_number().over(inside))
            .join(offs, on)
            .withColumn("pos", F.col("_off") + F.col("_rn") - 1)
            .drop("_range", "_r", "_off", "_rn", *[f"_k_{k}" for k in keys]))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MID), turn["text"], F.lit(CLOSE))


def _mask(turns: Column) -> Column:
    """Spans [start, end) of the assistant texts in the rendered string of ``turns``."""
    step = F.aggregate(
        turns, F.struct(F.lit(0).cast("long").alias("at"),
                        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(_render(x))).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(F.concat(F.lit(OPEN), x["role"], F.lit(MID)))).alias("start"),
                (acc["at"] + F.length(_render(x)) - len(CLOSE)).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return step["spans"]


def preference_pairs(turns: DataFrame, block_turns: int = 64) -> DataFrame:
    """``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text.

    Returns one row per pair and block: ``pair_id``, ``block``, ``n_prompt``
    (turns of the whole prompt), ``prompt``, ``chosen``, ``chosen_mask``,
    ``rejected``, ``rejected_mask``.
    """
    t = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text")).distinct()
    t = number_turns(t, ["pair_id", "side"]).withColumn("block", F.floor(F.col("pos") / block_turns))
    blocks = t.groupBy("pair_id", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "chosen", F.struct("pos", "role", "text")))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "rejected", F.struct("pos", "role", "text")))).alias("r"))
    blocks = materialise(blocks)  # at most 2 * block_turns turns a row
    # the first position where the sides differ, or where one of them ends
    start = F.col("block") * block_turns
    longest = F.greatest(F.size("c"), F.size("r"))
    same = F.forall(F.sequence(F.lit(0), longest - 1), lambda i: F.coalesce(
        F.get("c", i) == F.get("r", i), F.lit(False)))
    first_diff = F.array_min(F.filter(F.sequence(F.lit(0), longest - 1), lambda i: ~F.coalesce(
        F.get("c", i) == F.get("r", i), F.lit(False))))
    diffs = blocks.select("pair_id", F.when(same, start + longest).otherwise(start + first_diff).alias("at"),
                          same.alias("same"))
    lcp = diffs.groupBy(F.col("pair_id").alias("_p")).agg(
        F.coalesce(F.min(F.when(~F.col("same"), F.col("at"))), F.max("at")).alias("n_prompt"))
    j = blocks.join(lcp, F.col("pair_id").eqNullSafe(F.col("_p"))).drop("_p")

    def after(col):
        return F.filter(col, lambda x: x["pos"] >= F.col("n_prompt"))
    j = (j.withColumn("_cs", after("c")).withColumn("_rs", after("r"))
         .withColumn("_ps", F.filter("c", lambda x: x["pos"] < F.col("n_prompt"))))

    def text(col):
        return F.concat_ws("", F.transform(col, _render))
    return j.select("pair_id", "block", "n_prompt", text("_ps").alias("prompt"),
                    text("_cs").alias("chosen"), _mask(F.col("_cs")).alias("chosen_mask"),
                    text("_rs").alias("rejected"), _mask(F.col("_rs")).alias("rejected_mask"))


def pairs_from_conversations(conv: DataFrame) -> DataFrame:
    """A pair from every conversation: chosen is the conversation itself; rejected
    ends at its last assistant turn, cut to the first half of its words (without
    an assistant turn, it lacks the last turn)."""
    c = conv.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = c.groupBy(F.col("pair_id").alias("_p")).agg(
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_last"),
        F.max("turn").alias("_end"))
    j = c.join(last, F.col("pair_id").eqNullSafe(F.col("_p"))).drop("_p")
    w = words(F.coalesce("text", F.lit("")))
    half = F.concat_ws(" ", F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")))
    is_last = (F.col("turn") == F.col("_last")) & (F.col("role") == "assistant")
    rejected = (j.where(F.coalesce(F.col("turn") <= F.col("_last"), F.col("turn") < F.col("_end"), F.lit(True)))
                .where(F.coalesce((F.col("turn") < F.col("_last")) | is_last, F.lit(True)))
                .withColumn("text", F.when(F.coalesce(is_last, F.lit(False)), half).otherwise(F.col("text"))))
    return (c.withColumn("side", F.lit("chosen"))
            .unionByName(rejected.drop("_last", "_end").withColumn("side", F.lit("rejected"))))


def _spans_text(col: str) -> Column:
    return F.concat_ws(",", F.transform(col, lambda s: F.concat(s["start"].cast("string"), F.lit(":"),
                                                               s["end"].cast("string"))))


def preference_digest(conv: DataFrame) -> DataFrame:
    """The formatted pairs of a conversations table, masks as ``start:end`` texts."""
    p = preference_pairs(pairs_from_conversations(conv))
    return p.select("pair_id", F.col("block").cast("long").alias("block"), F.col("n_prompt").cast("long").alias("n_prompt"),
                    "prompt", "chosen", _spans_text("chosen_mask").alias("chosen_mask"),
                    "rejected", _spans_text("rejected_mask").alias("rejected_mask"))


PREFERENCE_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    role AS raw FROM conversations),
last AS (SELECT pair_id, max(turn) FILTER (raw = 'assistant') AS la, max(turn) AS en FROM c GROUP BY pair_id),
w AS (SELECT c.*, la, en, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    (turn = la AND coalesce(raw = 'assistant', false)) AS is_last
  FROM c JOIN last ON c.pair_id IS NOT DISTINCT FROM last.pair_id),
rej AS (SELECT DISTINCT pair_id, turn, role,
    CASE WHEN is_last THEN array_to_string(ws[1:len(ws) // 2], ' ') ELSE text END AS text
  FROM w WHERE CASE WHEN la IS NULL THEN turn < en ELSE turn < la OR is_last END),
n AS (SELECT side, pair_id, role, text,
    row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) - 1 AS pos
  FROM (SELECT DISTINCT 'chosen' AS side, pair_id, turn, role, text FROM c
        UNION ALL SELECT 'rejected', pair_id, turn, role, text FROM rej)),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
    coalesce(a.role = b.role AND a.text = b.text, false) AS eq
  FROM (SELECT * FROM n WHERE side = 'chosen') a FULL JOIN (SELECT * FROM n WHERE side = 'rejected') b
    ON a.pair_id = b.pair_id AND a.pos = b.pos),
l AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT eq), max(pos) + 1) AS n_prompt FROM j GROUP BY pair_id),
s AS (SELECT n.*, n_prompt, pos // 64 AS block,
    CASE WHEN pos < n_prompt THEN 'prompt' ELSE side END AS part,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r,
    length('<|' || role || '|>' || chr(10)) AS h
  FROM n JOIN l USING (pair_id) WHERE side = 'chosen' OR pos >= n_prompt),
o AS (SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY pair_id, block, part ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o0 FROM s),
g AS (SELECT pair_id, block, part, string_agg(r, '' ORDER BY pos) AS txt,
    string_agg(CASE WHEN role = 'assistant' THEN concat((o0 + h)::BIGINT, ':', (o0 + h + length(text))::BIGINT) END, ','
      ORDER BY pos) AS mask
  FROM o GROUP BY ALL)
SELECT b.pair_id, b.block::BIGINT AS block, l.n_prompt::BIGINT AS n_prompt, coalesce(p.txt, '') AS prompt,
  coalesce(x.txt, '') AS chosen, coalesce(x.mask, '') AS chosen_mask,
  coalesce(y.txt, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM (SELECT DISTINCT pair_id, pos // 64 AS block FROM n) b JOIN l USING (pair_id)
LEFT JOIN g p ON p.pair_id = b.pair_id AND p.block = b.block AND p.part = 'prompt'
LEFT JOIN g x ON x.pair_id = b.pair_id AND x.block = b.block AND x.part = 'chosen'
LEFT JOIN g y ON y.pair_id = b.pair_id AND y.block = b.block AND y.part = 'rejected'
"""
