"""Registered queries of the operators, with their SQL checks where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.llm import (bm25_search, chat, jaccard_join, line_dedup, lm_bloom, mixing, packing, periodic_runs,
                           phrases, quality_rules, rule_ensemble, sharding, toxicity)
from vecfactor.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_length_buckets")
def op1(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op2_preference_format", chat.PREFERENCE_SQL)
def op2(spark, sf_dir):
    return chat.preference_digest(table(spark, sf_dir, "conversations"))


@register("op3_mix_sources", mixing.mix_sql())
def op3(spark, sf_dir):
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("prob", F.round("prob", 9))


# the statistics in SQL; the rules beyond the base ones as the operator's parameters state them
QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
    regexp_replace(t, '[^A-Z]+', '', 'g') AS up, regexp_replace(t, '[^A-Za-z]+', '', 'g') AS le FROM t),
k AS (SELECT row_number() OVER () AS rid, * FROM w),
tri AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM k)),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE c > 1) GROUP BY rid),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ln) AS n_lines, length(up) AS nu, length(le) AS nl
  FROM k LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words
    OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (nl >= 20 AND 100 * nu > 60 * nl)) AS kept
FROM b"""


@register("op4_quality_rules", QUALITY_SQL)
def op4(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


@register("op5_rule_ensemble")
def op5(spark, sf_dir):
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_jaccard_join")
def op6(spark, sf_dir):
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), jaccard_join.CONTRACT)


@register("op7_lm_bloom")
def op7(spark, sf_dir):
    return lm_bloom.lm_scores(table(spark, sf_dir, "documents"))


@register("op8_block_max_bm25")
def op8(spark, sf_dir):
    return bm25_search.search_documents(table(spark, sf_dir, "documents"))


@register("op9_toxicity_lexicon")
def op9(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_ring_shards")
def op10(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents),
l AS (SELECT rid, unnest(range(len(ln))) AS pos, unnest(ln) AS line FROM d),
k AS (SELECT rid, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
    '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
r AS (SELECT rid, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM r JOIN d USING (rid)"""


@register("op11_line_runs", LINE_SQL)
def op11(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    runs = line_dedup.LineRuns(spark, min_docs=10, fanout=2)
    for name, batch in line_dedup.batches_of(spark, path):
        runs.add(batch, name)
    return line_dedup.line_digest(line_dedup.drop_lines(spark.read.parquet(path), runs.settled()))


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


PHRASE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, w FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM x),
u AS (SELECT lang, w1 AS w, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM u GROUP BY lang),
b AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
bs AS (SELECT b.lang, w1, w2, a, f.n AS l, s.n AS r, ((1000000::HUGEINT * a * a) // (f.n::HUGEINT * s.n)) AS score
  FROM b JOIN u f ON f.lang = b.lang AND f.w = w1 JOIN u s ON s.lang = b.lang AND s.w = w2),
cc AS (SELECT c.*, h.l AS l1, t.a AS r1, h.a AS l2, t.r AS r2,
    (1000000::HUGEINT * c.a * c.a) // (h.l::HUGEINT * t.a) AS s1,
    (1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.r) AS s2
  FROM c JOIN bs h ON h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2
  JOIN bs t ON t.lang = c.lang AND t.w1 = c.w2 AND t.w2 = c.w3),
ins AS (SELECT lang, w1, w2, max(a) AS longer FROM (
  SELECT lang, w1, w2, a FROM c UNION ALL SELECT lang, w2, w3, a FROM c) GROUP BY ALL),
al AS (SELECT bs.lang, w1 || ' ' || w2 AS phrase, a, l, r, score FROM bs LEFT JOIN ins USING (lang, w1, w2)
    WHERE longer IS NULL OR 100 * longer < 50 * a
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END,
    CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cc),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM al)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM k JOIN t USING (lang) WHERE rank <= 2000"""


@register("op12_phrases", PHRASE_SQL)
def op12(spark, sf_dir):
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))
