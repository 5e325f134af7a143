"""Equivalent SQL (DuckDB dialect) for the registered queries.

These are independent re-derivations of each result from the raw tables,
written as plain SQL, used by the driver to cross-check the Spark jobs.
"""

from __future__ import annotations

from vecfactor.functions.text import EMAIL_PATTERN, PUNCTUATION, STOP_WORDS_EN, URL_PREFIXES


def sql_str(s: str) -> str:
    if s in ("\n", "\t", " "):
        return f"chr({ord(s)})"
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(sql_str(v) for v in values)


STOP_SQL = f"word IN ({_in_list(STOP_WORDS_EN)})"
PUNCT_SQL = f"word IN ({_in_list(PUNCTUATION)})"
URL_SQL = "(" + " OR ".join(f"starts_with(lower(word), {sql_str(p)})" for p in URL_PREFIXES) + ")"
EMAIL_SQL = f"regexp_matches(word, {sql_str(EMAIL_PATTERN)})"
KEEP_SQL = f"NOT ({STOP_SQL} OR {PUNCT_SQL} OR {URL_SQL} OR {EMAIL_SQL})"

# one row per document: the non-empty tokens of its text
LISTS_CTE = """
lists AS (
  SELECT doc_id AS list_id,
         list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS words
  FROM documents
)"""

TOKENS_CTE = LISTS_CTE + """,
tok AS (
  SELECT list_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM lists
)"""

VOCAB_CTE = TOKENS_CTE + """,
cnt AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word),
rk AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS word_idx FROM cnt),
vocab AS (
  SELECT rk.word, rk.word_idx, e.embedding AS vec
  FROM rk JOIN embeddings e ON e.vec_id = rk.word_idx
)"""

# filtered lists (kept tokens, positions renumbered inside the kept array)
FILTERED_CTE = VOCAB_CTE + f""",
flists AS (
  SELECT list_id, coalesce(list_filter(words, lambda word: {KEEP_SQL}), []) AS words FROM lists
),
ftok AS (
  SELECT list_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM flists
),
known AS (
  SELECT f.list_id, f.pos, f.word, v.word_idx, v.vec FROM ftok f JOIN vocab v USING (word)
),
cdim AS (
  SELECT list_id, dim, avg(x) AS value FROM (
    SELECT list_id, unnest(range(len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM known
  ) GROUP BY list_id, dim
),
cen AS (SELECT list_id, list(value ORDER BY dim) AS c FROM cdim GROUP BY list_id)"""

RATINGS_CTE = """
ev AS (
  SELECT user_id::INTEGER AS "user", json_extract_string(props, '$.k')::INTEGER AS item,
         value::DOUBLE AS rating, ts, event_id, event_type
  FROM events
),
ratings AS (
  SELECT "user", item, arg_max(rating, {'t': ts, 'e': event_id}) AS rating
  FROM ev GROUP BY "user", item
)"""

# fixed factors: user u -> embedding u mod N, item i -> embedding N-1-i
FACTORS_CTE = RATINGS_CTE + """,
nemb AS (SELECT count(*) AS n FROM embeddings),
uf AS (
  SELECT u.id, e.embedding AS features
  FROM (SELECT DISTINCT "user" AS id FROM ratings) u, nemb
  JOIN embeddings e ON e.vec_id = ((u.id::BIGINT % nemb.n) + nemb.n) % nemb.n
),
itf AS (
  SELECT i.id, e.embedding AS features
  FROM (SELECT DISTINCT item AS id FROM ratings) i, nemb
  JOIN embeddings e ON e.vec_id = nemb.n - 1 - i.id::BIGINT
),
pred AS (
  SELECT r."user", r.item, r.rating,
         list_sum(list_transform(range(1, len(a.features) + 1),
                  lambda k: a.features[k]::DOUBLE * b.features[k]::DOUBLE)) AS prediction
  FROM ratings r JOIN uf a ON a.id = r."user" JOIN itf b ON b.id = r.item
)"""


def with_(cte: str, body: str) -> str:
    return "WITH " + cte.strip() + "\n" + body.strip()
