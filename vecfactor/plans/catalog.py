"""Registered queries: one per operator of the inventory, each with its SQL check.

Every query reads the driver tables (or data Spark derives from them) whole.
Doubles are rounded to 6 places on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.functions import text as T
from vecfactor.functions.vectors import dot
from vecfactor.operators import batch_als
from vecfactor.operators import centers as C
from vecfactor.operators import factors as MF
from vecfactor.operators.nearest import nearest_k_words, nearest_words
from vecfactor.plans import fixtures as FX
from vecfactor.plans import oracle as O
from vecfactor.session import shared_path
from vecfactor.sources import payloads as P
from vecfactor.sources.store import ModelStore, train_and_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the vocabulary is read by the size check and by the job itself: computed once, and
    # as Parquet in the shared folder, so that jobs read only the columns they need
    return C.save_vocabulary(FX.vocabulary(spark, sf_dir), shared_path(spark, "vocabulary"))


def _used_centers(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    # centres and each list's matched words in one pass, kept in the shared folder: as compressed
    # Parquet, a checkpoint holds every number of a word in eight bytes
    path = shared_path(spark, "centers")
    C.centers(FX.word_lists(spark, sf_dir), vocab, with_used=True).where(F.col("center").isNotNull()) \
        .write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _flists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filtered_lists(FX.word_lists(spark, sf_dir))


# ----------------------------------------------------------------- S3: word lists

@register("word_lists", O.with_(O.TOKENS_CTE, "SELECT list_id, pos, word FROM tok"))
def q_word_lists(spark, sf_dir):
    return FX.list_tokens(FX.word_lists(spark, sf_dir))


# ----------------------------------------------------------------- F6-F10: filters

@register("filter_stop_words", O.with_(O.TOKENS_CTE, f"""
SELECT word, count(*) AS n FROM tok WHERE {O.STOP_SQL} GROUP BY word"""))
def q_filter_stop_words(spark, sf_dir):
    tok = FX.list_tokens(FX.word_lists(spark, sf_dir))
    return tok.where(T.is_stop_word("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@register("filter_punct", O.with_(O.TOKENS_CTE, f"""
SELECT word, count(*) AS n FROM tok WHERE {O.PUNCT_SQL} GROUP BY word"""))
def q_filter_punct(spark, sf_dir):
    tok = FX.list_tokens(FX.word_lists(spark, sf_dir))
    return tok.where(T.is_punctuation("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_URL_TOKENS_SQL = """
urls AS (
  SELECT page_id, 'raw' AS variant, url AS word FROM pages
  UNION ALL SELECT page_id, 'upper', upper(url) FROM pages
  UNION ALL SELECT page_id, 'host', regexp_replace(url, '^[a-z]+://', '') FROM pages
  UNION ALL SELECT page_id, 'www', 'www.' || regexp_replace(url, '^[a-z]+://', '') FROM pages
)"""


@register("is_url", O.with_(_URL_TOKENS_SQL + "," + O.TOKENS_CTE, f"""
SELECT page_id AS id, variant, word, {O.URL_SQL} AS is_url FROM urls
UNION ALL
SELECT list_id AS id, 'doc' AS variant, word, true AS is_url FROM tok WHERE {O.URL_SQL}"""))
def q_is_url(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages")
    host = F.regexp_replace("url", "^[a-z]+://", "")
    urls = (pages.select("page_id", F.lit("raw").alias("variant"), F.col("url").alias("word"))
            .unionByName(pages.select("page_id", F.lit("upper").alias("variant"), F.upper("url").alias("word")))
            .unionByName(pages.select("page_id", F.lit("host").alias("variant"), host.alias("word")))
            .unionByName(pages.select("page_id", F.lit("www").alias("variant"),
                                      F.concat(F.lit("www."), host).alias("word"))))
    a = urls.select(F.col("page_id").alias("id"), "variant", "word", T.is_url("word").alias("is_url"))
    tok = FX.list_tokens(FX.word_lists(spark, sf_dir))
    b = tok.where(T.is_url("word")).select(F.col("list_id").alias("id"), F.lit("doc").alias("variant"),
                                           "word", F.lit(True).alias("is_url"))
    return a.unionByName(b)


@register("is_email", O.with_(O.TOKENS_CTE, f"""
SELECT list_id, pos, word, {O.EMAIL_SQL} AS is_email FROM tok WHERE contains(word, '@')"""))
def q_is_email(spark, sf_dir):
    tok = FX.list_tokens(FX.word_lists(spark, sf_dir))
    return tok.where(F.col("word").contains("@")).select(
        "list_id", "pos", "word", T.is_email("word").alias("is_email"))


@register("filter_words", O.with_(O.FILTERED_CTE, "SELECT list_id, pos, word FROM ftok"))
def q_filter_words(spark, sf_dir):
    return FX.list_tokens(_flists(spark, sf_dir))


# ----------------------------------------------------------------- S5: vector store properties

@register("vector_props", O.with_(O.VOCAB_CTE, """
SELECT count(*) AS n_words, max(len(vec)) AS dim, min(len(vec)) AS min_dim FROM vocab"""))
def q_vector_props(spark, sf_dir):
    v = FX.vocabulary(spark, sf_dir)
    return v.agg(F.count(F.lit(1)).alias("n_words"), F.max(F.size("vec")).cast("long").alias("dim"),
                 F.min(F.size("vec")).cast("long").alias("min_dim"))


@register("vocab_dedup", O.with_(O.VOCAB_CTE, """
SELECT word, word_idx, list_transform(vec, lambda x: round(x::DOUBLE, 6) + 0.0) AS vec FROM vocab"""))
def q_vocab_dedup(spark, sf_dir):
    """J1's first-match rule on a vector table with every word twice: the
    copy after the original in file order (index + N, another vector) must
    lose."""
    v = FX.vocabulary(spark, sf_dir)
    emb = FX.table(spark, sf_dir, "embeddings")
    n = emb.count()
    dup = (v.select("word", (F.col("word_idx") + F.lit(n)).alias("word_idx"),
                    (F.lit(n - 1) - F.col("word_idx")).alias("vec_id"))
           .join(emb, "vec_id").select("word", "word_idx", F.col("embedding").alias("vec")))
    d = C.dedup_vocabulary(dup.unionByName(v))
    return d.select("word", "word_idx", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


# ----------------------------------------------------------------- J1, F11, A2

@register("word_lookup", O.with_(O.FILTERED_CTE, "SELECT list_id, pos, word, word_idx FROM known"))
def q_word_lookup(spark, sf_dir):
    return C.lookup_words(_flists(spark, sf_dir), _vocab(spark, sf_dir))


@register("known_counts", O.with_(O.FILTERED_CTE, """
SELECT f.list_id, len(f.words)::BIGINT AS n_words, count(k.word)::BIGINT AS n_known
FROM flists f LEFT JOIN known k ON k.list_id = f.list_id
GROUP BY f.list_id, f.words"""))
def q_known_counts(spark, sf_dir):
    return C.known_counts(FX.word_lists(spark, sf_dir), _vocab(spark, sf_dir))


# ----------------------------------------------------------------- A1: centre

@register("word_center", O.with_(O.FILTERED_CTE, """
SELECT list_id, dim::BIGINT AS dim, round(value, 6) + 0.0 AS value FROM cdim"""))
def q_word_center(spark, sf_dir):
    cen = C.centers(FX.word_lists(spark, sf_dir), _vocab(spark, sf_dir))
    return C.center_rows(cen).select("list_id", F.col("dim").cast("long").alias("dim"), _r6("value"))


# ----------------------------------------------------------------- S10: centre as JSON text

@register("center_json", O.with_(O.FILTERED_CTE, """
SELECT list_id,
       '[' || array_to_string(list_transform(list(value ORDER BY dim),
                                             lambda x: printf('%.6f', round(x, 6) + 0.0)), ',') || ']'
         AS center_json
FROM cdim GROUP BY list_id"""))
def q_center_json(spark, sf_dir):
    cen = C.centers(FX.word_lists(spark, sf_dir), _vocab(spark, sf_dir))
    return C.center_json(cen.where(F.col("center").isNotNull()), decimals=6)


# ----------------------------------------------------------------- J2, J3, A4: nearest word

@register("nearest_word", O.with_(O.FILTERED_CTE + """,
used AS (SELECT DISTINCT list_id, word_idx FROM known),
dist AS (
  SELECT c.list_id, v.word, v.word_idx,
         list_sum(list_transform(range(1, len(c.c) + 1),
                  lambda i: (c.c[i] - v.vec[i]::DOUBLE) * (c.c[i] - v.vec[i]::DOUBLE))) AS d
  FROM cen c, vocab v
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.list_id = c.list_id AND u.word_idx = v.word_idx)
)""", """
SELECT list_id, arg_min(word, {'d': d, 'i': word_idx}) AS nearest_word,
       round(min(d), 6) AS nearest_sq_distance
FROM dist WHERE d < 999999 GROUP BY list_id"""))
def q_nearest_word(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    nn = nearest_words(_used_centers(spark, sf_dir, vocab), vocab)
    return nn.select("list_id", "nearest_word", _r6("nearest_sq_distance"))


NEAREST_K = 3  # the survey's free top-k parameter; the service itself returned top-1


@register("nearest_k", O.with_(O.FILTERED_CTE + """,
used AS (SELECT DISTINCT list_id, word_idx FROM known),
dist AS (
  SELECT c.list_id, v.word, v.word_idx,
         list_sum(list_transform(range(1, len(c.c) + 1),
                  lambda i: (c.c[i] - v.vec[i]::DOUBLE) * (c.c[i] - v.vec[i]::DOUBLE))) AS d
  FROM cen c, vocab v
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.list_id = c.list_id AND u.word_idx = v.word_idx)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY d, word_idx) AS rank
  FROM dist WHERE d < 999999
)""", f"""
SELECT list_id, rank, word, round(d, 6) AS sq_distance FROM ranked WHERE rank <= {NEAREST_K}"""))
def q_nearest_k(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    nn = nearest_k_words(_used_centers(spark, sf_dir, vocab), vocab, NEAREST_K)
    return nn.select("list_id", F.col("rank").cast("long").alias("rank"), "word", _r6("sq_distance"))


# ----------------------------------------------------------------- S1, S2, F1-F5, A5: uploads


_UPLOADS_SQL = O.RATINGS_CTE + """,
up AS (
  SELECT 'u' || "user" || '-' || (item // 50) AS upload_id, "user", count(*) AS n
  FROM ratings GROUP BY ALL
)"""


@register("uploads_validate", O.with_(_UPLOADS_SQL, """
SELECT upload_id, 'm' || "user" AS model_name,
       CASE "user" % 7 WHEN 1 THEN 'Missing fields [''iterations'', ''lambda'']'
                       WHEN 2 THEN 'Invalid json' WHEN 3 THEN 'Rating data invalid'
                       WHEN 5 THEN 'Invalid data types' WHEN 6 THEN 'Empty ratings' END AS reason,
       CASE WHEN "user" % 7 IN (0, 4) THEN 3 END AS rank,
       CASE WHEN "user" % 7 IN (0, 4) THEN 5 END AS iterations,
       CASE WHEN "user" % 7 IN (0, 4) THEN 0.1::DOUBLE END AS reg,
       CASE WHEN "user" % 7 IN (0, 4) THEN n ELSE 0 END::BIGINT AS n_ratings
FROM up"""))
def q_uploads_validate(spark, sf_dir):
    parsed = P.parse_uploads(FX.rating_uploads(spark, sf_dir))
    return parsed.select("upload_id", "model_name", "reason", "rank", "iterations", "reg", "n_ratings")


@register("ratings_flatten", O.with_(O.RATINGS_CTE, """
SELECT 'u' || "user" || '-' || (item // 50) AS upload_id, "user", item, rating
FROM ratings WHERE "user" % 7 IN (0, 4)"""))
def q_ratings_flatten(spark, sf_dir):
    parsed = P.parse_uploads(FX.rating_uploads(spark, sf_dir))
    return P.flatten_ratings(parsed).select("upload_id", "user", "item", "rating")


@register("ratings_last_wins", O.with_(O.RATINGS_CTE.split(",\nratings AS")[0] + """,
d AS (SELECT "user", item, rating, ts, event_id, ts::DATE AS day, hour(ts) // 2 AS slot,
             floor(event_id / 4096)::BIGINT AS eblk,
             hour(ts) % 2 = 1 AS second FROM ev),
g AS (SELECT "user", day, slot, eblk, bool_or(second) AS has_second FROM d GROUP BY ALL)""", """
SELECT 'd' || d."user" || '-' || strftime(d.day, '%Y%m%d') || '-' || d.slot || '-' || d.eblk AS upload_id,
       d."user", d.item,
       arg_max(d.rating, {'t': d.ts, 'e': d.event_id}) AS rating
FROM d JOIN g ON g."user" = d."user" AND g.day = d.day AND g.slot = d.slot AND g.eblk = d.eblk
WHERE d.second = g.has_second
GROUP BY ALL"""))
def q_ratings_last_wins(spark, sf_dir):
    parsed = P.parse_uploads(FX.duplicate_key_uploads(spark, sf_dir))
    return P.flatten_ratings(parsed).select("upload_id", "user", "item", "rating")


@register("word_payloads", O.with_(O.LISTS_CTE, """
SELECT list_id, CASE WHEN list_id % 10 = 3 THEN NULL ELSE len(words) END::BIGINT AS n_words,
       CASE WHEN list_id % 10 = 3 THEN 'Invalid json' END AS reason
FROM lists"""))
def q_word_payloads(spark, sf_dir):
    parsed = P.parse_word_lists(FX.word_payloads(spark, sf_dir))
    return parsed.select("list_id", F.size("words").cast("long").alias("n_words"), "reason") \
        .withColumn("n_words", F.when(F.col("reason").isNull(), F.col("n_words")))


# ----------------------------------------------------------------- J4, M5, A3, M6: scoring


def _fixed_scored(spark, sf_dir):
    r = FX.ratings(spark, sf_dir)
    uf = FX.fixed_factors(spark, sf_dir, r.select(F.col("user").alias("id")), "user")
    itf = FX.fixed_factors(spark, sf_dir, r.select(F.col("item").alias("id")), "item")
    return MF.score_pairs(r, uf, itf)


@register("predict_pairs", O.with_(O.FACTORS_CTE, """
SELECT "user", item, rating, round(prediction, 6) + 0.0 AS prediction FROM pred"""))
def q_predict_pairs(spark, sf_dir):
    s = _fixed_scored(spark, sf_dir).where("known")
    return s.select("user", "item", "rating", _r6("prediction"))


@register("mse", O.with_(O.FACTORS_CTE, """
SELECT count(*)::BIGINT AS n, 0::BIGINT AS n_unknown,
       round(avg((rating - prediction) * (rating - prediction)), 6) AS mse FROM pred"""))
def q_mse(spark, sf_dir):
    m = MF.mse(_fixed_scored(spark, sf_dir))
    return m.select("n", "n_unknown", _r6("mse"))


@register("squared_errors", O.with_(O.FACTORS_CTE, """
SELECT "user", item, round((rating - prediction) * (rating - prediction), 6) AS se FROM pred"""))
def q_squared_errors(spark, sf_dir):
    return MF.squared_errors(_fixed_scored(spark, sf_dir)).select("user", "item", _r6("se"))


# ----------------------------------------------------------------- M1, M2, M4: ALS

ALS_RANK, ALS_ITERATIONS, ALS_REG = 8, 10, 0.1
MAX_RESIDUAL = 1e-4  # of the normal equations, in units of their terms (factors are floats)


def _als(spark, sf_dir):
    return MF.train(FX.ratings(spark, sf_dir), ALS_RANK, ALS_ITERATIONS, ALS_REG)


@register("als_factors", O.with_(O.RATINGS_CTE, f"""
SELECT 'user' AS kind, "user" AS id, {ALS_RANK}::BIGINT AS n_features FROM ratings GROUP BY "user"
UNION ALL
SELECT 'item' AS kind, item AS id, {ALS_RANK}::BIGINT AS n_features FROM ratings GROUP BY item"""))
def q_als_factors(spark, sf_dir):
    model = _als(spark, sf_dir)
    u = MF.user_factors(model).select(F.lit("user").alias("kind"), "id",
                                      F.size("features").cast("long").alias("n_features"))
    i = MF.item_factors(model).select(F.lit("item").alias("kind"), "id",
                                      F.size("features").cast("long").alias("n_features"))
    return u.unionByName(i)


def _als_long(spark, sf_dir):
    """The trained model once, as ``model_name, kind, id, features``."""
    model = _als(spark, sf_dir)
    return (MF.user_factors(model).select(F.lit("m").alias("model_name"), F.lit("user").alias("kind"), "id", "features")
            .unionByName(MF.item_factors(model).select(F.lit("m").alias("model_name"), F.lit("item").alias("kind"),
                                                       "id", "features"))).checkpoint(eager=True)


@register("als_normal_eq", O.with_(O.RATINGS_CTE, """
SELECT "user" AS id, count(*)::BIGINT AS n, true AS solved FROM ratings GROUP BY "user\""""))
def q_als_normal_eq(spark, sf_dir):
    """Trained values: every user's factors solve their normal equations (the side solved last)."""
    r = FX.ratings(spark, sf_dir).withColumn("model_name", F.lit("m")).withColumn("reg", F.lit(ALS_REG))
    res = batch_als.normal_residuals(r, _als_long(spark, sf_dir))
    return res.select("id", "n", (F.col("residual") < MAX_RESIDUAL).alias("solved"))


@register("als_mse", O.with_(O.RATINGS_CTE, """
SELECT count(*)::BIGINT AS n, 0::BIGINT AS n_unknown, true AS closed_form, true AS below_variance FROM ratings"""))
def q_als_mse(spark, sf_dir):
    """The trained model's MSE, held against the value that its normal equations imply:
    ``sum (r - p)^2 = sum r^2 - sum r p - reg sum n |u|^2`` once every user is solved."""
    r = FX.ratings(spark, sf_dir)
    f = _als_long(spark, sf_dir)
    uf, itf = (f.where(F.col("kind") == k).select("id", "features") for k in ("user", "item"))
    scored = MF.score_pairs(r, uf, itf).checkpoint(eager=True)
    norms = uf.select(F.col("id").alias("user"), dot("features", "features").alias("uu"))
    sums = scored.join(norms, "user").agg(
        F.count("prediction").alias("n"),
        F.sum(F.col("rating") * F.col("rating")).alias("rr"), F.sum(F.col("rating") * F.col("prediction")).alias("rp"),
        F.sum("uu").alias("nuu"), F.var_pop("rating").alias("variance"))
    m = MF.mse(scored).join(sums, "n")       # one row each; both count the same pairs
    implied = (F.col("rr") - F.col("rp") - ALS_REG * F.col("nuu")) / F.col("n")
    return m.select("n", "n_unknown",
                    (F.abs(F.col("mse") - implied) < 1e-4 * F.col("rr") / F.col("n")).alias("closed_form"),
                    (F.col("mse") < F.col("variance")).alias("below_variance"))


# ----------------------------------------------------------------- S6-S9, S11, M3, M7: model store


def _typed_batch(spark, sf_dir, half):
    """Factors + meta for one model per event type, trained on one half."""
    r = FX.typed_ratings(spark, sf_dir, half)
    keyed = (r.select("model_name", F.lit("user").alias("kind"), F.col("user").alias("id"))
             .unionByName(r.select("model_name", F.lit("item").alias("kind"), F.col("item").alias("id"))))
    factors = FX.keyed_fixed_factors(spark, sf_dir, keyed)
    dim = FX.table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    meta = r.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_ratings")).select(
        "model_name", F.lit(dim).alias("rank"), F.lit(0).alias("iterations"),
        F.lit(0.0).alias("reg"), "n_ratings")
    return factors, meta


def build_store(spark, sf_dir) -> ModelStore:
    """Save every event type's model on the first half, re-save all but the
    's' types on the second half, evaluate on all ratings, delete the 'e'
    types (and try their upper-case names, which do not exist), evaluate
    again on the second half."""
    st = ModelStore(spark, shared_path(spark, "store"))
    f1, m1 = _typed_batch(spark, sf_dir, 1)
    st.save(f1, m1)
    f2, m2 = _typed_batch(spark, sf_dir, 2)
    keep = ~F.col("model_name").startswith("s")
    st.save(f2.where(keep), m2.where(keep))
    st.evaluate(FX.typed_ratings(spark, sf_dir, None))
    names = FX.table(spark, sf_dir, "events").select(F.col("event_type").alias("model_name")).distinct()
    gone = names.where(F.col("model_name").startswith("e"))
    st.delete(gone.unionByName(gone.select(F.upper("model_name").alias("model_name"))))
    st.evaluate(FX.typed_ratings(spark, sf_dir, 2))
    return st


_HALF = """
ev1 AS (SELECT *, ts < TIMESTAMP '2024-01-16 00:00:00' AS h1 FROM ev),
t1 AS (SELECT event_type AS model_name, "user", item, arg_max(rating, {'t': ts, 'e': event_id}) AS rating
       FROM ev1 WHERE h1 GROUP BY ALL),
t2 AS (SELECT event_type AS model_name, "user", item, arg_max(rating, {'t': ts, 'e': event_id}) AS rating
       FROM ev1 WHERE NOT h1 GROUP BY ALL),
dim AS (SELECT max(len(embedding)) AS d FROM embeddings),
live AS (
  SELECT model_name, 2::BIGINT AS version FROM (SELECT DISTINCT model_name FROM t2)
  WHERE NOT starts_with(model_name, 's') AND NOT starts_with(model_name, 'e')
  UNION ALL
  SELECT model_name, 1::BIGINT FROM (SELECT DISTINCT model_name FROM t1) WHERE starts_with(model_name, 's')
),
train AS (
  SELECT l.model_name, l.version, t."user", t.item, t.rating FROM live l JOIN t1 t USING (model_name) WHERE l.version = 1
  UNION ALL
  SELECT l.model_name, l.version, t."user", t.item, t.rating FROM live l JOIN t2 t USING (model_name) WHERE l.version = 2
),
nemb AS (SELECT count(*) AS n FROM embeddings),
fac AS (
  SELECT DISTINCT model_name, version, 'user' AS kind, "user" AS id FROM train
  UNION ALL SELECT DISTINCT model_name, version, 'item' AS kind, item AS id FROM train
),
facv AS (
  SELECT f.*, e.embedding AS features FROM fac f, nemb
  JOIN embeddings e ON e.vec_id = CASE WHEN f.kind = 'user' THEN ((f.id::BIGINT % nemb.n) + nemb.n) % nemb.n
                                       ELSE nemb.n - 1 - f.id::BIGINT END
)"""
_STORE_CTE = O.RATINGS_CTE.split(",\nratings AS")[0] + "," + _HALF


@register("store_latest", O.with_(_STORE_CTE, """
SELECT l.model_name, l.version, d.d::INTEGER AS rank, count(*)::BIGINT AS n_ratings
FROM live l JOIN train t ON t.model_name = l.model_name, dim d
GROUP BY l.model_name, l.version, d.d"""))
def q_store_latest(spark, sf_dir):
    st = build_store(spark, sf_dir)
    return st.latest().select("model_name", "version", "rank", "n_ratings")


@register("features_long", O.with_(_STORE_CTE, """
SELECT model_name, version, kind, id::INTEGER AS id,
       list_transform(features, lambda x: round(x::DOUBLE, 6) + 0.0) AS features
FROM facv"""))
def q_features_long(spark, sf_dir):
    st = build_store(spark, sf_dir)
    f = st.features()
    return f.select("model_name", "version", "kind", "id",
                    F.transform("features", lambda x: F.round(x.cast("double"), 6)).alias("features"))


def _doc_part(kind):
    return (f"coalesce(string_agg(CASE WHEN kind = '{kind}' THEN '\"' || id || '\": [' || "
            "array_to_string(list_transform(features, lambda x: printf('%.6f', round(x::DOUBLE, 6) + 0.0)), ', ')"
            " || ']' END, ', ' ORDER BY id), '')")


@register("features_json", O.with_(_STORE_CTE, f"""
SELECT model_name, version, floor(id / 4096)::BIGINT AS blk,
       '{{"userFeatures": {{' || {_doc_part('user')} || '}}, "productFeatures": {{' || {_doc_part('item')} || '}}}}'
         AS document
FROM facv GROUP BY model_name, version, floor(id / 4096)::BIGINT"""))
def q_features_json(spark, sf_dir):
    return build_store(spark, sf_dir).features_json(decimals=6)


@register("eval_latest", O.with_(_STORE_CTE + """,
test AS (SELECT * FROM t2),
uf AS (SELECT model_name, version, id AS "user", features AS uf FROM facv WHERE kind = 'user'),
itf AS (SELECT model_name, version, id AS item, features AS itf FROM facv WHERE kind = 'item'),
sc AS (
  SELECT l.model_name, l.version, t.rating, u.uf, i.itf,
         CASE WHEN u.uf IS NOT NULL AND i.itf IS NOT NULL THEN
           list_sum(list_transform(range(1, len(u.uf) + 1), lambda k: u.uf[k]::DOUBLE * i.itf[k]::DOUBLE))
         END AS p
  FROM live l JOIN test t ON t.model_name = l.model_name
  LEFT JOIN uf u ON u.model_name = l.model_name AND u.version = l.version AND u."user" = t."user"
  LEFT JOIN itf i ON i.model_name = l.model_name AND i.version = l.version AND i.item = t.item
)""", """
SELECT model_name, version, count(p)::BIGINT AS n, (count(*) - count(p))::BIGINT AS n_unknown,
       round(avg((rating - p) * (rating - p)), 6) AS mse
FROM sc GROUP BY model_name, version"""))
def q_eval_latest(spark, sf_dir):
    st = build_store(spark, sf_dir)
    return st.latest_evaluations().select("model_name", "version", "n", "n_unknown", _r6("mse"))


@register("store_delete", O.with_(O.RATINGS_CTE.split(",\nratings AS")[0], """
SELECT DISTINCT event_type AS model_name, true AS deleted FROM ev WHERE starts_with(event_type, 'e')
UNION ALL
SELECT DISTINCT upper(event_type), false FROM ev WHERE starts_with(event_type, 'e')"""))
def q_store_delete(spark, sf_dir):
    st = ModelStore(spark, shared_path(spark, "store"))
    f1, m1 = _typed_batch(spark, sf_dir, 1)
    st.save(f1, m1)
    names = FX.table(spark, sf_dir, "events").select(F.col("event_type").alias("model_name")).distinct()
    gone = names.where(F.col("model_name").startswith("e"))
    return st.delete(gone.unionByName(gone.select(F.upper("model_name").alias("model_name"))))


@register("store_vacuum", O.with_(_STORE_CTE, """
SELECT m.model_name, 2::BIGINT AS version, m.n_ids,
       (SELECT count(DISTINCT starts_with(model_name, 's')) FROM live) AS folders,
       (SELECT count(DISTINCT event_type) FROM ev) AS index_rows
FROM (SELECT model_name, count(*) AS n_ids FROM fac GROUP BY model_name) m"""))
def q_store_vacuum(spark, sf_dir):
    """The store of ``build_store`` with its 's' types saved again, so that no model of the first save is live;
    vacuumed without retention, twice, as merged files go one vacuum later."""
    st = build_store(spark, sf_dir)
    f1, m1 = _typed_batch(spark, sf_dir, 1)
    again = F.col("model_name").startswith("s")
    st.save(f1.where(again), m1.where(again))
    st.vacuum(0.0)
    st.vacuum(0.0)
    folders = st.factors().agg(F.count_distinct("attempt")).first()[0]
    index_rows = spark.read.parquet(st.index_path).count()
    return st.features().groupBy("model_name", "version").agg(F.count(F.lit(1)).alias("n_ids")).select(
        "model_name", "version", "n_ids", F.lit(folders).cast("long").alias("folders"),
        F.lit(index_rows).cast("long").alias("index_rows"))


# ----------------------------------------------------------------- F12, X3: model names

@register("model_names", """
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, string_split(c_name, '/')[-1] AS last_piece,
       regexp_matches(c_name, '^[0-9A-Za-z_-]+$') AS valid FROM customer
UNION ALL
SELECT 'page', page_id, url, string_split(url, '/')[-1],
       regexp_matches(url, '^[0-9A-Za-z_-]+$') FROM pages
UNION ALL
SELECT 'page_piece', page_id, string_split(url, '/')[-1], string_split(string_split(url, '/')[-1], '/')[-1],
       regexp_matches(string_split(url, '/')[-1], '^[0-9A-Za-z_-]+$') FROM pages""")
def q_model_names(spark, sf_dir):
    from vecfactor.functions.names import last_path_piece, valid_name
    cust = FX.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    pages = FX.table(spark, sf_dir, "pages")
    pg = pages.select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    pc = pages.select(F.lit("page_piece").alias("source"), F.col("page_id").alias("id"),
                      last_path_piece("url").alias("name"))
    alln = cust.unionByName(pg).unionByName(pc)
    return alln.select("source", "id", "name", last_path_piece("name").alias("last_piece"),
                       valid_name("name").alias("valid"))


# ----------------------------------------------------------------- S4: binary vector files

@register("w2v_import", O.with_(O.VOCAB_CTE, """
SELECT word, word_idx, list_transform(vec, lambda x: round(x::DOUBLE, 6) + 0.0) AS vec FROM vocab"""))
def q_w2v_import(spark, sf_dir):
    """Vector files that repeat every word once more with another vector, imported: the first
    vector of a word in file order is kept."""
    from vecfactor.sources.w2v import import_vectors, write_vectors
    path = shared_path(spark, "vectors")
    v = FX.vocabulary(spark, sf_dir).checkpoint(eager=True)
    again = v.select("word", (F.col("word_idx") + v.count()).alias("word_idx"), F.transform("vec", lambda x: -x).alias("vec"))
    write_vectors(v.unionByName(again), path, n_files=4)
    out = import_vectors(spark, path, shared_path(spark, "imported"), records_per_partition=200)
    return out.select("word", "word_idx", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


# ----------------------------------------------------------------- R1, R2: file feeds

def _run_feed(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _center_feed(spark, sf_dir) -> str:
    """Every document's word list as a posted request; besides, every tenth list once more with
    a broken body and every hundredth once more as a line that is no JSON at all. Returns the
    output folder."""
    from vecfactor.streaming import feeds
    base = shared_path(spark, "feed_centers")
    good = FX.word_lists(spark, sf_dir).select("list_id", F.to_json("words").alias("payload"))
    broken = FX.word_payloads(spark, sf_dir).where(F.pmod("list_id", F.lit(10)) == 3)
    line = F.to_json(F.struct("list_id", "payload"))
    cut = F.expr("substr(line, 1, length(line) - 1)")
    lines = good.unionByName(broken.select("list_id", "payload")).select("list_id", line.alias("line")) \
        .select(F.explode(F.when(F.pmod("list_id", F.lit(100)) == 50, F.array(F.col("line"), cut))
                          .otherwise(F.array("line"))).alias("value"))
    docs = FX.table(spark, sf_dir, "documents")
    # each task cuts its own lines into files, nothing is shuffled for it; a file is read by one task
    per_file = -(-docs.count() // feeds.file_count(docs, "text", least=4))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file)).text(f"{base}/in")
    n_files = len(spark.read.text(f"{base}/in").inputFiles())
    C.save_vocabulary(FX.vocabulary(spark, sf_dir), f"{base}/vocabulary")
    _run_feed(feeds.center_feed(spark, f"{base}/in", spark.read.parquet(f"{base}/vocabulary"), f"{base}/out",
                                f"{base}/ckpt", max_files_per_trigger=max(1, -(-n_files // 2)),
                                stats=C.read_manifest(spark, f"{base}/vocabulary")))
    return f"{base}/out"


@register("feed_centers", ORACLE["word_center"])
def q_feed_centers(spark, sf_dir):
    from vecfactor.streaming import feeds
    cen = feeds.read_output(spark, f"{_center_feed(spark, sf_dir)}/centers")
    return C.center_rows(cen).select("list_id", F.col("dim").cast("long").alias("dim"), _r6("value"))


@register("feed_lists_rejected", """
SELECT doc_id AS list_id, 'Invalid json' AS reason FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT NULL, 'Invalid json' FROM documents WHERE doc_id % 100 = 50""")
def q_feed_lists_rejected(spark, sf_dir):
    """R2: requests whose line or body is no JSON, with the reason of the reply."""
    from vecfactor.streaming import feeds
    return feeds.read_output(spark, f"{_center_feed(spark, sf_dir)}/rejected").select("list_id", "reason")


@register("feed_uploads", ORACLE["uploads_validate"])
def q_feed_uploads(spark, sf_dir):
    from vecfactor.streaming import feeds
    base = shared_path(spark, "feed_uploads")
    feeds.stage_files(FX.rating_uploads(spark, sf_dir).drop("variant"), f"{base}/in")
    _run_feed(feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt"))
    parsed = feeds.read_output(spark, f"{base}/out/parsed")
    return parsed.select("upload_id", "model_name", "reason", "rank", "iterations", "reg", "n_ratings")


# ----------------------------------------------------------------- M2, M3: train-and-store uploads

@register("uploads_models", O.with_(_UPLOADS_SQL + """,
win AS (SELECT "user", max(upload_id) AS upload_id FROM up WHERE "user" % 7 IN (0, 4) GROUP BY "user")""", """
SELECT 'm' || w."user" AS model_name, 1::BIGINT AS version, 3 AS rank, u.n::BIGINT AS n_ratings
FROM win w JOIN up u ON u.upload_id = w.upload_id"""))
def q_uploads_models(spark, sf_dir):
    st = ModelStore(spark, shared_path(spark, "store"))
    parsed = P.parse_uploads(FX.rating_uploads(spark, sf_dir)).checkpoint(eager=True)
    train_and_store(st, parsed)
    return st.latest().select("model_name", "version", "rank", "n_ratings")


@register("uploads_normal_eq", O.with_(_UPLOADS_SQL + """,
win AS (SELECT "user", max(upload_id) AS upload_id FROM up WHERE "user" % 7 IN (0, 4) GROUP BY "user")""", """
SELECT 'm' || w."user" AS model_name, 'user' AS kind, w."user" AS id, u.n::BIGINT AS n, true AS solved
FROM win w JOIN up u ON u.upload_id = w.upload_id"""))
def q_uploads_normal_eq(spark, sf_dir):
    """Trained values of every stored model, read back from the store."""
    st = ModelStore(spark, shared_path(spark, "store"))
    parsed = P.parse_uploads(FX.rating_uploads(spark, sf_dir)).checkpoint(eager=True)
    won = train_and_store(st, parsed).select("upload_id", "model_name")
    r = P.flatten_ratings(parsed).drop("model_name").join(won, "upload_id").join(
        parsed.select("upload_id", "reg"), "upload_id")
    res = batch_als.normal_residuals(r, st.features())
    return res.select("model_name", F.lit("user").alias("kind"), "id", "n",
                      (F.col("residual") < MAX_RESIDUAL).alias("solved"))


def _stage_uploads(spark, sf_dir, path, nameless: bool = False):
    """Uploads in three posts, by item block modulo 3: an upload of a later post is a later
    request, whatever its id; ``nameless`` leaves out the model name of odd users."""
    from vecfactor.streaming import feeds
    ups = FX.rating_uploads(spark, sf_dir).drop("variant")
    if nameless:
        odd = F.pmod(F.substring("model_name", 2, 20).cast("int"), F.lit(2)) == 1
        ups = ups.withColumn("model_name", F.when(~odd, F.col("model_name")))
    post = F.pmod(F.substring_index("upload_id", "-", -1).cast("int"), F.lit(3))
    derived = shared_path(spark, "posts")   # derived once for the three posts
    ups.withColumn("post", post).write.parquet(derived)
    ups = spark.read.parquet(derived)
    n_files = feeds.file_count(ups, "payload", least=6)
    for i in range(3):
        feeds.stage_files(ups.where(F.col("post") == i).drop("post"), path, n_files=-(-n_files // 3))


_POSTS_SQL = _UPLOADS_SQL + """,
good AS (SELECT "user", upload_id, n, split_part(upload_id, '-', 2)::BIGINT % 3 AS post FROM up
  WHERE "user" % 7 IN (0, 4)),
win AS (SELECT "user", arg_max(upload_id, {'p': post, 'u': upload_id}) AS upload_id FROM good GROUP BY "user")"""


@register("feed_models", O.with_(_POSTS_SQL, """
SELECT 'm' || w."user" AS model_name, 1::BIGINT AS version, 3 AS rank, u.n::BIGINT AS n_ratings
FROM win w JOIN up u ON u.upload_id = w.upload_id"""))
def q_feed_models(spark, sf_dir):
    """R1 end to end: upload files -> validate -> train and store; the latest post wins."""
    from vecfactor.streaming import feeds
    base = shared_path(spark, "feed_models")
    _stage_uploads(spark, sf_dir, f"{base}/in")
    st = ModelStore(spark, f"{base}/store")
    _run_feed(feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", store=st))
    return st.latest().select("model_name", "version", "rank", "n_ratings")


@register("feed_replay", O.with_(_POSTS_SQL, """
SELECT upload_id, CASE WHEN "user" % 2 = 0 THEN 'm' || "user" END AS given_name, 1::BIGINT AS version,
       CASE WHEN "user" % 2 = 0 THEN length('m' || "user") ELSE 32 END::BIGINT AS name_length, true AS name_ok,
       1::BIGINT AS n_same_name
FROM good JOIN win USING ("user", upload_id) WHERE "user" % 2 = 0
UNION ALL
SELECT upload_id, NULL, 1, 32, true, 1 FROM good WHERE "user" % 2 = 1"""))
def q_feed_replay(spark, sf_dir):
    """R1 and M8: the same batch delivered twice (a feed that lost its progress) leaves one
    version of every model and the generated names of the first delivery."""
    from vecfactor.functions.names import NAME_ALPHABET
    from vecfactor.streaming import feeds
    base = shared_path(spark, "feed_replay")
    _stage_uploads(spark, sf_dir, f"{base}/in", nameless=True)
    st = ModelStore(spark, f"{base}/store")
    for delivery in ("a", "b"):
        _run_feed(feeds.upload_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt-{delivery}", store=st,
                                    feed_id="f"))
    live = st.latest().select("upload_id", "model_name", "version").checkpoint(eager=True)
    same = live.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_same_name"))
    own = F.concat(F.lit("m"), F.substring_index(F.expr("substr(upload_id, 2)"), "-", 1))
    given = F.when(F.col("model_name") == own, F.col("model_name"))
    return live.join(same, "model_name").select(
        "upload_id", given.alias("given_name"), "version", F.length("model_name").cast("long").alias("name_length"),
        (F.translate("model_name", NAME_ALPHABET, "") == "").alias("name_ok"), "n_same_name")
