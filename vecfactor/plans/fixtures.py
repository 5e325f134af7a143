"""Inputs for every job, derived by Spark from the driver tables.

Each derivation reads whole tables; nothing is sampled or capped. The shapes
are the ones documented in FIXTURES.md:

* word lists   documents.text split on runs of spaces/newlines
* vocabulary   distinct tokens ranked by (count desc, word); rank r takes the
               embedding with vec_id = r (as many words as there are vectors)
* ratings      events: user_id, props.k, value of the latest (ts, event_id)
* factors      fixed factor tables from embeddings (user u -> vec_id u mod N,
               item i -> vec_id N-1-i) for scoring without training
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.functions.text import split_tokens
from vecfactor.plans.ranking import global_row_number
from vecfactor.plans.sizing import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- words

def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list_id LONG, words ARRAY<STRING>``: one list per document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("list_id"), split_tokens("text").alias("words"))


def list_tokens(lists: DataFrame) -> DataFrame:
    """``list_id, pos, word``: one row per token, position kept."""
    return (lists.select("list_id", F.posexplode("words").alias("pos", "word"))
            .select("list_id", F.col("pos").cast("long").alias("pos"), "word"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word STRING, word_idx LONG, vec ARRAY<FLOAT>`` built from the corpus.

    Token counts are a partial+final aggregation; the ranking is a
    range-partitioned sort (see :mod:`ranking`), never a single-task window.
    """
    emb = table(spark, sf_dir, "embeddings")
    tokens = list_tokens(word_lists(spark, sf_dir))
    # the ranking reads the counts twice (per-partition sizes, then rows):
    # a reliable checkpoint keeps the tokenisation to one pass
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).checkpoint(eager=True)
    ranked = global_row_number(counts, [F.col("cnt").desc(), F.col("word").asc()], "word_idx")
    n_vectors = emb.count()  # one number (Parquet metadata): only that many ranks can match
    ranked = ranked.where(F.col("word_idx") < n_vectors)
    return (ranked.join(emb, ranked.word_idx == emb.vec_id)
            .select("word", "word_idx", F.col("embedding").alias("vec")))


# --------------------------------------------------------------------------- ratings

def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user INT, item INT, rating DOUBLE, ts, event_id`` per event."""
    ev = spread(table(spark, sf_dir, "events"))
    return ev.select(
        F.col("user_id").cast("int").alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("value").cast("double").alias("rating"),
        "ts", "event_id", "event_type")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user INT, item INT, rating DOUBLE``; unique (user, item), latest value wins."""
    return (event_items(spark, sf_dir)
            .groupBy("user", "item")
            .agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating")))


def fixed_factors(spark: SparkSession, sf_dir: str, ids: DataFrame, kind: str) -> DataFrame:
    """``id INT, features ARRAY<FLOAT>`` taken from embeddings.

    user u -> vec_id = u mod N, item i -> vec_id = N-1-i, N = count(embeddings).
    N is one number (a metadata count of the Parquet file), used as a literal.
    """
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
    if kind == "user":
        vec_id = F.pmod(F.col("id"), F.lit(n))
    else:
        vec_id = F.lit(n - 1) - F.col("id")
    return (ids.withColumn("vec_id", vec_id).join(emb, "vec_id")
            .select(F.col("id").cast("int").alias("id"), F.col("embedding").alias("features")))


# --------------------------------------------------------------------------- uploads

# fixed upload parameters of the derived payloads
UPLOAD_RANK, UPLOAD_ITERATIONS, UPLOAD_LAMBDA = 3, 5, 0.1
ITEMS_PER_UPLOAD = 50


def _json_obj(entries) -> F.Column:
    """``{"k": v, ...}`` text from array<struct<k, v>>; keys are digits, v is JSON text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit('"'), e["k"], F.lit('": '), e["v"])), ", "), F.lit("}"))


def rating_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upload_id, model_name, payload, variant``: one upload per (user, item block).

    The variant ``pmod(user, 7)`` decides the payload shape: 0 plain, 1 two
    fields missing, 2 truncated text, 3 one rating not a number, 4 every
    number quoted, 5 rank not a number, 6 empty ratings.
    """
    r = ratings(spark, sf_dir)
    g = (r.groupBy("user", (F.col("item") / ITEMS_PER_UPLOAD).cast("int").alias("blk"))
         .agg(F.array_sort(F.collect_list(F.struct("item", "rating"))).alias("pairs")))
    v = F.pmod(F.col("user"), F.lit(7))
    plain = F.transform("pairs", lambda p: F.struct(p["item"].cast("string").alias("k"),
                                                     p["rating"].cast("string").alias("v")))
    quoted = F.transform("pairs", lambda p: F.struct(
        p["item"].cast("string").alias("k"), F.concat(F.lit('"'), p["rating"].cast("string"), F.lit('"')).alias("v")))
    bad = F.transform("pairs", lambda p, i: F.struct(
        p["item"].cast("string").alias("k"),
        F.when(i == 0, F.lit('"x"')).otherwise(p["rating"].cast("string")).alias("v")))
    user_s = F.col("user").cast("string")

    def ratings_json(items):
        return F.concat(F.lit('{"'), user_s, F.lit('": '), _json_obj(items), F.lit("}"))

    params = F.lit(f', "rank": {UPLOAD_RANK}, "iterations": {UPLOAD_ITERATIONS}, "lambda": {UPLOAD_LAMBDA}')
    payload = (F.when(v == 1, F.concat(F.lit('{"ratings": '), ratings_json(plain), F.lit(f', "rank": {UPLOAD_RANK}}}')))
               .when(v == 2, F.concat(F.lit('{"ratings": '), ratings_json(plain), params))
               .when(v == 3, F.concat(F.lit('{"ratings": '), ratings_json(bad), params, F.lit("}")))
               .when(v == 4, F.concat(F.lit('{"ratings": '), ratings_json(quoted),
                                      F.lit(f', "rank": "{UPLOAD_RANK}", "iterations": "{UPLOAD_ITERATIONS}", '
                                            f'"lambda": "{UPLOAD_LAMBDA}"}}')))
               .when(v == 5, F.concat(F.lit('{"ratings": '), ratings_json(plain),
                                      F.lit(f', "rank": "three", "iterations": {UPLOAD_ITERATIONS}, '
                                            f'"lambda": {UPLOAD_LAMBDA}}}')))
               .when(v == 6, F.concat(F.lit('{"ratings": {}'), params, F.lit("}")))
               .otherwise(F.concat(F.lit('{"ratings": '), ratings_json(plain), params, F.lit("}"))))
    return g.select(
        F.concat(F.lit("u"), user_s, F.lit("-"), F.col("blk").cast("string")).alias("upload_id"),
        F.concat(F.lit("m"), user_s).alias("model_name"),
        payload.alias("payload"), v.alias("variant"))


EVENT_BLOCK = 4096  # events per derived upload at most (by event id)


def duplicate_key_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upload_id, payload``: one upload per (user, day, two-hour slot, block
    of ``EVENT_BLOCK`` event ids), so no upload holds more than that many
    events however active a user is.

    Every event of the slot is in it, in event order, so an item repeats and
    its later value must win; events of the slot's first hour sit under the
    key ``"<user>"``, of its second hour under ``"0<user>"``, which casts to
    the same user and so must replace the first block whole. Slots keep each
    upload (one document) small whatever a user's activity.
    """
    ev = (event_items(spark, sf_dir).withColumn("day", F.to_date("ts"))
          .withColumn("slot", (F.hour("ts") / 2).cast("int"))
          .withColumn("eblk", F.floor(F.col("event_id") / EVENT_BLOCK))
          .withColumn("second", (F.hour("ts") % 2) == 1))

    def block(second: bool):
        return F.array_sort(F.collect_list(F.when(F.col("second") == F.lit(second),
                                                  F.struct("ts", "event_id", "item", "rating"))))
    g = ev.groupBy("user", "day", "slot", "eblk").agg(block(False).alias("b1"), block(True).alias("b2"))

    def obj(arr):
        return _json_obj(F.transform(arr, lambda x: F.struct(x["item"].cast("string").alias("k"),
                                                            x["rating"].cast("string").alias("v"))))
    user_s = F.col("user").cast("string")
    ratings_json = F.concat(F.lit("{"), F.concat_ws(
        ", ",
        F.when(F.size("b1") > 0, F.concat(F.lit('"'), user_s, F.lit('": '), obj(F.col("b1")))),
        F.when(F.size("b2") > 0, F.concat(F.lit('"0'), user_s, F.lit('": '), obj(F.col("b2"))))), F.lit("}"))
    return g.select(
        F.concat(F.lit("d"), user_s, F.lit("-"), F.date_format("day", "yyyyMMdd"), F.lit("-"),
                 F.col("slot").cast("string"), F.lit("-"), F.col("eblk").cast("string")).alias("upload_id"),
        F.concat(F.lit('{"ratings": '), ratings_json,
                 F.lit(', "rank": 2, "iterations": 3, "lambda": 0.01}')).alias("payload"))


def word_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list_id, payload``: each document's tokens as a JSON array text;
    documents with ``pmod(doc_id, 10) = 3`` get a truncated (invalid) text."""
    lists = word_lists(spark, sf_dir)
    js = F.to_json("words")
    bad = F.pmod(F.col("list_id"), F.lit(10)) == 3
    return lists.select("list_id", F.when(bad, F.expr("substr(to_json(words), 1, length(to_json(words)) - 1)"))
                        .otherwise(js).alias("payload"))


def keyed_fixed_factors(spark: SparkSession, sf_dir: str, keyed: DataFrame) -> DataFrame:
    """``model_name, kind, id, features`` for ``model_name, kind, id`` rows
    (same rule as :func:`fixed_factors`, many models in one join)."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    vec_id = F.when(F.col("kind") == "user", F.pmod(F.col("id").cast("long"), F.lit(n))) \
        .otherwise(F.lit(n - 1) - F.col("id").cast("long"))
    return (keyed.select("model_name", "kind", "id").distinct().withColumn("vec_id", vec_id)
            .join(emb, "vec_id")
            .select("model_name", "kind", F.col("id").cast("int").alias("id"), F.col("embedding").alias("features")))


# the event stream is cut in two halves for the model-store fixture
STORE_SPLIT_TS = "2024-01-16 00:00:00"


def typed_ratings(spark: SparkSession, sf_dir: str, half: int | None) -> DataFrame:
    """``model_name (= event_type), user, item, rating``: latest value per pair
    within one half of the event stream (``half`` 1 or 2; None = all)."""
    ev = event_items(spark, sf_dir)
    # the event time is a wall-clock timestamp (no zone): compare it as such,
    # so the cut does not move with the session time zone
    cut = F.col("ts").cast("timestamp_ntz") < F.lit(STORE_SPLIT_TS).cast("timestamp_ntz")
    if half == 1:
        ev = ev.where(cut)
    elif half == 2:
        ev = ev.where(~cut)
    return (ev.groupBy(F.col("event_type").alias("model_name"), "user", "item")
            .agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating")))
