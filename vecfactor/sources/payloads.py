"""Rating-upload and word-list payloads: parse, validate, flatten.

An upload is one JSON document ``{ratings: {user: {item: rating}}, rank,
iterations, lambda}``. Each upload is checked and flattened *inside its own
row* with higher-order functions, so parsing many uploads needs no shuffle
and one bad upload never touches another.

JSON-object semantics of the service are kept:

* a repeated key keeps its **last** value but the position of its **first**
  occurrence (a Python dict loaded from JSON);
* keys are then cast to int; when two raw keys meet on one int key (``"1"``
  and ``"01"``) the one iterated later wins, and for users the later block
  replaces the earlier block whole;
* an overwritten bad value does no harm, any surviving bad key or value
  rejects the whole upload.

Reasons, in the order the service checks them: ``Invalid json``,
``Missing fields [...]``, ``Invalid data types``, ``Rating data invalid``,
``Empty ratings``, ``Invalid parameters``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED_FIELDS = ("ratings", "rank", "iterations", "lambda")  # fixed: required payload keys
INT_KEY = r"^\s*[+-]?[0-9]+\s*$"
EMPTY_TEXTS = ("", "[]")

def _last_value(m: Column, key: str) -> Column:
    """Value of the last occurrence of ``key`` in a map that may repeat keys."""
    return F.try_element_at(F.map_values(F.map_filter(m, lambda k, v: k == F.lit(key))), F.lit(-1))


def _indexed(entries: Column) -> Column:
    """array<struct<key, value>> -> array<struct<key, pos, value>> sorted by (key, pos)."""
    return F.array_sort(F.transform(entries, lambda e, i: F.struct(
        e["key"].alias("key"), i.alias("pos"), e["value"].alias("value"))))


def _dedup_sorted(s: Column) -> Column:
    """From entries sorted by (key, pos): one per key, first pos, last value."""
    n = F.size(s)
    starts = F.filter(s, lambda x, i: (i == 0) | (F.try_element_at(s, i)["key"] != x["key"]))
    ends = F.filter(s, lambda x, i: (i == n - 1) | (F.try_element_at(s, i + F.lit(2))["key"] != x["key"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a["key"].alias("key"), a["pos"].alias("pos"), b["value"].alias("value")))


def _keep_last_by(s: Column, key: str) -> Column:
    """From entries sorted by (key, pos): the last entry of every key group."""
    n = F.size(s)
    return F.filter(s, lambda x, i: (i == n - 1) | (F.try_element_at(s, i + F.lit(2))[key] != x[key]))


def _int_key(k: Column) -> Column:
    return F.when(k.rlike(INT_KEY), F.trim(k).try_cast("int"))


def _num(v: Column) -> Column:
    d = F.trim(v).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def users_map_ok(txt: Column, parsed: Column) -> Column:
    """The ratings value is an object, or something the service reads as empty."""
    return txt.isNull() | txt.isin(*EMPTY_TEXTS) | parsed.isNotNull()


def parse_uploads(uploads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Validate and flatten uploads in-row.

    Input: ``upload_id`` and ``payload`` (plus optional ``model_name`` and
    ``arrived_at``, which is carried along).
    Output columns: ``upload_id, model_name, reason, rank, iterations, reg,
    ratings, n_ratings``; ``reason`` is NULL for an accepted upload.
    """
    has_name = "model_name" in uploads.columns
    carried = [c for c in ("arrived_at",) if c in uploads.columns]
    base = uploads.select(
        *carried,
        "upload_id",
        (F.col("model_name") if has_name else F.lit(None).cast("string")).alias("model_name"),
        F.from_json(F.col(payload_col), "map<string,string>").alias("top"))

    # ---- top level: presence, parameters, ratings text (last value wins)
    missing = F.filter(F.array(*[F.lit(k) for k in REQUIRED_FIELDS]),
                       lambda k: ~F.map_contains_key(F.col("top"), k))
    rank_d = _num(_last_value(F.col("top"), "rank"))
    iter_d = _num(_last_value(F.col("top"), "iterations"))
    reg_d = _num(_last_value(F.col("top"), "lambda"))
    ratings_txt = _last_value(F.col("top"), "ratings")
    users_map = F.from_json(ratings_txt, "map<string,string>")
    s1 = base.select(
        *carried, "upload_id", "model_name", "top",
        missing.alias("missing"),
        rank_d.try_cast("int").alias("rank"),
        iter_d.try_cast("int").alias("iterations"),
        reg_d.alias("reg"),
        ratings_txt.alias("ratings_txt"),
        users_map.alias("umap"))
    s1 = s1.select("*", users_map_ok(F.col("ratings_txt"), F.col("umap")).alias("umap_ok"),
                   _indexed(F.map_entries("umap")).alias("u_sorted")).drop("umap")

    # ---- users: one entry per raw key (last value, first position)
    s2 = s1.withColumn("users", _dedup_sorted(F.col("u_sorted"))).drop("u_sorted")

    # ---- items of every user, parsed and sorted per user
    def parse_user(u):
        items = F.from_json(u["value"], "map<string,string>")
        return F.struct(
            u["key"].alias("key"), u["pos"].alias("pos"), _int_key(u["key"]).alias("ikey"),
            (items.isNotNull() | u["value"].isin(*EMPTY_TEXTS)).alias("obj_ok"),
            _indexed(F.coalesce(F.map_entries(items),
                                F.array().cast("array<struct<key:string,value:string>>"))).alias("i_sorted"))
    s3 = s2.withColumn("users", F.transform("users", parse_user))

    # ---- items: dedup raw keys, cast, judge
    def judge_user(u):
        items = F.transform(_dedup_sorted(u["i_sorted"]), lambda it: F.struct(
            it["pos"].alias("pos"), _int_key(it["key"]).alias("ikey"),
            _num(it["value"]).alias("rating")))
        return F.struct(u["pos"].alias("pos"), u["ikey"].alias("ikey"), u["obj_ok"].alias("obj_ok"),
                        items.alias("items"))
    s4 = s3.withColumn("users", F.transform("users", judge_user))

    user_ok = lambda u: (u["ikey"].isNotNull() & u["obj_ok"]
                         & F.forall(u["items"], lambda it: it["ikey"].isNotNull() & it["rating"].isNotNull()))
    ratings_ok = F.col("umap_ok") & F.coalesce(F.forall("users", user_ok), F.lit(True))

    # ---- last block per int user, last value per int item
    def final_user(u):
        s = F.array_sort(F.transform(u["items"], lambda it: F.struct(
            it["ikey"].alias("ikey"), it["pos"].alias("pos"), it["rating"].alias("rating"))))
        return F.struct(u["ikey"].alias("ikey"), s.alias("items"))
    s5 = s4.select(
        *carried, "upload_id", "model_name", "top", "missing", "rank", "iterations", "reg",
        ratings_ok.alias("ratings_ok"),
        F.array_sort(F.transform("users", lambda u: F.struct(
            u["ikey"].alias("ikey"), u["pos"].alias("pos"), u["items"].alias("items")))).alias("u_by_int"))
    s6 = s5.withColumn("u_final", F.transform(_keep_last_by(F.col("u_by_int"), "ikey"), final_user))
    triples = F.flatten(F.transform("u_final", lambda u: F.transform(
        _keep_last_by(u["items"], "ikey"), lambda it: F.struct(
            u["ikey"].alias("user"), it["ikey"].alias("item"), it["rating"].alias("rating")))))
    s7 = s6.withColumn("ratings", F.coalesce(
        triples, F.array().cast("array<struct<user:int,item:int,rating:double>>")))

    params_typed = F.col("rank").isNotNull() & F.col("iterations").isNotNull() & F.col("reg").isNotNull()
    reason = (F.when(F.col("top").isNull(), F.lit("Invalid json"))
              .when(F.size("missing") > 0,
                    F.concat(F.lit("Missing fields ["),
                             F.array_join(F.transform("missing", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
                             F.lit("]")))
              .when(~params_typed, F.lit("Invalid data types"))
              .when(~F.col("ratings_ok"), F.lit("Rating data invalid"))
              .when(F.size("ratings") == 0, F.lit("Empty ratings"))
              .when((F.col("rank") < 1) | (F.col("iterations") < 0) | (F.col("reg") < 0),
                    F.lit("Invalid parameters")))
    ok = reason.isNull()
    return s7.select(
        *carried, "upload_id", "model_name", reason.alias("reason"),
        F.when(ok, F.col("rank")).alias("rank"),
        F.when(ok, F.col("iterations")).alias("iterations"),
        F.when(ok, F.col("reg")).alias("reg"),
        F.when(ok, F.col("ratings")).alias("ratings"),
        F.when(ok, F.size("ratings")).otherwise(0).cast("long").alias("n_ratings"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("upload_id", "model_name", "reason")


def flatten_ratings(parsed: DataFrame) -> DataFrame:
    """``upload_id, model_name, user, item, rating`` for accepted uploads."""
    # a generator over a conditional array, not a filter: a filter on the
    # derived reason would be pushed down and inline the parsing expressions
    return (parsed.select("upload_id", "model_name",
                          F.explode(F.when(F.col("reason").isNull(), F.col("ratings"))).alias("r"))
            .select("upload_id", "model_name", "r.user", "r.item", "r.rating"))


# ----------------------------------------------------------------------- word lists

def parse_word_lists(df: DataFrame, payload_col: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """``list_id, words ARRAY<STRING>, reason``: a JSON array of strings per row.

    Anything that is not a JSON array (malformed text, an object, a bare
    string) is rejected with ``Invalid json``; null elements are dropped.
    Columns named in ``keep`` are carried along.
    """
    arr = F.from_json(F.col(payload_col), "array<string>")
    return df.select(
        "list_id", *keep,
        F.filter(arr, lambda w: w.isNotNull()).alias("words"),
        F.when(arr.isNull(), F.lit("Invalid json")).alias("reason"))


def parse_word_requests(df: DataFrame, line_col: str = "value") -> DataFrame:
    """``list_id, words, reason, request`` for raw request lines.

    A line is ``{"list_id": 7, "payload": "<body>"}``, the body being what was
    posted, or ``{"list_id": 7, "words": [...]}``. ``reason`` is NULL for an accepted
    list. A line that is no such object, or a body that is not a JSON array, is
    ``Invalid json``; a line without a ``list_id`` is ``Missing list id``. ``request``
    is the line itself.
    """
    line = F.from_json(F.col(line_col), "map<string,string>")
    body = F.coalesce(F.try_element_at(line, F.lit("payload")), F.try_element_at(line, F.lit("words")))
    base = df.select(F.col(line_col).alias("request"), F.try_element_at(line, F.lit("list_id")).alias("_id"),
                     line.isNull().alias("_bad"), body.alias("_body"))
    base = base.withColumn("list_id", F.col("_id").try_cast("long"))
    lists = parse_word_lists(base, "_body", keep=("request", "_bad"))
    reason = (F.when(F.col("_bad") | F.col("words").isNull(), F.lit("Invalid json"))
              .when(F.col("list_id").isNull(), F.lit("Missing list id")))
    return lists.select("list_id", "words", reason.alias("reason"), "request")
