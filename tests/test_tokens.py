from pyspark.sql import functions as F

from vecfactor.functions import text as T


def _flags(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = df.select("word", T.is_stop_word("word").alias("stop"), T.is_punctuation("word").alias("punct"),
                     T.is_url("word").alias("url"), T.is_email("word").alias("email"),
                     T.keep_token("word").alias("keep")).collect()
    return {r["word"]: r for r in rows}


def test_stop_words_case_sensitive(spark):
    f = _flags(spark, ["the", "The", "don't", "Don't"])
    assert f["the"]["stop"] and not f["the"]["keep"]
    assert not f["The"]["stop"] and f["The"]["keep"]
    assert f["don't"]["stop"] and f["Don't"]["keep"]


def test_punctuation_whole_token_only(spark):
    f = _flags(spark, ["?", "...", "{", "\t", "@", "\\"])
    assert not f["?"]["keep"] and not f["\t"]["keep"] and not f["@"]["keep"] and not f["\\"]["keep"]
    assert f["..."]["keep"] and f["{"]["keep"]


def test_url_prefixes(spark):
    f = _flags(spark, ["HTTP://a", "www.b", "httpx", "Https:x", "wwwx"])
    assert f["HTTP://a"]["url"] and f["www.b"]["url"] and f["Https:x"]["url"]
    assert not f["httpx"]["url"] and not f["wwwx"]["url"]


def test_email_intent(spark):
    f = _flags(spark, ["a@b.c", "a@b", "a@b.", "a@b@c.d", "a@.c", "a@b..c", "a@b.c."])
    assert f["a@b.c"]["email"] and not f["a@b.c"]["keep"]
    assert not f["a@b"]["email"] and not f["a@b."]["email"] and not f["a@b@c.d"]["email"]
    assert f["a@.c"]["email"]          # empty piece before the dot is allowed
    assert not f["a@b..c"]["email"]    # the piece after the first dot must be non-empty
    assert f["a@b.c."]["email"]


def test_filter_words_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(1, ["x", "the", "x", "?", "yy", "a@b.c"])], "list_id long, words array<string>")
    out = df.select(T.filter_words("words").alias("w")).first()["w"]
    assert out == ["x", "x", "yy"]


def test_split_tokens_drops_empties(spark):
    df = spark.createDataFrame([(" a  b\n\nc ",), ("",)], "text string")
    got = [r["t"] for r in df.select(T.split_tokens("text").alias("t")).collect()]
    assert got == [["a", "b", "c"], []]


def test_stop_word_parameter(spark):
    df = spark.createDataFrame([("foo",), ("the",)], "word string")
    got = {r["word"]: r["k"] for r in df.select("word", T.keep_token("word", ["foo"]).alias("k")).collect()}
    assert got == {"foo": False, "the": True}
    assert F is not None
