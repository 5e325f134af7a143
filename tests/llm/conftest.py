import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names the operators use themselves."""
    def make(rows, extra=True):
        data = [(d, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"src{i % 3}", len(t or ""))
                for i, (d, t) in enumerate(rows)]
        df = spark.createDataFrame(data, DOC_SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            for c in ("score", "shard", "slot", "n_words", "kept", "prob", "bucket", "_w", "_t", "n", "weight", "topic"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c"), (7, LONG), (8, LONG),
        (9, "same words here and there " * 20), (9, "same words here and there " * 20), (None, "no id at all"),
        (10, "### *** $$$ " * 30), (11, "WORD!! " * 60), (12, "Ünïcode wörds — naïve café " * 15)]
