"""Quality classifier: a sparse rule ensemble compiled to Spark expressions.

1. Text statistics (``text_stats`` plus the ratios below) are computed in the row.
2. On a bounded, hashed sample of the labelled documents (``max_train_rows``,
   the only bound: a documented parameter of the fit) a small random forest is
   trained; every path from a root to a node is a conjunction of thresholds.
3. A lasso logistic regression over those rules keeps few of them.
4. The rules with a weight become one Spark column: a logistic function of the
   sum of the weights of the rules that hold. Scoring reads each document once,
   without Python, join or shuffle.

Null texts count as empty and are scored like them; equal texts get equal
scores. Rows with a null label or id are no training rows; repeated labels
count each. Without labels of both kinds the score is the constant share of
label 1 in the training rows (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfactor.llm import text_stats as S
from vecfactor.llm.common import crc32_text, materialise, sealed, text_or_empty, with_row
from vecfactor.session import shared_path

TRAIN_PARTITIONS = 8  # the training rows are bounded, however many partitions the documents have

FEATURES = ["log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio",
            "digit_ratio"]


def add_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``FEATURES`` (doubles, never null), sealed: a filter on a score does
    not compute them again."""
    d = S.with_word_stats(df, text)
    n = F.greatest(F.col("n_words"), F.lit(1))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("_t", pattern, ""))
    chars = F.greatest(F.length("_t"), F.lit(1))
    lines = F.greatest(F.size(F.split("_t", "\n", -1)), F.lit(1))
    upper, letters = left("[^A-Z]+"), F.greatest(left("[^A-Za-z]+"), F.lit(1))
    d = (d.withColumn("log_words", F.log1p(F.col("n_words").cast("double")))
         .withColumn("mean_word", F.col("word_chars") / n)
         .withColumn("symbol_ratio", F.col("n_symbols") / n)
         .withColumn("dup_line_ratio", F.col("n_dup_lines") / lines)
         .withColumn("repeat_ratio", F.col("n_repeat_words") / n)
         .withColumn("upper_ratio", upper / letters)
         .withColumn("bang_ratio", left("[^!]+") / n)
         .withColumn("digit_ratio", left("[^0-9]+") / chars))
    return sealed(d.drop("_w", "_t", *S.WORD_STATS))


@dataclass(frozen=True)
class PathRule:
    """A conjunction of (feature, '<=' or '>', threshold)."""
    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        c = F.lit(True)
        for name, op, v in self.terms:
            c = c & ((F.col(name) <= v) if op == "<=" else (F.col(name) > v))
        return c

    def simplified(self) -> "PathRule":
        """One bound per feature and direction."""
        best: dict[tuple[str, str], float] = {}
        for name, op, v in self.terms:
            k = (name, op)
            best[k] = v if k not in best else (min(best[k], v) if op == "<=" else max(best[k], v))
        return PathRule(tuple(sorted((n, o, v) for (n, o), v in best.items())))


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[PathRule, float]]

    def score(self) -> Column:
        """Probability of label 1 over the feature columns."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def forest_rules(train: DataFrame, trees: int, depth: int, seed: int) -> list[PathRule]:
    """The distinct root-to-node paths of a small forest over ``features``, ``label``.

    The fitted trees are read back from the model's own node table."""
    model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth,
                                   featureSubsetStrategy="all" if trees == 1 else "onethird", seed=seed,
                                   subsamplingRate=0.7).fit(train)
    spark = train.sparkSession
    path = shared_path(spark, "forest")
    model.write().overwrite().save(path)
    nodes: dict[tuple[int, int], dict] = {}
    data = spark.read.parquet(f"{path}/data")
    for r in data.select("treeID", "nodeData.*").collect():  # trees * 2 ** (depth + 1) nodes at most
        nodes[(r["treeID"], r["id"])] = r.asDict(recursive=True)
    rules: dict[PathRule, None] = {}

    def walk(tree: int, node: int, terms: tuple):
        if terms:
            rules.setdefault(PathRule(terms).simplified())
        n = nodes[(tree, node)]
        if n["leftChild"] < 0:
            return
        name, v = FEATURES[n["split"]["featureIndex"]], float(n["split"]["leftCategoriesOrThreshold"][0])
        walk(tree, n["leftChild"], terms + ((name, "<=", v),))
        walk(tree, n["rightChild"], terms + ((name, ">", v),))

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, ())
    return sorted(rules, key=lambda r: r.terms)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_train_rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of a hashed sample of about ``max_train_rows`` labelled rows.

    ``allowed`` is a condition on ``doc_id``. The sampled ids are few (about
    the bound), so documents are joined against a broadcast of them."""
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0) & allowed)
    n = lab.count()
    step = max(1, -(-n // max_train_rows))
    lab = materialise(lab.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(step)) == 0))
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    side = F.broadcast(lab) if lab.count() <= 2 * max_train_rows else lab
    return d.join(side, "doc_id")


def fit_rules(train: DataFrame, trees: int = 10, depth: int = 4, reg: float = 0.0003, seed: int = 11) -> RuleModel:
    """``train``: text, label."""
    feats = materialise(add_features(train.select("text", "label")).select(*FEATURES, "label")
                        .repartition(TRAIN_PARTITIONS))
    seen = {r["label"]: r["n"] for r in feats.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values())
    if len(seen) < 2:
        p = min(max(seen.get(1.0, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return RuleModel(math.log(p / (1 - p)), [])
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rules = forest_rules(vec.transform(feats).select("features", "label"), trees, depth, seed)
    names = [f"r{i}" for i in range(len(rules))]
    onehot = feats.select("label", *[r.column().cast("double").alias(n) for n, r in zip(names, rules)])
    x = materialise(VectorAssembler(inputCols=names, outputCol="rules").transform(onehot).select("rules", "label"))
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=reg,
                               standardization=False, maxIter=50).fit(x)
    w = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``_row`` (the input row) and ``score``."""
    return add_features(with_row(docs, text=F.col(text_col))).withColumn("score", model.score())


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 12_000) -> RuleModel:
    allowed = F.pmod(crc32_text("doc_id"), F.lit(4)) != 2
    return fit_rules(training_rows(docs, labels, "quality", allowed, max_train_rows))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, max_train_rows)
    d = add_features(docs.select("doc_id", "text")).withColumn("score", model.score())
    held = F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(4)) == 2, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
