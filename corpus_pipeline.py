"""Corpus pipeline: five stages over ``documents``, each calling one operator.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
rows its predecessor kept; ``run`` writes each result as Parquet in the shared
folder and reads it back for the next stage. All stages but the last return the
columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables are handled as the operators'
docstrings state: a null or empty text scores as the classifier's empty text and
is rejected by the length rule; of repeated rows one stays; a null id makes no
row less than a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.llm import jaccard_join, mixing, packing, quality_rules, rule_ensemble
from vecfactor.llm.common import materialise, table
from vecfactor.session import shared_path

MIN_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the rule ensemble scores at least ``MIN_QUALITY``."""
    model = rule_ensemble.fit_quality(docs, table(spark, sf_dir, "labels"))
    # a generator, not a filter: a filter on the score is pushed down and inlines all features into every rule
    kept = F.explode(F.when(F.col("score") >= MIN_QUALITY, F.array("_row")))
    return rule_ensemble.with_score(docs, model).select(kept.alias("_row")).select("_row.*")


def quality_rule_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that no quality rule rejects."""
    return quality_rules.cascade_filter(docs, quality_rules.ordered_rules(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word shingle similarity 0.8 or more:
    the one with the smallest id (of repeated rows of that id, one). Each row with a
    null id is a document of its own: of a group without any id one row stays."""
    rows, own = jaccard_join.numbered(docs)
    comp = jaccard_join.linked_rows(rows.select("doc_id", "_row.text"), own, jaccard_join.PIPELINE)
    keep = materialise(comp.where("doc_id = head").select("doc_id").distinct())
    repeats = not comp.groupBy("doc_id").count().where("count > 1").isEmpty()
    out = rows.join(keep, "doc_id", "left_semi")
    if repeats:
        out = out.dropDuplicates(["doc_id"])
    return out.select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by probabilities raked to source, language and topic targets."""
    return mixing.mixed_rows(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into token-budget batches of optimal length buckets."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_cascade),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", length_buckets),
]

# a trained classifier and connected components are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
