"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import EDGE
from tests.llm.test_free_ops import brute_components
from tests.llm.test_native_ops import reference_stats
from vecfactor.llm import jaccard_join
from vecfactor.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates",
                                                      "mix_sources", "packing"]


def test_stages_on_documents(spark):
    docs = table(spark, SF, "documents")
    lab = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    s1 = corpus_pipeline.quality_classifier(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in s1.select("doc_id").collect()}
    assert s1.columns == docs.columns
    good = [d for d, q in lab.items() if q == 1]
    bad = [d for d, q in lab.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.05 * len(bad)
    s2 = corpus_pipeline.quality_rule_cascade(spark, s1, SF).cache()
    assert s2.columns == docs.columns
    rows = s2.select("doc_id", "text").collect()
    assert all(s[0] >= 50 and 2 * s[4] <= s[0] for s in (reference_stats(r["text"]) for r in rows))
    s3 = corpus_pipeline.near_duplicates(spark, s2, SF).cache()
    assert s3.columns == docs.columns
    comp = brute_components([tuple(r) for r in rows], jaccard_join.PIPELINE)
    assert sorted(r["doc_id"] for r in s3.collect()) == sorted(d for d, c in comp.items() if d == c)
    s4 = corpus_pipeline.mix_sources(spark, s3, SF).cache()
    assert s4.columns == docs.columns and 0 < s4.count() < s3.count()
    s5 = corpus_pipeline.length_buckets(spark, s4, SF)
    assert sorted(r["doc_id"] for r in s5.collect()) == sorted(r["doc_id"] for r in s4.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = Counter(r["doc_id"] for r in out)
    assert out and max(ids.values()) == 1


def test_stages_on_edges(spark, make_docs):
    docs = make_docs(EDGE)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, "/root/testdata/sf0.001")
            n = out.count()
            assert n <= df.count()
            if name != "packing":
                assert out.columns == df.columns
    one = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()
    ids = [r["doc_id"] for r in one]
    assert len(ids) == len(set(ids)) and 7 in ids and 8 not in ids and 9 in ids


def test_rows_without_id_are_documents(spark, make_docs):
    def text(tag, n=60):
        return " ".join(f"{tag}{i}" for i in range(n))
    rows = EDGE + [(None, text("a")), (None, text("a")), (None, text("a") + " more"),    # a group without any id
                   (20, text("b")), (None, text("b")), (None, text("b") + " more"),      # named by 20
                   (30, text("c")), (None, text("c") + " x"), (31, text("c") + " x y"),
                   (2**63 - 1, text("d")), (-2**63, text("e")), (None, text("f")), (None, ""), (None, None)]
    docs = make_docs(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    free = Counter((t or "").split(" ")[0] for d, t in got if d is None)
    assert free == {"no": 1, "a0": 1, "f0": 1, "": 2}  # texts without words are groups of their own
    assert sorted(d for d, _ in got if d is not None) == sorted(
        {d for d, _ in rows if d is not None} - {8, 31})
    comp = jaccard_join.similar_components(docs, jaccard_join.PIPELINE).collect()
    assert len(comp) == len(rows)
    assert Counter(r["component_id"] for r in comp if r["doc_id"] is None) == {None: 7, 20: 2, 30: 1}
