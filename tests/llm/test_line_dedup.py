import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE
from vecfactor.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least):
    held = Counter(k for _, t in rows for k in {_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if held[_key(x)] < least]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    rows = [(i, f"Header Line\nown {i}\n\n  header line\t\n{'mid' if i % 3 else 'MID '}\nx{i % 7}") for i in range(60)]
    return rows + EDGE + [(i, "Ünï ÉCOLE") for i in range(70, 82)] + [(90, "footer") for _ in range(9)]


def _result(df):
    return sorted((tuple(r) for r in L.line_digest(df).collect()), key=repr)


def _index(spark, docs, n, root=None, **kw):
    runs = L.LineRuns(spark, root, min_docs=10, **kw)
    for i in range(n):
        runs.add(docs.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i), f"b{i}")
    return runs


@pytest.mark.parametrize("n,fanout,limit", [(1, 2, 1 << 24), (5, 2, 1 << 24), (5, 3, 0)])
def test_runs_and_both_ways_of_dropping(spark, make_docs, n, fanout, limit):
    rows = _rows()
    docs = make_docs(rows)
    runs = _index(spark, docs, n, fanout=fanout)
    got = L.drop_lines(docs, runs.settled(), broadcast_bytes=limit, chunk_rows=16)
    assert _result(got) == brute(rows, 10)
    assert {"score", "kept"} <= set(got.select("_row.*").columns)     # clashing columns are carried along


def test_replayed_batch_and_reopened_index(spark, make_docs, tmpdir_shared):
    docs = make_docs([(i, "again\nonce %d" % i) for i in range(9)])
    root = tmpdir_shared + "/runs"
    runs = L.LineRuns(spark, root, min_docs=10, fanout=2)
    assert runs.add(docs, "a") and not runs.add(docs, "a")
    again = L.LineRuns(spark, root, min_docs=10, fanout=2)             # opened anew from its manifest
    assert not again.add(docs, "a") and again.settled().count() == 0   # 9 documents only
    assert again.add(docs.limit(1), "b")
    assert again.settled().select("n").collect()[0]["n"] == 10
    # a settled key is not counted or stored again
    assert again.add(docs, "c")
    assert again.settled().count() == 1 and again.unsettled(L.key_counts(docs)).count() == 9


def test_levels_stay_few(spark, make_docs):
    docs = make_docs([(i, f"a{i % 40}\nb{i}") for i in range(200)])
    runs = _index(spark, docs, 9, fanout=2)
    levels = Counter(r["level"] for r in runs.runs if r["level"] is not None)
    assert max(levels.values()) == 1 and len(runs.batches) == 9


def test_empty_table(spark, make_docs):
    docs = make_docs([(1, "x")]).where("doc_id = 0")
    runs = _index(spark, docs, 1)
    assert L.drop_lines(docs, runs.settled()).count() == 0


def test_run_side_of_the_anti_join_is_not_shuffled(spark, make_docs):
    docs = make_docs([(i, f"same\nline {i % 5}\nown {i}") for i in range(80)])
    runs = _index(spark, docs, 2, fanout=2)
    plan = runs.unsettled(L.key_counts(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len([r for r in runs.runs if r["level"] is None]) > 0
    assert plan.count("Exchange hashpartitioning") == 1                # the batch's own keys, once
