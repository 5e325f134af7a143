"""Classifiers, Jaccard join, LM scores and search against brute force or held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import EDGE
from vecfactor.llm import bm25_search, jaccard_join, lm_bloom, rule_ensemble, toxicity
from vecfactor.llm.common import table

SF = "/root/testdata/sf0.01"


def words(t):
    return (t or "").encode().lower().split()


# ----------------------------------------------------------------- classifiers

def accuracy(rows, labels):
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50
    return sum(p == y for p, y in held) / len(held)


def test_quality_held_out(spark):
    docs, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = rule_ensemble.quality_scores(docs, lab).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert accuracy(rows, {r["doc_id"]: r["quality"] for r in lab.collect()}) >= 0.97


def test_toxicity_held_out(spark):
    docs, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity_scores(docs, lab).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, {r["doc_id"]: r["toxic"] for r in lab.collect()}) >= 0.95


def test_classifiers_edges(spark, make_docs):
    lab = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for fn in (rule_ensemble.quality_scores, toxicity.toxicity_scores):
        assert fn(make_docs(EDGE), lab).count() == len(EDGE)
        assert fn(make_docs(EDGE), lab.limit(0)).count() == len(EDGE)
        assert fn(make_docs([]), lab).count() == 0
    none = rule_ensemble.quality_scores(make_docs(EDGE), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_path_rules_simplify():
    r = rule_ensemble.PathRule((("a", "<=", 3.0), ("a", "<=", 2.0), ("b", ">", 1.0), ("b", ">", 4.0))).simplified()
    assert r.terms == (("a", "<=", 2.0), ("b", ">", 4.0))


def test_folding():
    assert toxicity.fold("l0ser MORON іdіоt st​upid ｓｃｕｍ") == "loser moron idiot stupid scum"
    assert toxicity.fold("call 2024 or 4317133518190532") == "call 2024 or 4317133518190532"


def test_lexicon_finds_words_stems_and_exceptions():
    rnd = random.Random(1)
    vocab = [f"v{rnd.randrange(10**6)}" for _ in range(300)]

    def text(extra):
        w = [rnd.choice(vocab) for _ in range(40)] + extra
        rnd.shuffle(w)
        return " ".join(w)
    sample = [(text([]), 0) for _ in range(200)] + [(text(["grumbl" + rnd.choice("abcdefgh")]), 1) for _ in range(60)]
    sample += [(text([]) + " hazard sign", 0) for _ in range(30)] + [(text(["hazard"]), 1) for _ in range(150)]
    copied = text(["grumbla"])
    sample += [(copied + f" v{i}", 1) for i in range(20)]
    m = toxicity.fit_lexicon(sample, min_odds=3.0)
    a = m.automaton()
    assert m.evidence("some Grumblz here", a)[1] == 1 and m.evidence("agrumbla", a)[1] == 0
    assert ("hazard", "sign") in m.exceptions and m.evidence("a hazard sign", a)[1] == 0
    assert m.evidence("the h4zard ahead", a)[1] == 1
    assert not set(m.entries) & {w[:7] for w in copied.split() if w.startswith("v")}


def test_mostly_digit_runs_count_as_whole_entries():
    m = toxicity.ToxicModel({"idiot": (2.0, False), "boob": (1.0, True), "boobs": (1.5, False), "ass": (3.0, False)},
                            frozenset({("idiot", "savant"), ("blue", "boobs")}))
    a = m.automaton()
    assert m.evidence("you 1d10t and B00B5!", a) == (3.5, 2)
    assert m.evidence("455 times 8008 or 1d10t9 x1d10t 455.8", a) == (0.0, 0)  # numbers and longer codes
    assert m.evidence("1d10t savant", a)[1] == 0 and m.evidence("a blue  b00b5", a)[1] == 0
    far = " " * 500
    assert m.evidence(f"idiot{far}savant", a)[1] == 0 and m.evidence(f"blue{far}boobs", a)[1] == 0


def test_automaton_equals_naive_matching():
    rnd = random.Random(5)
    entries = {}
    for _ in range(60):
        entries["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))] = (rnd.choice([-2.0, 1.0, 3.0, 0.5]), rnd.random() < .5)
    m = toxicity.ToxicModel(entries)
    a = m.automaton()
    for _ in range(200):
        ws = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 30))]
        total, n = 0.0, 0
        for w in ws:
            found = [(len(e), x) for e, (x, stem) in entries.items() if w == e or (stem and w.startswith(e))]
            if found:
                strongest = max(abs(x) for _, x in found)
                total, n = total + next(x for _, x in sorted(found) if abs(x) == strongest), n + 1
        assert m.evidence(rnd.choice([" ", ", ", "-"]).join(ws), a) == (pytest.approx(total), n)


# ----------------------------------------------------------------- Jaccard join

def brute_components(rows, spec):
    sets = {}
    for d, t in rows:
        w = words(t)
        k = spec.k
        s = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(frozenset(s))
    ids = [d for d in sets if d is not None]
    par = {d: d for d in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    inv = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            c = Counter(e for x in s for e in inv[x])
            for (e, n), m in c.items():
                if spec.den * m >= spec.num * (n + len(s) - m):
                    a, b = find(d), find(e)
                    par[max(a, b)] = min(a, b)
            for x in s:
                inv[x].append((d, len(s)))
    return {d: find(d) for d in ids}


def mutate(rnd, w, p):
    return [f"m{rnd.randrange(10**6)}" if rnd.random() < p else x for x in w]


@pytest.mark.parametrize("spec", [jaccard_join.CONTRACT, jaccard_join.PIPELINE], ids=["k3", "k5"])
def test_components_equal_brute_force(make_docs, spec):
    rnd = random.Random(7)
    rows = list(EDGE)
    base = [f"b{rnd.randrange(500)}" for _ in range(120)]
    # a group around the threshold: links form chains and partial cliques
    rows += [(500 + i, " ".join(mutate(rnd, base, rnd.choice([0.0, 0.01, 0.02, 0.04])))) for i in range(150)]
    rows += [(800 + i, " ".join(base[:20] + [f"z{i}"])) for i in range(40)]       # short texts, common passage
    rows += [(900 + i, " ".join(base[:60] + [f"q{i}w{j}" for j in range(60)])) for i in range(40)]
    rows += [(1000 + i, " ".join(f"r{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 60)))) for i in range(80)]
    rows += [(1003, " ".join(base)), (1004, "one two"), (1005, "ONE  two")]
    got = jaccard_join.similar_components(make_docs(rows), spec).collect()
    want = brute_components(rows, spec)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = defaultdict(set)
    for d, t in rows:
        w = words(t)
        sizes[d].add(len({tuple(w[i:i + spec.k]) for i in range(max(1, len(w) - spec.k + 1))}) if w else 0)
    assert all(r["n_shingles"] in sizes[r["doc_id"]] for r in got)


def test_round_two_tiles(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(mutate(rnd, base, 0.05))) for i in range(120)]
    got = jaccard_join.similar_components(make_docs(rows), jaccard_join.PIPELINE).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, jaccard_join.PIPELINE)


def test_components_of_a_chain_and_empty(spark, make_docs):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["v"]: r["c"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert jaccard_join.similar_components(make_docs([]), jaccard_join.CONTRACT).count() == 0


# ----------------------------------------------------------------- LM scores

def test_lm_scores_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in lm_bloom.lm_scores(docs).collect()}

    def held(d):
        return zlib.crc32(str(d).encode()) % 10 == 0
    uni, bi, ndocs = Counter(), Counter(), 0
    for d, t in rows:
        if not held(d):
            w = words(t) + [None]
            uni.update(w)
            bi.update(zip([0] + w, w))
            ndocs += 1
    N, V, mu = sum(uni.values()), len(uni), 10.0
    better = near = 0
    for d, t in rows:
        w = words(t) + [None]
        r = got[d]
        prior = [(uni[x] + 0.1) / (N + 0.1 * (V + 1)) for x in w]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (
            len(w), sum(uni[x] > 0 for x in w), N, held(d))
        assert math.isclose(r["base_score"], sum(map(math.log10, prior)), rel_tol=1e-9)
        exact = 0.0
        for h, x, p in zip([0] + w, w, prior):
            c = bi[(h, x)]
            ch = ndocs if h == 0 else uni[h]
            exact += math.log10(((2 ** int(math.log2(c)) if c else 0) + mu * p) / (ch + mu))
        near += abs(r["score"] - exact) <= 0.05 * abs(exact) + 1
        assert r["score"] >= exact - 1e-6  # a Bloom filter errs upwards only
        better += r["score"] > r["base_score"]
    assert near > 0.95 * len(rows) and better > 0.8 * len(rows)


def test_lm_passes_equal_one_pass(spark, make_docs):
    rnd = random.Random(2)
    rows = EDGE + [(100 + i, " ".join(rnd.choice(["a", "b", "c", "dd", "e"]) for _ in range(rnd.randrange(40))))
                   for i in range(60)]
    df = make_docs(rows)
    model = lm_bloom.fit_lm(df.select("text"))
    one = lm_bloom.score_texts(df, model, ["doc_id"]).toPandas()
    many = lm_bloom.score_texts(df, model, ["doc_id"], broadcast_bytes=20_000).toPandas()
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    a, b = (x.sort_values(["doc_id", "n_tokens", "score"])[cols].to_numpy(float) for x in (one, many))
    assert np.allclose(a, b, equal_nan=True) and len(a) == len(rows)


def test_lm_edges(make_docs):
    out = lm_bloom.lm_scores(make_docs(EDGE)).collect()
    assert len(out) == len(EDGE) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert [r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm_bloom.lm_scores(make_docs([])).count() == 0


def test_filter_never_understates():
    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = rnd.integers(1, 5000, len(keys))
    data = lm_bloom.build_filter(keys, counts)
    f = lm_bloom.FilterSlice(1, np.array([0]), np.array([8 * len(data)]), np.frombuffer(data, np.uint8))
    level = 1 + np.floor(np.log2(counts)).astype(int)
    assert (f.levels(keys) >= level).all() and (f.levels(keys) > level).mean() < 0.15
    assert (f.levels(rnd.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.15


# ----------------------------------------------------------------- search

def brute_bm25(rows, queries, k):
    tf = [(d, Counter(words(t))) for d, t in rows]
    ln = [sum(c.values()) for _, c in tf]
    n, avg = len(rows), sum(ln) / max(1, len(rows))
    df = Counter(x for _, c in tf for x in c)
    out = {}
    for q, t in queries:
        qc, hits = Counter(words(t)), []
        for (d, c), m in zip(tf, ln):
            s = sum(x * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2 / (c[w] + 1.2 * (.25 + .75 * m / avg))
                    for w, x in qc.items() if w in c)
            if s > 0:
                hits.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(hits)[:k]]
    return out


def test_search_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    queries = [(d, t) for d, t in rows if d % 10 == 0] + [(-1, "the of and"), (-2, "nosuchword"), (-3, None), (-4, "")]
    qdf = spark.createDataFrame(queries, "query_id long, text string")
    for kwargs in ({}, {"shard_docs": 37, "query_block": 7}):
        got = defaultdict(list)
        for r in bm25_search.top_k(docs, qdf, k=5, **kwargs).collect():
            got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
        for q, want in brute_bm25(rows, queries, 5).items():
            mine = sorted(got[q])
            assert [x[0] for x in mine] == list(range(1, len(mine) + 1))
            assert len(mine) == len(want) and np.allclose([x[2] for x in mine], [s for _, s in want], atol=2e-6)
            assert all(x[1] == d or math.isclose(x[2], s, abs_tol=2e-6) for x, (d, s) in zip(mine, want))


def test_search_edges(make_docs):
    df = make_docs([(d, t) for d, t in EDGE if d is not None])
    assert bm25_search.search_documents(df, every=2).where("rank > 10").count() == 0
    assert bm25_search.search_documents(make_docs([])).count() == 0


def one_shard(rows, queries):
    """The rows as one loaded shard, the queries as (terms, tfs) over their vocabulary, and every list's length."""
    words_of = lm_bloom.WordHash()
    docs = [np.unique(words_of.of(t), return_counts=True) for _, t in rows]
    lens = [int(c.sum()) for _, c in docs]
    asked = [np.unique(words_of.of(t), return_counts=True) for t in queries]
    vocab = np.unique(np.concatenate([u for u, _ in asked]))
    df = sum(np.isin(vocab, u).astype(int) for u, _ in docs)
    idf = np.log(1 + (len(rows) - df + .5) / (df + .5))
    batch = bm25_search._index_row([d for d, _ in rows], lens, [u for u, _ in docs], [c for _, c in docs])
    shard = bm25_search.Shard({c: v[0] for c, v in batch.to_pydict().items()}, sum(lens) / len(rows), vocab, idf)
    return shard, [(np.searchsorted(vocab, u), c) for u, c in asked], df


def test_search_skips_postings(spark):
    """Whole documents as queries: results equal brute force, and less is read than all their terms' lists."""
    rows = [(d, t) for d, t in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
            if t and d is not None]
    queries = rows[::100]
    shard, asked, df = one_shard(rows, [t for _, t in queries])
    read = full = 0
    brute = brute_bm25(rows, queries[:10], 10)
    for x, ((q, _), (terms, tfs)) in enumerate(zip(queries, asked)):
        hits, score = shard.search(terms, tfs, 10, 0.0)
        if x < 10:
            assert np.allclose(score, [s for _, s in brute[q]], atol=2e-6)
        shard.scanned = 0
        again, same = shard.search(terms, tfs, 10, score[-1])  # the threshold of another shard
        assert (again == hits).all() and (same == score).all()
        read, full = read + shard.scanned, full + df[terms].sum()
    assert read < 0.75 * full


def test_long_lists_kept_as_rows_are_bounded(spark, monkeypatch):
    """op8: long lists are rows of impacts within a bound, and results do not depend on how many are."""
    rows = [(d, f"common words here w{d % 3} x{d % 11} " + f"rare{d % 97} " * (1 + d % 4)) for d in range(1500)]
    queries = [t for _, t in rows[::150]] + ["common common words x1", "rare5"]
    want = None
    for cells in (8_000_000, 4 * 1536, 0):
        monkeypatch.setattr(bm25_search, "DENSE_CELLS", cells)
        shard, asked, _ = one_shard(rows, queries)
        assert shard.dense.size <= cells and (len(shard.bmax) > 4) == (cells > 4 * 1536)
        got = [[x.tolist() for x in shard.search(terms, tfs, 10, 0.0)] for terms, tfs in asked]
        assert want is None or got == want
        want = got
    for (_, score), hits in zip(want, brute_bm25(rows, list(enumerate(queries)), 10).values()):
        assert np.allclose(score, [s for _, s in hits], atol=2e-6)


def test_ties_do_not_depend_on_shards(spark):
    """Scores that differ below the sixth digit are ties, in one shard and over many."""
    rows = [(d, f"alpha beta {'pad ' * (d % 3)}") for d in range(60, 0, -1)] + [(None, "alpha beta ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    qdf = spark.createDataFrame([(1, "beta alpha"), (2, "alpha alpha pad")], "query_id long, text string")
    runs = [sorted(map(repr, bm25_search.top_k(docs, qdf, k=7, **kwargs).collect()))
            for kwargs in ({}, {"shard_docs": 1}, {"shard_docs": 5, "seed_every": 2})]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 14
    got = {r["rank"]: r["doc_id"] for r in bm25_search.top_k(docs, qdf, k=7).where("query_id = 1").collect()}
    assert got == {1: None, 2: 3, 3: 6, 4: 9, 5: 12, 6: 15, 7: 18}


def test_repeated_query_ids(spark, make_docs):
    rows = [(100 + i, f"alpha beta w{i} " + "alpha " * (i % 5)) for i in range(30)]
    rows += [(50, "alpha beta")] * 3 + [(7, "gamma delta"), (8, "gamma")]
    docs = make_docs(rows).select("doc_id", "text")
    hits = bm25_search.search_documents(docs, every=50, k=10).where("query_id = 50").collect()
    assert sorted(r["rank"] for r in hits) == list(range(1, 11))
    want = brute_bm25(rows, [(50, "alpha beta")], 10)[50]
    assert np.allclose([r["score"] for r in sorted(hits, key=lambda r: r["rank"])], [s for _, s in want], atol=2e-6)
    assert sum(r["doc_id"] == 50 for r in hits) == sum(d == 50 for d, _ in want)
    # different words under one id, and a null id
    queries = [(1, "alpha beta"), (1, "delta gamma"), (1, "gamma  DELTA"), (None, "gamma")]
    qdf = spark.createDataFrame(queries, "query_id long, text string")
    for kwargs in ({}, {"query_block": 1}):
        got = bm25_search.top_k(docs, qdf, k=4, **kwargs).collect()
        one = [(r["rank"], r["doc_id"]) for r in got if r["query_id"] == 1]
        assert sorted(k for k, _ in one) == [1, 1, 2, 2, 3, 4] and {(1, 7), (2, 8)} <= set(one)
        assert sorted((r["rank"], r["doc_id"]) for r in got if r["query_id"] is None) == [(1, 8), (2, 7)]
