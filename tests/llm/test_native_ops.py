"""Packing, preference formatting, mixing, quality rules and sharding against plain Python."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOC_SCHEMA, EDGE
from vecfactor.llm import chat, mixing, packing, quality_rules, rule_ensemble, sharding, text_stats

W = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


# ----------------------------------------------------------------- packing

def padding_of(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist)


def best_padding(hist, k):
    from itertools import combinations
    lengths = [x for x, _ in hist]
    inner = lengths[:-1]
    return min(padding_of(hist, list(cut) + [lengths[-1]])
               for m in range(min(k, len(lengths))) for cut in combinations(inner, m))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    rnd = random.Random(seed)
    hist = sorted({rnd.randrange(0, 300): rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 11))}.items())
    for k in (1, 2, 3, 5):
        bounds, pad = packing.choose_bounds(hist, k)
        assert len(bounds) <= k and bounds[-1] == hist[-1][0]
        assert pad == padding_of(hist, bounds) == best_padding(hist, k)


def test_no_bounds_without_rows():
    assert packing.choose_bounds([], 4) == ([], 0)


def test_packing(make_docs):
    rows = EDGE + [(100 + i, "tok " * (i % 40)) for i in range(400)]
    out = packing.pack_documents(make_docs(rows), buckets=5, budget=200).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted(
        (d is None, d or 0, len(W.findall(t or ""))) for d, t in rows)
    batches = defaultdict(list)
    for r in out:
        assert 0 <= r["padding"] == r["bound"] - r["n_tokens"]
        batches[(r["bucket"], r["batch"])].append(r)
    for (bucket, batch), rs in batches.items():
        assert len(rs) == 1 or rs[0]["bound"] * len(rs) <= 200
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        full = max(1, 200 // max(1, rs[0]["bound"]))
        assert len(rs) == full or (bucket, batch + 1) not in batches
    hist = sorted(Counter(len(W.findall(t or "")) for _, t in rows).items())
    # lengths above exact_to fall into bins of 1/1024
    assert sum(r["padding"] for r in out) <= packing.choose_bounds(hist, 5)[1] * 1.01 + 1


def test_length_bins(spark):
    xs = [0, 1, 4096, 4097, 5000, 8191, 8192, 8193, 1_000_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "n long")
           .select(packing.length_bin(F.col("n"))).collect()]
    assert got[:3] == xs[:3] and all(x <= g <= x * 1.002 for x, g in zip(xs, got))


# ----------------------------------------------------------------- preference formatting

def turns(pair, side, items):
    return [(pair, side, i, r, t) for i, (r, t) in enumerate(items)]


TURN_SCHEMA = "pair_id long, side string, turn long, role string, text string"


def reference_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def render(ts):
        s, spans = "", []
        for r, t in ts:
            s += f"<|{r}|>\n"
            if r == "assistant":
                spans.append((len(s), len(s) + len(t)))
            s += t + "<|end|>\n"
        return s, spans
    return n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:])


def test_preference_pairs(spark):
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(150)]
    cases = {1: ([("user", "hi"), ("assistant", "good")], [("user", "hi"), ("assistant", "bad")]),
             2: ([("user", "a")], [("user", "b")]),
             3: ([("user", "a"), ("assistant", "same")], [("user", "a"), ("assistant", "same")]),
             4: ([("system", "s"), ("user", "ü — x"), ("assistant", "")], [("system", "s"), ("user", "ü — x")]),
             5: (long, long[:100] + [("assistant", "other")])}
    data = [x for p, (c, r) in cases.items() for x in turns(p, "chosen", c) + turns(p, "rejected", r)]
    data += data[:3]  # repeated rows
    got = defaultdict(list)
    for r in chat.preference_pairs(spark.createDataFrame(data, TURN_SCHEMA), block_turns=64).collect():
        got[r["pair_id"]].append(r)
    for p, (c, r) in cases.items():
        rows = sorted(got[p], key=lambda x: x["block"])
        n, prompt, cs, cm, rs, rm = reference_pair(c, r)
        assert [x["block"] for x in rows] == list(range((max(len(c), len(r)) - 1) // 64 + 1))
        assert all(x["n_prompt"] == n for x in rows)
        assert "".join(x["prompt"] for x in rows) == prompt
        assert "".join(x["chosen"] for x in rows) == cs and "".join(x["rejected"] for x in rows) == rs
        for side, full in (("chosen", cm), ("rejected", rm)):
            at, spans = 0, []
            for x in rows:
                spans += [(at + m["start"], at + m["end"]) for m in x[side + "_mask"]]
                at += len(x[side])
            assert spans == full


def test_preference_nulls_and_empty(spark):
    rows = [(None, "chosen", 0, None, None), (None, "rejected", 0, None, None), (7, "chosen", None, "user", "x"),
            (8, "rejected", 0, "assistant", "only")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(rows, TURN_SCHEMA)).collect()}
    assert got[None]["prompt"] == "<|unknown|>\n<|end|>\n" and got[None]["chosen"] == ""
    assert got[7]["n_prompt"] == 0 and got[7]["chosen"] == "<|user|>\nx<|end|>\n" and got[7]["rejected"] == ""
    assert [tuple(m) for m in got[8]["rejected_mask"]] == [(14, 18)]
    assert chat.preference_pairs(spark.createDataFrame([], TURN_SCHEMA)).count() == 0


def test_pairs_from_conversations(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a b c d"), (1, 2, "user", "bye"),
                                  (2, 0, "user", "only"), (2, 1, "user", "more"), (None, None, None, None)],
                                 "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["side"], r["turn"]): r["text"] for r in chat.pairs_from_conversations(conv).collect()}
    assert got[(1, "rejected", 1)] == "a b" and (1, "rejected", 2) not in got
    assert got[(2, "rejected", 0)] == "only" and (2, "rejected", 1) not in got
    assert chat.preference_digest(conv).count() == 3
    assert chat.preference_digest(conv.limit(0)).count() == 0


# ----------------------------------------------------------------- mixing

def test_raking_meets_marginals(spark):
    rnd = random.Random(3)
    cells = [(f"s{i}", f"l{j}", f"t{k}", rnd.randrange(1, 500)) for i in range(4) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, cell_tokens long")
    exps = {"source": 0.7, "lang": 0.5, "topic": 0.0}
    raked = mixing.rake(mixing.power_targets(df, exps), list(exps), sweeps=30).collect()
    assert math.isclose(sum(r["weight"] for r in raked), 1.0, abs_tol=1e-9)
    for dim, e in exps.items():
        tok = Counter()
        w = Counter()
        for r in raked:
            tok[r[dim]] += r["cell_tokens"]
            w[r[dim]] += r["weight"]
        total = sum(v ** e for v in tok.values())
        assert all(math.isclose(w[x], tok[x] ** e / total, abs_tol=1e-6) for x in tok)


def test_given_targets_and_rate(spark):
    df = spark.createDataFrame([("a", 100), ("b", 300), (None, 600)], "source string, cell_tokens long")
    t = spark.createDataFrame([("a", 0.5), (None, 0.5)], "value string, share double")
    cells = mixing.rake(mixing.given_targets(df, {"source": t}), ["source"], sweeps=2)
    rate = mixing.sampling_rate(cells, 0.4)
    p = {r["source"]: r["prob"] for r in mixing.cell_probability(cells, rate).collect()}
    assert p["b"] == 0.0 and math.isclose(p["a"], 1.0) and math.isclose(p[None], 0.5)
    assert math.isclose(p["a"] * 100 + p[None] * 600, 400)
    assert mixing.sampling_rate(cells, 1.0) == math.inf


def test_mix_documents_edges(make_docs, spark):
    rows = EDGE + [(100 + i, "word " * (1 + i % 50)) for i in range(300)]
    df = make_docs(rows)
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows) and all(0 <= r["prob"] <= 1 for r in out)
    kept = sum(r["n_tokens"] for r in out if r["kept"])
    expected = sum(r["n_tokens"] * r["prob"] for r in out)
    total = sum(r["n_tokens"] for r in out)
    assert math.isclose(expected, 0.5 * total, rel_tol=1e-6) and 0 < kept < total
    ids = Counter(r["doc_id"] for r in out if r["kept"])
    back = mixing.mixed_rows(df)
    assert back.columns == df.columns and Counter(r["doc_id"] for r in back.collect()) == ids
    empty = make_docs([])
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


# ----------------------------------------------------------------- quality rules

def reference_stats(t):
    t = t or ""
    w = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    cov = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))


def test_quality_report(make_docs):
    rows = EDGE + [(200, "x y z x y z x y"), (201, "l one\nl one\n\n \nl two\nl one"), (202, "\x0b a\x0cb c\x85d \r")]
    rows += [(300 + i, " ".join(random.Random(i).choice(["a", "bb", "ccc", "d\n"]) for _ in range(i))) for i in range(60)]
    got = defaultdict(list)
    for r in quality_rules.quality_report(make_docs(rows)).collect():
        got[r["doc_id"]].append(r)
    for d, t in rows:
        r = got[d][0]
        s = reference_stats(t)
        assert tuple(r[1:6]) == s, (d, tuple(r), s)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality_rules.quality_report(make_docs([])).count() == 0


def test_cascade_order_changes_no_verdict(make_docs):
    rows = EDGE + [(400 + i, f"clean text number {i} " + " ".join(f"word{(i * 31 + j * 7) % 400}" for j in range(80)))
                   for i in range(30)]
    df = make_docs(rows)
    rules = quality_rules.production_rules()
    a = sorted(r["doc_id"] for r in quality_rules.cascade_filter(df, rules).collect())
    b = sorted(r["doc_id"] for r in quality_rules.cascade_filter(df, rules[::-1]).collect())
    kept = sorted(r["doc_id"] for r in quality_rules.quality_report(df).where("kept").collect())
    assert a == b == kept and set(range(400, 430)) <= set(a)
    assert quality_rules.cascade_filter(df, rules).columns == df.columns
    plan = quality_rules.plan_cascade(df, rules)
    rate = [rej / cost for _, cost, rej in plan]
    assert rate == sorted(rate, reverse=True) and {r.name for r, _, _ in plan} == {r.name for r in rules}


def test_rejected_rows_are_not_evaluated_by_later_rules(make_docs):
    """The last rule fails the job if it ever sees a text of fewer than 50 words."""
    rows = EDGE + [(400 + i, " ".join(f"word{(i * 31 + j * 7) % 400}" for j in range(80))) for i in range(9)]
    df = make_docs(rows)

    def prepare(d):
        seen = F.when(F.col("_w").isNotNull() & (F.size("_w") < 50),
                      F.raise_error(F.lit("a rejected row was evaluated")))
        return d.withColumn("_costly", F.when(seen.isNull(), F.size("_w")))
    costly = quality_rules.Rule("costly", lambda: F.col("_costly") > 10_000, prepare)
    rules = [quality_rules.length_rule(), quality_rules.symbol_rule(), costly]
    kept = {r["doc_id"] for r in quality_rules.cascade_filter(df, rules).collect()}
    assert set(range(400, 409)) <= kept and not kept & {1, 2, 3, 4, 7, 8, 10}
    d = text_stats.add_word_stats(df.select("doc_id", "text"))
    assert {r["doc_id"] for r in quality_rules.cascade_verdict(d, rules).where("kept").collect()} == kept
    with pytest.raises(Exception, match="a rejected row was evaluated"):
        quality_rules.cascade_filter(df, rules[::-1]).collect()


def test_filters_on_results_do_not_repeat_the_work(make_docs):
    """A filter on a result column costs about what the results themselves cost."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    docs = make_docs([(i, long) for i in range(3)])
    rule = rule_ensemble.PathRule((("log_words", ">", 1.0), ("repeat_ratio", "<=", 0.5)))
    model = rule_ensemble.RuleModel(0.1, [(rule, 1.0)])
    scored = rule_ensemble.with_score(docs, model)
    d = text_stats.add_word_stats(docs.select("doc_id", "text"))
    verdict = quality_rules.cascade_verdict(d, quality_rules.production_rules())
    for df, cond in ((verdict, "kept"), (verdict, "NOT kept"), (scored, "score > 0.5"), (d, "n_repeat_words > 1")):
        df.count()
        t = [0.0, 0.0]
        for i, x in enumerate((df, df.where(cond))):
            for _ in range(2):
                t0 = time.perf_counter()
                x.write.format("noop").mode("overwrite").save()
                t[i] = time.perf_counter() - t0
        assert t[1] < 3 * t[0] + 1.0


def test_cascade_order_is_stable(make_docs):
    rows = [(i, " ".join(f"word{(i * 31 + j * 7) % 400}" for j in range(10 + i % 90))) for i in range(400)]
    rows += [(1000 + i, "### " * 60) for i in range(60)] + [(2000 + i, "same three words " * 40) for i in range(50)]
    df = make_docs(rows)
    orders = [[r.name for r, _, rej in quality_rules.plan_cascade(df, quality_rules.production_rules()) if rej > 0]
              for _ in range(5)]
    assert all(o == orders[0] for o in orders) and orders[0][0] == "length"


# ----------------------------------------------------------------- sharding

def check_rows_law(out, shards):
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))


def test_shards(make_docs):
    rows = EDGE + [(1000 + i, f"text {i}") for i in range(500)] + [(77, "hot")] * 250
    out = sharding.shard_documents(make_docs(rows)).collect()
    check_rows_law(out, 24)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard_documents(make_docs([])).count() == 0
    few = sharding.shard_documents(make_docs([(1, "a"), (2, "b")])).collect()
    check_rows_law(few, 24)


@pytest.mark.parametrize("epsilon", [0.0, 0.1, 5.0])
def test_rows_follow_the_ring(spark, epsilon):
    """Every row alone, in plain Python: the first point clockwise of its key, or the next whose shard has room."""
    shards, vnodes = 7, 20
    df = spark.range(900).select(F.concat(F.lit("k"), "id").alias("key"))
    at = {r["key"]: r["p"] for r in df.select("key", F.xxhash64("key", F.lit(False)).alias("p")).collect()}
    points = sharding.ring_points(shards, vnodes)
    cap = [900 // shards + (s < 900 % shards) for s in range(shards)] if not epsilon else \
        [math.ceil(900 * (1 + epsilon) / shards)] * shards
    used, want, waiting = [0] * shards, {}, []
    first = {k: next((i for i, (q, _) in enumerate(points) if q >= p), 0) for k, p in at.items()}
    for k in sorted(at, key=lambda k: (first[k], at[k])):
        s = points[first[k]][1]
        if used[s] < cap[s]:
            want[k], used[s] = s, used[s] + 1
        else:
            waiting.append(k)
    for k in waiting:
        i = first[k]
        while used[points[i % len(points)][1]] >= cap[points[i % len(points)][1]]:
            i += 1
        want[k] = points[i % len(points)][1]
        used[want[k]] += 1
    got = {r["key"]: r["shard"] for r in sharding.ring_shard(df, "key", shards, vnodes, epsilon).collect()}
    assert got == want and bool(waiting) == (epsilon < 5)


def test_ring_moves_little_and_points_stay(spark):
    assert set(sharding.ring_points(6, 50)) < set(sharding.ring_points(7, 50))
    df = spark.range(6000).withColumnRenamed("id", "key")
    a = {r["key"]: r["shard"] for r in sharding.ring_shard(df, "key", 12, vnodes=200, max_group_rows=40).collect()}
    b = {r["key"]: r["shard"] for r in sharding.ring_shard(df, "key", 13, vnodes=200, max_group_rows=40).collect()}
    moved = sum(a[k] != b[k] for k in a)
    assert 6000 // 13 - 5 <= moved < 6000 * 0.25
    loose = Counter(r["shard"] for r in sharding.ring_shard(df, "key", 12, vnodes=200, epsilon=0.1).collect())
    assert max(loose.values()) <= math.ceil(6000 * 1.1 / 12) and sum(loose.values()) == 6000


def test_place_covers_every_row():
    rnd = random.Random(5)
    for _ in range(50):
        pts = sharding.ring_points(rnd.randrange(1, 6), rnd.randrange(1, 8))
        shards = max(s for _, s in pts) + 1
        counts = [rnd.choice([0, 1, 3, 40]) for _ in pts]
        caps = sharding.capacities(sum(counts), shards, 0.0)
        ranges = sharding.place(pts, counts, caps)
        used = Counter()
        for a, lo, hi, s, slot in sorted(ranges, key=lambda x: (x[3], x[4])):
            assert slot == used[s]
            used[s] += hi - lo
        assert [used[s] for s in range(shards)] == caps
        for a, n in enumerate(counts):
            spans = sorted((lo, hi) for x, lo, hi, _, _ in ranges if x == a)
            assert sum(h - l for l, h in spans) == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_schema_constant_matches_documents(spark):
    assert [f.name for f in DOC_SCHEMA] == spark.read.parquet(f"{SF}/documents.parquet").columns
