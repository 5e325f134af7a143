import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE
from vecfactor.llm import phrases as P


def brute(rows, k, least=10, contained=50):
    f, total, long = Counter(), Counter(), defaultdict(int)
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, w), a in cand.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                long[lang, part] = max(long[lang, part], a)
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * long.get((lang, w), -1) >= contained * a:
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:i]] * f[lang, w[i:]]), i) for i in range(1, len(w))]
        s, i = min(cuts)
        out[lang].append((-s, -a, " ".join(w).encode(), f[lang, w[:i]], f[lang, w[i:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(x)[:k]))


def _rows(seed=1, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ÑU", "Big", "big"]
    fixed = ["alpha beta gamma", "New York", "new york city", "a b c", "x y", "x y z", "p q r s t"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else vocab[int(rng.random() ** 3 * len(vocab))])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", t) for _, t in EDGE] + [(None, None)]


def _docs(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for c in ("n", "w", "score", "rank", "a", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("k,slack,bitmap_bytes", [(2000, 2, 16 << 20), (7, 1, 16 << 20), (3, 1, 8)])
def test_against_brute_force(spark, k, slack, bitmap_bytes):
    rows = _rows()
    out = P.mine_phrases(_docs(spark, rows), k=k, slack=slack, bitmap_bytes=bitmap_bytes)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, k)
    assert out.count() == (60 if k > 60 else 3 * k)


def test_later_waves_settle_what_the_first_cannot(spark):
    """Every best pair lies inside a triple, so the first floor leaves too few survivors."""
    rows = [("en", f"a{i} b{i} c{i}. " * 12) for i in range(40)]
    rows += [("en", f"d{i} e{i}. d{i} z. e{i} z. " * 12) for i in range(9)]
    got = sorted(tuple(r) for r in P.mine_phrases(_docs(spark, rows), k=45, slack=1).collect())
    assert got == brute(rows, 45)


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_019, 3_000_000_037, 3_000_000_041), (10, 10, 11)], "a long, l long, r long")
    assert [r[0] for r in df.select(P.score("a", "l", "r")).collect()] == [
        10**6 * 3_000_000_019**2 // (3_000_000_037 * 3_000_000_041), 10**6 * 100 // 110]


def test_empty_table(spark):
    assert P.mine_phrases(_docs(spark, _rows()).where("doc_id < 0")).count() == 0
    assert P.mine_phrases(_docs(spark, [("en", None), ("en", "few words")])).count() == 0


def test_long_text_is_cut_at_separators():
    text = ("word " * 1000 + ". ").encode() * (2 * P.SLICE // 5000)
    parts = list(P._cuts(text))
    assert len(parts) > 1 and b"".join(parts) == text and all(p.endswith(b".") for p in parts[:-1])
    assert b"".join(P._cuts(b"a " * P.SLICE)) == b"a " * P.SLICE       # without a separator: one piece
