import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import EDGE
from vecfactor.llm import periodic_runs as R


def brute(w, min_length=24):
    """(start, length, period) straight from the definition."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i:j + q]
            if len(s) >= max(min_length, 3 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def local_runs(w):
    """The operator's steps on one text, stitched in Python."""
    found = {}
    for t in R.tiles(np.array(w, np.int64)):
        for q, lo, hi in R.solve(*t):
            found.setdefault(q, []).append((lo, hi))
    out = []
    for q, parts in found.items():
        merged = []
        for lo, hi in sorted(parts):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out += [(lo, hi - lo + q, q) for lo, hi in merged if hi - lo + q >= max(24, 3 * q)]
    return sorted(out)


def _random_text(rng):
    w = []
    while len(w) < rng.choice([20, 60, 200, 500]):
        kind = rng.random()
        if kind < 0.4:
            w += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(40))]
        else:
            size = rng.choice([1, 2, 3, 5, 8, 13, 16, 31, 40, 64])
            unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(size)]
            w += unit * rng.randrange(1, 8) + unit[:rng.randrange(len(unit) + 1)]
    return w


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert R.z_function(s).tolist() == want


def test_tiles_find_every_run():
    rng = random.Random(7)
    n = 0
    for _ in range(400):
        w = _random_text(rng)
        assert local_runs(w) == brute(w)
        n += len(brute(w))
        first = np.array([0, len(w)])
        if brute(w):
            assert R.open_texts(np.array(w), first).all()          # the first test has no false negatives
    assert n > 300


def test_plain_texts_stay_closed():
    rng = random.Random(3)
    docs = [[rng.randrange(200) for _ in range(rng.randrange(300))] for _ in range(50)] * 2   # copies side by side
    number = np.array([x for d in docs for x in d])
    assert not R.open_texts(number, np.cumsum([0] + [len(d) for d in docs])).any()


def _rows():
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in _random_text(rng))) for i in range(120)]
    long = " ".join(["alpha beta gamma"] * 400 + [f"x{i}" for i in range(500)] + ["same"] * 900)
    rows += EDGE[:6] + EDGE[8:]
    return rows + [(500, long), (500, long), (None, long), (None, "a\tb\nc\x0bd " * 9), (501, "Ü ü " * 20)]


def test_report_against_brute_force(spark, make_docs):
    rows = _rows()
    got = sorted((tuple(r) for r in R.run_report(make_docs(rows)).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)


def test_very_long_text_and_empty_table(spark, make_docs):
    long = " ".join([f"u{i % 997}" for i in range(40_000)] + ["z"] * 30_000)
    row = R.run_report(make_docs([(None, long)])).collect()[0]
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (2, 40_000, 30_000, 1)
    assert R.run_report(make_docs([(1, "x")]).where("doc_id = 0")).count() == 0


def test_general_runs(spark):
    docs = spark.createDataFrame([(0, None, "a b " * 20), (1, None, "p " + "q r s " * 9)],
                                 "rid long, doc_id long, text string")
    assert sorted(tuple(r) for r in R.find_runs(docs).collect()) == [(0, 0, 40, 2), (1, 1, 27, 3)]
    assert [tuple(r) for r in R.find_runs(docs, min_length=30).collect()] == [(0, 0, 40, 2)]
    with pytest.raises(ValueError):
        R.find_runs(docs, min_length=9)
