"""Runs of repeated words: stretches that repeat a period three times or more.

A *run* is a stretch of consecutive words with smallest period q (words q apart
are identical) and length at least ``max(min_length, 3 q)`` that no neighbouring
word extends keeping period q. All runs of every text are found exactly, in
O(n log n) work for n words:

1. **Tiles by octave.** Periods are taken in octaves [S/2, S), S = 16, 32, ...
   (the first is [1, 16)). The words matching the word q further on form an
   interval of at least S places, so it holds a multiple of S; at such a boundary
   b the text also repeats S/2 words at a distance of the octave. That test is
   made with rolling hashes for all boundaries at once; it has no false
   negatives. Texts without such a boundary have no run and are done in their
   first pass. The others are written with a row number, and every boundary found
   becomes a tile: the words from b - S to b + 2 S.
2. **Boundary Z-functions.** Each tile is solved on its own: the Z-function of the
   words after b and that of the reversed words before b give, for every q of the
   octave, how far the match reaches to either side, exactly (words, not hashes),
   up to the tile's ends. Periods that are multiples of a smaller one are dropped.
3. **Stitching.** Fragments are shuffled by (document, period); overlapping ones
   are one interval, and intervals that are long enough are runs.

Texts are read in slices of ``SLICE`` bytes, so a task's memory is bounded by that
and its longest text; the tiles of a long text are spread over all tasks, each
with a bounded number of words (4 S for its octave S).

Results: a null or empty text has no words and no run; any two rows are documents
of their own, also with equal or null ids (a null id takes no part in the
contract's rewriting); of runs with equal exponent the one that starts first, then
the shorter period counts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.tokens import U64, as_bytes, byte_classes, mix, powers, sliced, words
from vecfactor.session import shared_path

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
_CLASSES = byte_classes(SPACE_BYTES)
_BASE = 0xD6E8FEB86659FD93
SLICE = 2 << 20
MIN_LENGTH = 24
FIRST = 16  # the first octave takes periods 1 to 15


def least(q, min_length: int = MIN_LENGTH):
    """Shortest run of period q."""
    return np.maximum(min_length, 3 * q)


# ----------------------------------------------------------------- texts as numbers

def rewritten(n: int, doc_id: int | None) -> np.ndarray:
    """For each word's place, the original place whose word stands there: every tenth
    id (by checksum) repeats a stretch from some word to its end."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def doc_words(texts: list[bytes | None], ids: list, rewrite: bool):
    """(distinct words, their numbers in text order, first place of each text and the end)."""
    data = b" ".join(t or b"" for t in texts)
    begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    distinct, number, start = words(data, _CLASSES)
    first = np.searchsorted(start, begin)
    if rewrite:
        number = number.copy()
        for i, d in enumerate(ids):
            lo, hi = first[i], first[i + 1]
            if hi > lo and d is not None and zlib.crc32(str(d).encode()) % 10 == 0:
                number[lo:hi] = number[lo + rewritten(hi - lo, d)]
    return distinct, number, first


# ----------------------------------------------------------------- boundaries

def _hits(values: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(S, boundaries): multiples b of S where the text repeats the S/2 words from b on,
    or those before b, at a distance of the octave of S; S up to ``top``."""
    n = len(values)
    up, down = powers(_BASE, n + 1), powers(pow(_BASE, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=sums[1:])
    size = FIRST
    while size <= top:
        k, q0 = size // 2, 1 if size == FIRST else size // 2
        if n > k:
            grams = (sums[k:] - sums[:-k]) * down[:n - k + 1]
            count = -(-n // size)
            pad = np.zeros(k + count * size + 2 * size, U64)   # place i of the text at k + i
            pad[k:k + len(grams)] = grams
            at = np.arange(count) * size
            found = np.zeros(count, bool)
            for off in (k, 0):                                  # words from b on; words before b
                own = pad[off:off + count * size:size]
                far = np.lib.stride_tricks.as_strided(pad[off + q0:], (count, size - q0), (size * 8, 8),
                                                      writeable=False)
                there = (at + off >= k) & (at + off < k + len(grams))
                found |= (far == own[:, None]).any(axis=1) & there
            yield size, at[found]
        size *= 2


def _top(n: int) -> int:
    """The largest octave that a text of n words can have a run of (3 q <= n)."""
    size = FIRST
    while 3 * size <= n:
        size *= 2
    return size


def open_texts(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each text has any boundary to look at; all texts at once."""
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    place = np.arange(len(number)) + doc                        # a word of its own after each text
    values = np.empty(len(number) + n_docs, U64)
    values[place] = mix(number.astype(U64) + U64(1))
    values[first[1:] + np.arange(n_docs)] = mix(np.arange(n_docs, dtype=U64) + U64(1 << 40))
    out = np.zeros(n_docs, bool)
    longest = int(np.diff(first).max(initial=0))
    end = first[1:] + np.arange(1, n_docs + 1)
    if longest >= MIN_LENGTH:
        for _, at in _hits(values, _top(longest)):
            out[np.searchsorted(end, at, side="right")] = True
    return out


def tiles(number: np.ndarray, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(S, b, first place, words) of one text's tiles."""
    if len(number) >= min_length:
        for size, at in _hits(mix(number.astype(U64) + U64(1)), _top(len(number))):
            for b in at:
                lo = max(0, b - size)
                yield size, int(b), int(lo), number[lo:b + 2 * size]


# ----------------------------------------------------------------- one tile

def z_function(s: list) -> np.ndarray:
    """z[i]: how many symbols from i on equal those from 0 on (z[0] is the length)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > hi:
            lo, hi = i, i + k
        z[i] = k
    return np.array(z, dtype=np.int64)


def solve(size: int, b: int, lo: int, text: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(q, from, to): the places around b that match q further on, for the primitive
    periods q of the octave; cut at the tile's ends."""
    text = text.tolist()
    c = b - lo                                                  # b inside the tile
    right = z_function(text[c:])
    q = np.arange(1 if size == FIRST else size // 2, min(size, len(right)))
    if not len(q):
        return []
    r = np.minimum(right[q], size)
    q, r = q[r > 0], r[r > 0]
    if not len(q):
        return []
    end = min(len(text), c + size)                              # b + q lies before it
    before = text[:c][::-1]
    left_z = z_function([*before, None, *text[:end][::-1]])
    left = np.minimum(left_z[len(before) + 1 + end - (c + q)], size)
    long = (left + r >= least(q, min_length) - q) | (r >= size) | (left >= size)
    # q is a multiple of a smaller period d if its first q words have period d and d divides q
    again = np.zeros(size, bool)
    for d in np.flatnonzero(right[:size // 2 + 1] + np.arange(min(len(right), size // 2 + 1)) >= q[0]):
        if d and not again[d]:
            again[2 * d:min(size, right[d] + d + 1):d] = True
    keep = long & ~again[q]
    return list(zip(q[keep].tolist(), (b - left[keep]).tolist(), (b + r[keep]).tolist(), strict=True))


# ----------------------------------------------------------------- jobs

def text_tiles(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """(rid, size, b, lo, words): the tiles of the texts of (rid, doc_id, text)."""
    def run(batches):
        for batch in batches:
            rids, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for i, j in sliced([len(t or b"") for t in texts], SLICE):
                _, number, first = doc_words(texts[i:j], ids[i:j], rewrite)
                for k in range(j - i):
                    rows, held = [], 0
                    for t in tiles(number[first[k]:first[k + 1]]):
                        rows.append(t)
                        held += len(t[3])
                        if held > 500_000:
                            yield _tile_batch(rids[i + k], rows)
                            rows, held = [], 0
                    if rows:
                        yield _tile_batch(rids[i + k], rows)
    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, size int, b int, lo int, words binary")


def _tile_batch(rid: int, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([rid] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], pa.int32()) for i in range(3)],
         pa.array([r[3].astype("<i4").tobytes() for r in rows], pa.binary())], ["rid", "size", "b", "lo", "words"])


def fragments(tiled: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(rid, q, lo, hi): matching places found in each tile."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256).to_pylist(), []
                for t in part:
                    out += [(t["rid"], *f) for f in solve(t["size"], t["b"], t["lo"],
                                                          np.frombuffer(t["words"], "<i4"), min_length)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[k] for o in out], pa.int64() if k == 0 else pa.int32()) for k in range(4)],
                        ["rid", "q", "lo", "hi"])
    return tiled.mapInArrow(run, "rid long, q int, lo int, hi int")


def stitched(found: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(rid, start, length, period): runs from overlapping fragments of one period."""
    w = Window.partitionBy("rid", "q").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reach, 0).otherwise(1)
    part = found.withColumn("_new", new).withColumn("_part", F.sum("_new").over(w))
    whole = part.groupBy("rid", "q", "_part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("q")
    return (whole.select("rid", "start", length.alias("length"), F.col("q").alias("period"))
            .where(F.col("length") >= F.greatest(F.lit(min_length), 3 * F.col("period"))))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run, or in the first period of each run that holds them."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def best_run(runs: list[tuple[int, int, int]]):
    """The run of greatest length / period; ties: smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _digest(distinct: list, number: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    best = best_run(runs)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2], r[1])))
    kept = number[collapsed(len(number), runs)]
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join([distinct[w] for w in kept])).hexdigest())


def _digest_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]


def _first_pass(rewrite: bool):
    """Texts without a boundary get their result; the others keep their text."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, j in sliced([len(t or b"") for t in texts], SLICE):
                distinct, number, first = doc_words(texts[i:j], ids[i:j], rewrite)
                distinct = as_bytes(distinct)
                todo = open_texts(number, first)
                rows = [_digest(distinct, number[first[k]:first[k + 1]], []) if not todo[k] else (None,) * 7
                        for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *_digest_columns(rows),
                     pa.array([t if k else None for t, k in zip(texts[i:j], todo, strict=True)],
                              pa.large_binary()).cast(pa.string())],
                    [*[c.split(" ")[0] for c in DIGEST.split(", ")], "text"])
    return run


def _last_pass(rewrite: bool):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            found = batch.column(2).to_pylist()
            for i, j in sliced([len(t or b"") for t in texts], SLICE):
                distinct, number, first = doc_words(texts[i:j], ids[i:j], rewrite)
                distinct = as_bytes(distinct)
                rows = [_digest(distinct, number[first[k]:first[k + 1]],
                                [(r["start"], r["length"], r["period"]) for r in found[i + k] or []])
                        for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_digest_columns(rows)],
                                                 [c.split(" ")[0] for c in DIGEST.split(", ")])
    return run


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(rid, start, length, period) for numbered texts (rid, doc_id, text).

    ``min_length`` is 24 at least: shorter runs need not hold a multiple of 16."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"min_length is {MIN_LENGTH} at least")
    tiled = text_tiles(docs).repartition("rid", "size", "b")
    return stitched(fragments(tiled, min_length), min_length)


def run_report(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """The contract's row per document of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    path = shared_path(spark, "periodic_runs")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .mapInArrow(_first_pass(rewrite), DIGEST + ", text string")
     .withColumn("rid", F.monotonically_increasing_id()).write.parquet(path))
    seen = spark.read.parquet(path)
    done = seen.where("text is null").drop("text", "rid")
    todo = seen.where("text is not null").select("rid", "doc_id", "text")
    tiled = text_tiles(todo, rewrite).repartition("rid", "size", "b")
    runs = stitched(fragments(tiled)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    rest = (todo.join(runs, "rid", "left").select("doc_id", "text", "runs")
            .mapInArrow(_last_pass(rewrite), DIGEST))
    return done.unionByName(rest)
