"""Collocations: the best phrases of two and three words of each language.

A phrase is a candidate with at least ``min_count`` occurrences a. Cutting it
after its first words gives l (occurrences of the first part), r (of the rest)
and the score floor(10^6 a^2 / (l r)); the worst cut counts. A candidate is
dropped if a longer candidate that contains it has at least ``contained`` percent
of its occurrences. The first ``k`` of each language are returned.

**Best-first branch and bound.** Phrases grow to the right from prefixes, whose
counts bound what can grow from them:

* a phrase occurs no more often than any part of it, so only words, then pairs,
  with ``min_count`` occurrences are grown at all;
* for a triple grown from the pair (u, v) the cut after u has l = f(u) and
  a <= r, a <= f(uv), so its score is at most 10^6 f(uv) / f(u).

The frontier is the set of pairs in order of that bound. A wave expands, in one
pass over the texts, all pairs of a language whose bound reaches a floor (the
score of the pair ranked ``slack * k``), and also counts the triples around every
pair whose own score reaches the floor, which settles whether it survives. Once k
survivors reach the floor, nothing that is still unexpanded can enter or tie with
them, and the language is settled. Otherwise the floor is lowered and the next wave
expands only what lies between the floors; a floor of 0 expands everything, so the
result is exact for all inputs.

**Counting.** Each task tokenises slices of the texts into word numbers, counts
n-grams there, and sends sums. Before pairs are counted by their words, all pairs
are counted by a 32-bit hash inside parts of the hash space (5 bytes for each pair
and slice). Such a count is an upper bound, so pairs below ``min_count`` there are
never sent as words. Sets of pairs travel to the tasks as bitmaps of at most
``bitmap_bytes``, whatever the number of pairs; a pair let through by mistake is
counted and then dropped by the exact joins. Nothing else is broadcast by this
module. Scores are computed in decimals of 38 digits.

Results: a null text is empty, a null language is ``und``; repeated rows count
again; an empty table gives an empty result; equal scores are ordered by a
descending, then the phrase in UTF-8 byte order; a very long text is counted in
slices cut at a separator (where no phrase crosses). Only ``text`` and ``lang`` of the
input are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.tokens import SEPARATOR, U64, as_bytes, byte_classes, mix, sliced, words
from vecfactor.session import shared_path

SPACES, SEPARATORS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_CLASSES = byte_classes(SPACES, SEPARATORS)
SLICE = 4 << 20
PART_TEXT = 32 << 20      # bytes of text for each part of the hash space
MAX_PART_BITS = 22
MOST = 255                # counts in blocks stop here; a bound of more asks for this many
PAIR = ["lang", "w1", "w2"]
TRIPLE = ["lang", "w1", "w2", "w3"]


# ----------------------------------------------------------------- texts

def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in slices that end at a separator."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            window = np.frombuffer(text, np.uint8, len(text) - end, end)
            step = 1 << 16
            for lo in range(0, len(window), step):
                hit = np.flatnonzero(_CLASSES[window[lo:lo + step]] == SEPARATOR)
                if len(hit):
                    end += lo + int(hit[0]) + 1
                    break
            else:
                end = len(text)
        yield text[at:end]
        at = end


class Slice:
    """Words of some texts of one language, as numbers of distinct words."""

    def __init__(self, lang: str, data: bytes):
        self.lang = lang
        self.words, self.number, start = words(data, _CLASSES, lower=True)
        pieces = np.flatnonzero(_CLASSES[np.frombuffer(data, np.uint8)] == SEPARATOR)
        piece = np.searchsorted(pieces, start)
        self.joined = piece[1:] == piece[:-1]       # word i + 1 stands in the piece of word i

    def hashes(self) -> np.ndarray:
        """A hash for each distinct word, seeded by the language."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.array([xxhash.xxh3_64_intdigest(w, seed=seed) for w in as_bytes(self.words)], dtype=U64)

    def pairs(self) -> np.ndarray:
        """Pair number at each place where a pair begins: first word * V + second word."""
        at = np.flatnonzero(self.joined)
        return self.number[at] * len(self.words) + self.number[at + 1]


def pair_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 * U64(0x9E3779B97F4A7C15) + mix(h2))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = as_bytes(batch.column(1))
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
            for i, j in sliced([len(t) for t in own], SLICE):
                if j == i + 1 and len(own[i]) > SLICE:
                    yield from (Slice(lang, part) for part in _cuts(own[i]))
                else:
                    yield Slice(lang, b"\n".join(own[i:j]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


# ----------------------------------------------------------------- sets of pairs as bitmaps

BLOCK = "part int, keys binary, counts binary"


def _block(h: np.ndarray, c: np.ndarray, part_bits: int) -> pa.RecordBatch:
    """Hashes and counts, cut by the top bits of the hash; 32 bits are kept below them."""
    order = np.argsort(h)
    h, c = h[order], np.minimum(c[order], MOST).astype(np.uint8)
    part = (h >> U64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(h), np.int64)
    low = ((h << U64(part_bits)) >> U64(32)).astype("<u4")
    ids, cut = np.unique(part, return_index=True)
    cut = np.append(cut, len(h))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
         pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["part", "keys", "counts"])


def bitmap(blocks: DataFrame, part_bits: int, bits: int, least: int) -> np.ndarray:
    """2 ** bits bits; set for the hashes whose counts add up to ``least``. Each part of the
    hash space is summed in a task of its own and owns a stretch of the bitmap."""
    own = bits - part_bits

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, "<u4") for k in part["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in part["counts"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        field = np.zeros(1 << own, bool)
        field[keys[first][total >= least] >> np.uint32(32 - own)] = True
        return pd.DataFrame({"part": [part["part"].iloc[0]], "field": [np.packbits(field).tobytes()]})
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << own) // 8
    for row in blocks.groupBy("part").applyInPandas(merge, "part int, field binary").collect():  # the bitmap's size
        out[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["field"], np.uint8)
    return out


def holds(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = (h >> U64(64 - (len(field) * 8).bit_length() + 1)).astype(np.int64)
    return (field[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Bitmaps:
    """Bit sizes for one corpus: parts by bytes of text, bitmaps by their bound."""

    def __init__(self, text_bytes: int, bitmap_bytes: int):
        self.part_bits = min(MAX_PART_BITS, max(0, (text_bytes // PART_TEXT).bit_length()))
        # one bit for 16 bytes of text, within the bound, and a byte for each part at least
        wanted = max(16, text_bytes.bit_length() - 4)
        self.bits = max(self.part_bits + 3, min(wanted, (8 * bitmap_bytes).bit_length() - 1))
        self.bits = min(self.bits, self.part_bits + 32)

    def of(self, pairs: DataFrame) -> np.ndarray:
        """The bitmap of a table of (lang, w1, w2)."""
        part_bits = self.part_bits

        def run(batches):
            for b in batches:
                lang = [xxhash.xxh3_64_intdigest((x or "").encode()) for x in b.column(0).to_pylist()]
                h = [np.array([xxhash.xxh3_64_intdigest(w, seed=s)
                               for w, s in zip(as_bytes(b.column(i)), lang, strict=True)], dtype=U64) for i in (1, 2)]
                if len(lang):
                    distinct = np.unique(pair_hash(*h))
                    yield _block(distinct, np.ones(len(distinct), np.int64), part_bits)
        return bitmap(pairs.select(*PAIR).mapInArrow(run, BLOCK), part_bits, self.bits, 1)


# ----------------------------------------------------------------- counts

def words_and_blocks(docs: DataFrame, part_bits: int) -> DataFrame:
    """One pass: rows (lang, w, n) of words and rows (part, keys, counts) of pair hashes."""
    def run(batches):
        for s in _slices(batches):
            if len(s.number):
                n = np.bincount(s.number, minlength=len(s.words))
                yield _both({"w": s.words.cast(pa.string()), "n": pa.array(n, pa.int64()),
                             "lang": pa.array([s.lang] * len(n))}, len(n))
                pair, c = np.unique(s.pairs(), return_counts=True)
                if len(pair):
                    h, v = s.hashes(), len(s.words)
                    block = _block(pair_hash(h[pair // v], h[pair % v]), c, part_bits)
                    yield _both({k: block.column(k) for k in ("part", "keys", "counts")}, block.num_rows)
    return _texts(docs).mapInArrow(run, f"lang string, w string, n long, {BLOCK}")


_BOTH = pa.schema([("lang", pa.string()), ("w", pa.string()), ("n", pa.int64()), ("part", pa.int32()),
                   ("keys", pa.binary()), ("counts", pa.binary())])


def _both(cols: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in _BOTH], schema=_BOTH)


def _ngram_counts(docs: DataFrame, size: int, chosen: Callable[[Slice], np.ndarray]) -> DataFrame:
    """(lang, w1 ... w_size, n) of the n-grams that begin at the places ``chosen`` gives."""
    cols = [f"w{i + 1}" for i in range(size)]

    def run(batches):
        for s in _slices(batches):
            at = chosen(s)
            if not len(at):
                continue
            v = len(s.words)
            pair, place = np.unique(s.number[at] * v + s.number[at + 1], return_inverse=True)
            if size == 3:                                   # a pair's number here, then the third word
                pair3, n = np.unique(place * v + s.number[at + 2], return_counts=True)
                found = [pair[pair3 // v] // v, pair[pair3 // v] % v, pair3 % v]
            else:
                n = np.bincount(place)
                found = [pair // v, pair % v]
            text = s.words.cast(pa.string())
            for lo in range(0, len(n), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.lang] * len(n[part])), *[text.take(pa.array(f[part])) for f in found],
                     pa.array(n[part], pa.int64())], ["lang", *cols, "n"])
    rows = _texts(docs).mapInArrow(run, "lang string, " + ", ".join(f"{c} string" for c in cols) + ", n long")
    return rows.groupBy("lang", *cols).agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(lang, w1, w2, n) of the pairs whose bit is set in the sent bitmap, exact."""
    def chosen(s: Slice) -> np.ndarray:
        at = np.flatnonzero(s.joined)
        if not len(at):
            return at
        h = s.hashes()
        pair, place = np.unique(s.pairs(), return_inverse=True)
        v = len(s.words)
        return at[holds(sent.value, pair_hash(h[pair // v], h[pair % v]))[place]]
    return _ngram_counts(docs, 2, chosen)


def triple_counts(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(lang, w1, w2, w3, n), exact, by the sent bitmaps (frequent, grown, around): of the triples
    made of two ``frequent`` pairs whose first pair is ``grown`` or one of whose pairs is in
    ``around``."""
    def chosen(s: Slice) -> np.ndarray:
        at = np.flatnonzero(s.joined)
        if not len(at):
            return at
        ok, left, any_side = sent.value
        h, v = s.hashes(), len(s.words)
        pair, place = np.unique(s.pairs(), return_inverse=True)
        hp = pair_hash(h[pair // v], h[pair % v])
        first = np.zeros((3, len(s.number) + 1), bool)      # by place of the pair's first word
        for i, field in enumerate((ok, left, any_side)):
            first[i, at] = holds(field, hp)[place]
        ok, left, any_side = first
        return np.flatnonzero(ok[:-1] & ok[1:] & (left[:-1] | any_side[:-1] | any_side[1:]))
    return _ngram_counts(docs, 3, chosen)


# ----------------------------------------------------------------- scores

def score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (l r)), exact: counts of up to 15 digits in decimals of 38."""
    def big(c):
        return f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"({big(a)} * {big(a)} * CAST(1000000 AS DECIMAL(7, 0))) div ({big(left)} * {big(right)})")


def scored_pairs(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, w1, w2, a, l, r, score, bound); ``bound`` holds for every triple grown from the pair."""
    first = vocabulary.select("lang", F.col("w").alias("w1"), F.col("n").alias("l"))
    second = vocabulary.select("lang", F.col("w").alias("w2"), F.col("n").alias("r"))
    both = counts.withColumnRenamed("n", "a").join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    return both.select(*PAIR, "a", "l", "r", score("a", "l", "r").alias("score"),
                       F.expr("(CAST(a AS DECIMAL(15, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div l").alias("bound"))


def scored_triples(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) by the worse of the two cuts, the first on ties."""
    head = pairs.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"),
                        F.col("r").alias("r2"))
    cut = (counts.withColumnRenamed("n", "a").join(head, PAIR).join(tail, ["lang", "w2", "w3"])
           .withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2")))
    first = F.col("s1") <= F.col("s2")
    return cut.select(*TRIPLE, "a", *[F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in "lr"],
                      F.least("s1", "s2").alias("score"))


def survivors(pairs: DataFrame, triples: DataFrame, floors: DataFrame, contained: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): what reaches its language's floor and is in no triple
    of ``contained`` percent of its occurrences."""
    inside = (triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(
        F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
        .groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer")))
    low = floors.select("lang", "low")
    high = pairs.join(low, "lang").where("score >= low")
    alone = (high.join(inside, PAIR, "left")
             .where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))))
    long = triples.join(low, "lang").where("score >= low")
    cols = ["a", "l", "r", "score"]
    return (alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), *cols)
            .unionByName(long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), *cols)))


def _next_floors(pairs: DataFrame, floors: DataFrame | None, ranked: int) -> DataFrame:
    """(lang, low, high, settled): the unsettled languages' floors lowered to the score of the
    pair ranked ``ranked``, or to 0 with fewer pairs; ``high`` is the floor before."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    best = (pairs.select("lang", "score", place.alias("i")).where(F.col("i") <= ranked)
            .groupBy("lang").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("s")))
    best = best.select("lang", F.when(F.col("held") == ranked, F.col("s")).otherwise(0).alias("next"))
    if floors is None:
        return best.select("lang", F.col("next").alias("low"), F.lit(None).cast("long").alias("high"),
                           F.lit(False).alias("settled"))
    moved = floors.join(best, "lang")
    return moved.select("lang", F.when(F.col("settled"), F.col("low")).otherwise(F.least("next", "low")).alias("low"),
                        F.col("low").alias("high"), "settled")


def mine_phrases(docs: DataFrame, k: int = 2000, min_count: int = 10, contained: int = 50, slack: int = 2,
                 bitmap_bytes: int = 16 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``k`` phrases of each language."""
    spark, base = docs.sparkSession, shared_path(docs.sparkSession, "phrases")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")
    size = Bitmaps(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0, bitmap_bytes)
    raw = written(words_and_blocks(docs, size.part_bits), "raw")
    vocabulary = written(raw.where("w is not null").groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
    sc = spark.sparkContext
    blocks = raw.where("part is not null").select("part", "keys", "counts")
    held = sc.broadcast(bitmap(blocks, size.part_bits, size.bits, min(min_count, MOST)))
    enough = F.col("n") >= min_count
    pairs = written(scored_pairs(pair_counts(docs, held).where(enough), vocabulary.where(enough)), "pairs")
    held.destroy()                                  # a bitmap lives for its one pass
    frequent = size.of(pairs)

    floors, triples, wave = None, None, 0
    while True:
        floors = written(_next_floors(pairs, floors, k * slack * 4 ** wave), f"floors{wave}")
        todo = pairs.join(floors.where("NOT settled"), "lang")

        def between(c, todo=todo):
            return todo.where((F.col(c) >= F.col("low")) & (F.col("high").isNull() | (F.col(c) < F.col("high"))))
        sent = sc.broadcast((frequent, size.of(between("bound")), size.of(between("score"))))
        found = written(scored_triples(triple_counts(docs, sent).where(enough), pairs), f"triples{wave}")
        sent.destroy()
        triples = found if triples is None else triples.unionByName(found).dropDuplicates(TRIPLE)
        left = written(survivors(pairs, triples, floors, contained), f"survivors{wave}")
        full = left.groupBy("lang").agg((F.count(F.lit(1)) >= k).alias("full"))
        done = F.coalesce("full", F.lit(False)) | (F.col("low") <= 0)
        floors = written(floors.join(full, "lang", "left").select("lang", "low", "high", done.alias("settled")),
                         f"settled{wave}")
        if floors.where("NOT settled").isEmpty():
            break
        wave += 1
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return (left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
