"""N-gram Jaccard join: documents whose shingle sets are similar, as components.

The join is the product of the document x n-gram incidence matrix with its
transpose, cut into blocks so that only entries that can reach the threshold are
ever formed. Thresholds are integers (``num`` / ``den``), compared without
rounding. Steps:

1. Equal sets. Documents with the same shingle set (128-bit digest) become one
   class with one representative; the rest works on representatives.
2. Column order. A fixed-size table counts all shingles by hash bucket, so every
   task can rank a document's shingles from rare to common. The table only
   decides the order, hence the speed; any order gives the same result.
3. Size-derived bounds. Two sets that reach the threshold share a shingle among
   the first ``n - ceil(t n) + 1`` of each in that order (prefix bound), their
   sizes differ by at most the factor t (size bound), and the sum over the
   ``COLUMN_BLOCKS`` blocks of the smaller block count bounds their overlap (block
   bound). Prefix shingles are the join key; the other bounds drop pairs before
   any text is touched.
4. Accumulated overlaps. Surviving pairs get their exact overlap from both whole
   texts, summed over the blocks of columns and given up as soon as what is left
   cannot reach the threshold.
5. To keep hot groups linear, the pairs come in two rounds. Round one pairs each
   member of a shingle's row list with the list's smallest document only. After
   joining what these links connect, round two takes the row lists that still
   touch several components, cuts them into tiles and forms only pairs of
   different components. Every pair of a row list is in one component after
   round one, or is looked at in round two: no link is lost, and pairs inside a
   large group of near copies are never formed.
6. Connected components by pointing to smaller neighbours, pointer doubling and
   contraction; everything stays in tables.

Documents without words (or null text) have an empty set and link with nothing;
fewer words than the shingle length make one shingle of all of them; rows
that share an id are one document, linked through any of their texts; a row with a
null id is a document of its own, which joins groups like any other but never
names one (a group without ids has a null component). An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfactor.llm.common import materialise
from vecfactor.llm.lm_bloom import _M1, U64, WordHash, _mix

SKETCH_BITS = 22       # buckets of the shingle counts: 2 ** 22 counters, broadcast as one byte each, fixed
COLUMN_BLOCKS = 64     # blocks of columns for the overlap bound
TILE = 256             # documents per tile in round two
BUNDLE_ROWS = 2048     # rows of round two handed to Python at once, on average
BROADCAST_IDS = 1_000_000  # ids broadcast at most (8 bytes each)


@dataclass(frozen=True)
class JoinSpec:
    k: int       # words per shingle
    num: int     # threshold num / den
    den: int

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def linked(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)


# ----------------------------------------------------------------- shingles

def shingle_set(words: WordHash, text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    h = words.of(text)
    if not len(h):
        return h
    if len(h) <= k:
        x = h[:1].copy()
        for i in range(1, len(h)):
            x = _mix(x * _M1 + h[i:i + 1])
        return _mix(x + U64(len(h))) if len(h) < k else x
    x = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        x = _mix(x * _M1 + h[i:len(h) - k + 1 + i])
    return np.unique(x)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - SKETCH_BITS)).astype(np.int64)


def signatures(docs: DataFrame, spec: JoinSpec, sketch) -> DataFrame:
    """(doc_id, n, d1, d2, keys, blocks), one row per input row, in one pass over the
    texts: set size, a 128-bit digest of the set, the prefix shingles and the
    counts by column block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        words, counts = WordHash(), sketch.value
        for b in batches:
            n, d1, d2, keys, blocks = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(words, t, spec.k)
                x = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append((x >> 64) - (1 << 63))
                d2.append((x & ((1 << 64) - 1)) - (1 << 63))
                keys.append(prefix_shingles(s, spec, counts).tobytes())
                blocks.append(block_counts(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(blocks, pa.binary())],
                ["doc_id", "n", "d1", "d2", "keys", "blocks"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, keys binary, blocks binary")


def prefix_shingles(s: np.ndarray, spec: JoinSpec, counts: np.ndarray) -> np.ndarray:
    """The first ``spec.prefix`` shingles from rare to common (ties in the order all in:
    more than the prefix is always safe)."""
    p = spec.prefix(len(s)) if len(s) else 0
    if p <= 0 or p >= len(s):
        return s[:max(p, 0)]
    rank = (counts[_bucket(s)].astype(U64) << U64(32)) | (s & U64(0xFFFFFFFF))
    return s[rank <= np.partition(rank, p - 1)[p - 1]]


def count_sketch(texts: DataFrame, k: int, chunks: int = 256, fan_in: int = 256) -> np.ndarray:
    """Shingle counts by hash bucket over all rows of ``texts`` (one column): each
    task counts into one array and sends it in chunks, which are summed in two
    levels of at most ``fan_in`` arrays per group. The table has a fixed size,
    whatever the corpus."""
    width = (1 << SKETCH_BITS) // chunks

    def count(batches):
        words, acc = WordHash(), np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            sets = [shingle_set(words, t, k) for t in b.column(0).to_pylist()]
            if sets:
                acc += np.bincount(_bucket(np.concatenate(sets)), minlength=1 << SKETCH_BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(chunks), pa.int32()),
             pa.array([acc[i * width:(i + 1) * width].tobytes() for i in range(chunks)], pa.binary())], ["chunk", "c"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(width, np.int64)
        for x in pdf["c"]:
            acc += np.frombuffer(x, np.int32)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]],
                             "c": [np.minimum(acc, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = texts.mapInArrow(count, "chunk int, c binary").withColumn(
        "g", F.floor(F.spark_partition_id() / fan_in))
    def rarity(pdf: pd.DataFrame) -> pd.DataFrame:
        out = add(pdf)
        out["c"] = [byte_counts(np.frombuffer(x, np.int32)).tobytes() for x in out["c"]]
        return out

    level1 = parts.groupBy("chunk", "g").applyInPandas(add, "chunk int, c binary")
    total = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in level1.groupBy("chunk").applyInPandas(rarity, "chunk int, c binary").collect():  # the fixed table
        total[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["c"], np.uint8)
    return total


def byte_counts(c: np.ndarray) -> np.ndarray:
    """Counts in one byte, in order: exact below 128, then five steps a doubling."""
    steps = 128 + (5 * np.log2(np.maximum(c, 128) / 128)).astype(np.int64)
    return np.where(c < 128, c, steps).astype(np.uint8)


# ----------------------------------------------------------------- candidates

def block_counts(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & U64(COLUMN_BLOCKS - 1)).astype(np.int64), minlength=COLUMN_BLOCKS).astype(np.uint32)


def prefix_rows(reps: DataFrame) -> DataFrame:
    """(key, doc_id) for the prefix shingles of each representative (doc_id, keys)."""
    def run(batches):
        for b in batches:
            keys = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)),
                     pa.array(np.repeat(np.asarray(b.column(0)), [len(x) for x in keys]))], ["key", "doc_id"])
    return reps.select("doc_id", "keys").mapInArrow(run, "key long, doc_id long")


def _may_link(spec: JoinSpec, n1, n2, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Size bound and block bound for rows of two count matrices."""
    top = np.minimum(b1, b2).sum(axis=-1, dtype=np.int64)
    return spec.linked(np.minimum(top, np.minimum(n1, n2)), n1, n2)


def _blocks(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint32).reshape(len(col), COLUMN_BLOCKS)


def star_pairs(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row lists with two documents or more: (key, doc_id, head), and their distinct
    (head, doc_id) pairs with head < doc_id."""
    heads = prefix.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"))
    heads = heads.where(F.col("head") < F.col("last")).select("key", "head")
    lists = materialise(prefix.join(heads, "key"))
    pairs = lists.where(F.col("head") < F.col("doc_id")).select(
        F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    return lists, pairs


def bounded_pairs(pairs: DataFrame, prof: DataFrame, spec: JoinSpec) -> DataFrame:
    """Drop pairs (a, b) that the size or block bound rules out."""
    pa_ = prof.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("blocks").alias("ba"))
    pb = prof.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("blocks").alias("bb"))
    j = (pairs.join(pa_, "a").join(pb, "b")
         .where((F.col("nb") * spec.den >= F.col("na") * spec.num) & (F.col("na") * spec.den >= F.col("nb") * spec.num)))

    def run(batches: Iterator[pd.DataFrame]):
        for p in batches:
            if len(p):
                ok = _may_link(spec, p["na"].to_numpy(), p["nb"].to_numpy(), _blocks(p["ba"]), _blocks(p["bb"]))
                yield p.loc[ok, ["a", "b"]]
    return j.select("a", "b", "na", "nb", "ba", "bb").mapInPandas(run, "a long, b long")


def texts_of(docs: DataFrame, pairs: DataFrame, repeats: bool) -> DataFrame:
    """(doc_id, text) of the documents in ``pairs``. Below a counted bound their ids
    are broadcast, so that no text of other documents is shuffled."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    near = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return near.dropDuplicates(["doc_id", "text"]) if repeats else near


def verified(pairs: DataFrame, near: DataFrame, spec: JoinSpec) -> DataFrame:
    """The pairs (a, b) that link, by the overlap of both whole texts (``near``:
    doc_id, text). A text that many pairs share is split by the skew join."""
    ta = near.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = near.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    j = pairs.join(tb, "b").join(ta, "a")

    def run(batches):
        words = WordHash()
        last, last_set = None, None
        for p in batches:
            a, b, ta_, tb_ = (p.column(i) for i in range(4))
            out_a, out_b = [], []
            for x, y, tx, ty in zip(a.to_pylist(), b.to_pylist(), ta_, tb_):
                if x != last:
                    last, last_set = x, shingle_set(words, tx.as_py(), spec.k)
                other = shingle_set(words, ty.as_py(), spec.k)
                if spec.linked(_overlap(last_set, other, spec), len(last_set), len(other)):
                    out_a.append(x)
                    out_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
    return j.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _overlap(s: np.ndarray, t: np.ndarray, spec: JoinSpec, blocks: int = 4) -> int:
    """Overlap of two sorted sets, summed over ranges of columns; stops once the
    rest cannot reach the threshold (the count is then too small to link)."""
    if len(t) < len(s):
        s, t = t, s
    total, step = 0, -(-len(s) // blocks)
    for lo in range(0, len(s), step):
        part = s[lo:lo + step]
        i = np.searchsorted(t, part)
        i[i == len(t)] = 0
        total += int((t[i] == part).sum())
        if not spec.linked(total + len(s) - lo - len(part), len(s), len(t)):
            return total
    return total


# ----------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the edges (a, b) reaches.

    In each round every vertex points to its smallest neighbour if that is
    smaller; pointer doubling flattens the resulting trees to their roots (about
    log(depth) joins), and the edges are contracted to the roots. Rounds end when
    no edge is left; few are needed, since only roots with edges stay."""
    e = edges.where("a != b")
    e = materialise(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = e.select(F.col("a").alias("v")).distinct().withColumn("c", F.col("v"))
    while True:
        to = materialise(e.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")))
        while True:
            nxt = to.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            twice = materialise(to.join(nxt, to["p"] == nxt["_v"]).select("v", F.col("p").alias("old"),
                                                                         F.col("_p").alias("p")))
            done = twice.where("p != old").isEmpty()
            to = twice.select("v", "p")
            if done:
                break
        root = to.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        lab = materialise(lab.join(root, lab["c"] == root["_v"], "left").select("v", F.coalesce("_p", "c").alias("c")))
        half = e.join(root, e["a"] == root["_v"]).select(F.col("_p").alias("a"), "b")
        e = materialise(half.join(root, half["b"] == root["_v"]).select("a", F.col("_p").alias("b"))
                        .where("a != b").distinct())
        if e.isEmpty():
            return lab


# ----------------------------------------------------------------- round two

def open_pairs(lists: DataFrame, lab: DataFrame, prof: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs of different components that share a row list and pass the bounds.

    A row list counts once even if several shingles have it (equal member sums);
    members are dealt to tiles of about ``TILE`` documents, and each pair of
    tiles is one group of bounded size. A pair that shares several lists is formed
    in the first of them only."""
    c = lists.join(lab, lists["doc_id"] == lab["v"], "left").select(
        "key", "doc_id", F.coalesce("c", "doc_id").alias("c"))
    state = (c.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"),
                                  F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sig"))
             .where("lo < hi"))
    once = materialise(state.groupBy("m", "sig", "lo", "hi").agg(F.min("key").alias("key")).select(
        "key", "m", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
    rows = once.agg(F.sum(F.col("m") * F.col("tiles"))).first()[0] or 0
    mem = c.join(once.select("key", "tiles"), "key")
    # a document's open row lists: a pair is formed in the first list that both have
    own_lists = mem.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    mem = (mem.join(own_lists.join(prof, "doc_id"), "doc_id")
           .withColumn("tile", F.pmod(F.xxhash64("doc_id", "key"), F.col("tiles")).cast("int")))
    # a tile meets every tile: one unit per unordered pair of tiles
    mem = mem.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mem = mem.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
                     F.col("tile").alias("own"), "doc_id", "c", "n", "blocks", "keys")
    # most units are small: about BUNDLE_ROWS rows of them are handed to Python at once
    bundles = max(1, -(-rows // BUNDLE_ROWS))
    mem = mem.withColumn("bundle", F.pmod(F.xxhash64("key", "t1", "t2"), F.lit(bundles)))
    return mem.groupBy("bundle").applyInArrow(lambda t: _unit_pairs(t, spec), "a long, b long").distinct()


def _unit_pairs(t: pa.Table, spec: JoinSpec) -> pa.Table:
    """The pairs (a, b) of a bundle of units (key, t1, t2) that pass the bounds."""
    key, t1, t2, own, ids, comp, n = (t.column(x).to_numpy() for x in ("key", "t1", "t2", "own", "doc_id", "c", "n"))
    blocks = _blocks(t.column("blocks").to_pylist())
    lists = t.column("keys").combine_chunks()
    vals = lists.flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    order = np.lexsort((t2, t1, key))
    k, x, y = key[order], t1[order], t2[order]
    starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    left, right = [], []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        unit = order[lo:hi]
        li, ri = unit[own[unit] == x[lo]], unit[own[unit] == y[lo]]
        ok = comp[li][:, None] != comp[ri][None, :]
        if x[lo] == y[lo]:
            ok &= ids[li][:, None] < ids[ri][None, :]
        nl, nr = n[li][:, None], n[ri][None, :]
        ok &= (nr * spec.den >= nl * spec.num) & (nl * spec.den >= nr * spec.num)
        if ok.any():
            def before(rows):
                own_keys = [vals[ends[r - 1] if r else 0:ends[r]] for r in rows]
                return [a[:np.searchsorted(a, k[lo])] for a in own_keys]
            ok &= ~_share(before(li), before(ri))
        i, j = np.nonzero(ok)
        left.append(li[i])
        right.append(ri[j])
    a, b = np.concatenate(left), np.concatenate(right)
    good = [_may_link(spec, n[u], n[v], blocks[u], blocks[v])
            for u, v in ((a[s:s + (1 << 15)], b[s:s + (1 << 15)]) for s in range(0, len(a), 1 << 15))]
    if good:
        keep = np.concatenate(good)
        a, b = a[keep], b[keep]
    return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})


def _share(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether left x right share a row list: a product of two small incidence matrices."""
    cols, at = np.unique(np.concatenate(left + right), return_inverse=True)
    m = np.zeros((len(left) + len(right), len(cols)), np.float32)
    m[np.repeat(np.arange(len(m)), [len(a) for a in left + right]), at] = 1.0
    return (m[:len(left)] @ m[len(left):].T) > 0


# ----------------------------------------------------------------- the join

def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, tuple[int, int] | None]:
    """(doc_id, _row) for every input row, ``_row`` the row itself, and the range of
    the numbers given to rows with a null id (None without such rows).

    Only the rows without id are written, each with a number of its own from a
    range that no id touches; all other rows are named by their id."""
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), one)
    own = materialise(rows.where("doc_id is null").select(F.monotonically_increasing_id().alias("at"), "_row"))
    last = own.agg(F.max("at")).first()[0]
    if last is None:
        return rows, None
    ids = rows.where("doc_id is not null")
    low = _free_range(ids.select("doc_id"), last + 1)
    return ids.unionByName(own.select((F.col("at") + low).alias("doc_id"), "_row")), (low, low + last)


def _free_range(ids: DataFrame, size: int) -> int:
    """The first of ``size`` numbers that are no id: the last free neighbour of the
    aligned ranges that hold ids."""
    bits = max(1, size.bit_length())
    top = 1 << (63 - bits)
    held = ids.select(F.shiftright("doc_id", bits).alias("r")).distinct()
    free = (held.select(F.explode(F.array(F.col("r") - 1, F.col("r") + 1)).alias("r"))
            .where(F.col("r").between(-top, top - 1)).join(held, "r", "left_anti").agg(F.max("r")).first()[0])
    return (free or 0) << bits


def given(col: str, own: tuple[int, int]) -> Column:
    """Whether a number is one that ``numbered`` gave to a row without id."""
    return F.col(col).between(*own)


def similar_components(docs: DataFrame, spec: JoinSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id
    reachable over links, itself included)."""
    rows, own = numbered(docs.select(id_col, text_col), id_col)
    out = linked_rows(rows.select("doc_id", F.col("_row")[text_col].alias("text")), own, spec)
    if own is None:
        return out.withColumnRenamed("head", "component_id")
    return out.select(F.when(~given("doc_id", own), F.col("doc_id")).alias("doc_id"), "n_shingles",
                      F.when(~given("head", own), F.col("head")).alias("component_id"))


def linked_rows(d: DataFrame, own: tuple[int, int] | None, spec: JoinSpec) -> DataFrame:
    """One row per row of ``d`` (doc_id, text; numbers of the range ``own`` stand for rows
    without id): doc_id, n_shingles and the component's ``head``, its smallest id or,
    in a component without ids, its smallest number."""
    spark = d.sparkSession
    sketch = spark.sparkContext.broadcast(count_sketch(d.select("text"), spec.k))
    sigs = materialise(signatures(d, spec, sketch))
    repeats = _repeats(sigs)
    # a class is named by its smallest id or number
    reps = materialise(sigs.where("n > 0").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"),
        F.min_by("blocks", "doc_id").alias("blocks")))
    lists, pairs = star_pairs(prefix_rows(reps))
    prof = reps.select("doc_id", "n", "blocks")
    first = materialise(bounded_pairs(pairs, prof, spec))
    links = verified(first, texts_of(d, first, repeats), spec)
    if repeats:
        links = links.unionByName(_same_id(sigs, reps))
    links = materialise(links)
    lab = components(links)
    second = materialise(open_pairs(lists, lab, prof, spec))
    if not second.isEmpty():
        more = materialise(verified(second, texts_of(d, second, repeats), spec))
        if not more.isEmpty():
            lab = components(links.unionByName(more))
    cls = reps.join(lab, reps["doc_id"] == lab["v"], "left").select(
        "n", "d1", "d2", F.coalesce("c", "doc_id").alias("component_id"))
    out = sigs.select("doc_id", "n", "d1", "d2").join(cls, ["n", "d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"),
                     F.coalesce("component_id", "doc_id").alias("head"))
    if own is None:
        return out
    # numbers may lie below ids: a component named by one gets its smallest id, if it has any
    names = (out.where(given("head", own)).groupBy("head")
             .agg(F.min(F.when(~given("doc_id", own), F.col("doc_id"))).alias("name")).where("name is not null"))
    return out.join(names, "head", "left").select("doc_id", "n_shingles", F.coalesce("name", "head").alias("head"))


def _same_id(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (representative, id) for the ids whose rows lie in several classes."""
    own = (sigs.select("doc_id", "n", "d1", "d2")
           .join(reps.select("n", "d1", "d2", F.col("doc_id").alias("rep")), ["n", "d1", "d2"])
           .select("doc_id", "rep").distinct())
    several = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    return own.join(several, "doc_id").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def _repeats(digests: DataFrame) -> bool:
    """Whether some id occurs in more than one row."""
    return not digests.groupBy("doc_id").count().where("count > 1").isEmpty()


CONTRACT = JoinSpec(k=3, num=90, den=100)
PIPELINE = JoinSpec(k=5, num=80, den=100)
