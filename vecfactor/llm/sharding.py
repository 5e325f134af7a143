"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a 64-bit ring; a row goes to the first
point clockwise of its key's hash. A shard that is full passes its remaining
rows on, clockwise, to the next shard with room.

The distributed form works on *arcs* (the ring between two neighbouring points;
``shards * vnodes`` of them, whatever the data size):

1. one aggregate counts the rows of every (arc, salt); the salts cut each arc
   into groups of at most about ``max_group_rows`` rows, even if one key holds a
   large part of all rows;
2. the counts per arc (a bounded table) decide on the driver how many rows each
   arc keeps and how many go to which later shard (``place``);
3. each row's rank in its arc (offset of its salt group plus a row number in
   the group) picks its range, hence its shard and its slot.

So only ids, sizes and hashes are shuffled, and no window spans a shard.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfactor.llm.common import materialise, text_or_empty

_HALF = 1 << 63


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order. A point depends on its own shard and
    number only, so another shard leaves all other points where they are."""
    pts = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"shard-{s}-point-{v}".encode(), digest_size=8).digest()
            pts.append((int.from_bytes(h, "big") - _HALF, s))
    return sorted(pts)


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Bounded loads. With ``epsilon`` 0 the capacities sum to ``total`` (shares
    at most one apart); otherwise every shard may hold (1 + epsilon) times the mean."""
    if epsilon <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    cap = int(-(-total * (1 + epsilon) // shards))
    return [cap] * shards


def place(points: list[tuple[int, int]], counts: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, last rank + 1, shard, first slot).

    Each shard first keeps the rows of its own arcs, in ring order, up to its
    capacity; what does not fit continues clockwise from its arc to the next
    points whose shards have room. Work: arcs, plus the points that overflowing
    arcs pass; full shards drop out of the walk.
    """
    n = len(points)
    used = [0] * len(caps)
    out, over = [], []
    for a, (_, s) in enumerate(points):
        keep = min(counts[a], caps[s] - used[s])
        if keep > 0:
            out.append((a, 0, keep, s, used[s]))
            used[s] += keep
        if counts[a] > keep:
            over.append((a, keep))
    open_arcs = [i for i, (_, s) in enumerate(points) if used[s] < caps[s]]
    for a, start in over:
        left, rank = counts[a] - start, start
        while left > 0:
            k = bisect_left(open_arcs, a + 1)
            i = open_arcs[k % len(open_arcs)]
            s = points[i % n][1]
            take = min(left, caps[s] - used[s])
            out.append((a, rank, rank + take, s, used[s]))
            used[s] += take
            rank, left = rank + take, left - take
            if used[s] >= caps[s]:
                open_arcs = [j for j in open_arcs if points[j][1] != s]
    return out


def ring_shard(df: DataFrame, key: str, shards: int, vnodes: int = 256,
               epsilon: float = 0.0, max_group_rows: int = 250_000) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    All columns of ``df`` are kept (a column called ``shard``, ``slot`` or starting with ``_vf_`` is
    replaced). Null keys hash like any other value, repeated rows are placed
    one by one, an empty table gives an empty result. With ``epsilon`` 0 the
    shards' row counts are at most one apart.
    """
    spark = df.sparkSession
    pts = ring_points(shards, vnodes)
    # the first point at or clockwise after the hash, found in the sorted points
    # by a join on the hash's top bits and a count inside that cell
    bits = max(1, (len(pts) - 1).bit_length())
    shift = 64 - bits
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for p, _ in pts:
        cells[(p + _HALF) >> shift].append(p)
    before, first = 0, []
    for c in cells:
        first.append((before, c))
        before += len(c)
    cell_df = F.broadcast(spark.createDataFrame(  # 2 ** bits rows: about one per ring point
        [(i, b, c) for i, (b, c) in enumerate(first)], "_vf_cell long, _vf_before int, _vf_points array<long>"))
    pos = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull())
    base = (df.drop("shard", "slot")
            .withColumn("_vf_pos", pos)
            .withColumn("_vf_mid", F.monotonically_increasing_id())
            .withColumn("_vf_cell", F.shiftrightunsigned(
                F.col("_vf_pos").bitwiseXOR(F.lit(-_HALF).cast("long")), shift)))
    arc = F.col("_vf_before") + F.size(F.filter("_vf_points", lambda p: p < F.col("_vf_pos")))
    base = (base.join(cell_df, "_vf_cell")
            .withColumn("_vf_arc", F.pmod(arc, F.lit(len(pts))).cast("int"))
            .drop("_vf_cell", "_vf_before", "_vf_points"))
    base = materialise(base)
    total = base.count()
    # rows of one key, and even equal rows, spread over the salts: a group stays
    # near max_group_rows rows even if one key holds the whole table
    salts = max(1, -(-total // max_group_rows))
    base = base.withColumn("_vf_salt", F.pmod(F.xxhash64("_vf_pos", "_vf_mid"), F.lit(salts)).cast("int"))
    groups = base.groupBy("_vf_arc", "_vf_salt").agg(F.count(F.lit(1)).alias("_vf_n"))
    groups = materialise(groups)
    counts = [0] * len(pts)
    for r in groups.groupBy("_vf_arc").agg(F.sum("_vf_n").alias("n")).collect():  # one row per ring point at most
        counts[r["_vf_arc"]] = r["n"]
    ranges = place(pts, counts, capacities(total, shards, epsilon))
    by_arc: dict[int, list] = {}
    for a, lo, hi, s, slot in ranges:
        by_arc.setdefault(a, []).append((lo, hi, s, slot))
    plan = F.broadcast(spark.createDataFrame(  # at most ring points + shards ranges
        [(a, v) for a, v in by_arc.items()],
        "_vf_arc int, _vf_ranges array<struct<lo:long,hi:long,shard:int,slot:long>>"))
    before_salt = Window.partitionBy("_vf_arc").orderBy("_vf_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_vf_arc", "_vf_salt",
                            F.coalesce(F.sum("_vf_n").over(before_salt), F.lit(0)).alias("_vf_off"))
    rank = Window.partitionBy("_vf_arc", "_vf_salt").orderBy("_vf_pos", "_vf_mid")
    ranked = (base.withColumn("_vf_rn", F.row_number().over(rank) - 1)
              .join(offsets, ["_vf_arc", "_vf_salt"])
              .withColumn("_vf_rank", F.col("_vf_off") + F.col("_vf_rn")))
    hit = F.get(F.filter("_vf_ranges", lambda r: (r["lo"] <= F.col("_vf_rank")) & (F.col("_vf_rank") < r["hi"])),
                F.lit(0))
    return (ranked.join(plan, "_vf_arc")
            .withColumn("_vf_hit", hit)
            .withColumn("shard", F.col("_vf_hit.shard"))
            .withColumn("slot", F.col("_vf_hit.slot") + F.col("_vf_rank") - F.col("_vf_hit.lo"))
            .drop(*[c for c in ("_vf_pos", "_vf_mid", "_vf_arc", "_vf_salt", "_vf_rn", "_vf_off", "_vf_rank",
                                "_vf_ranges", "_vf_hit")]))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 256, id_col: str = "doc_id",
                    text_col: str = "text", epsilon: float = 0.0) -> DataFrame:
    """The contract's digest for documents: only ids, sizes and checksums move."""
    t = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"),
                    (F.octet_length(t).cast("long") + 8).alias("size"),
                    F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"))
    return ring_shard(d, "doc_id", shards, vnodes, epsilon).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
