"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of space, \\t, \\n, \\v, \\f, \\r at both ends
with A-Z lower-cased, taken as a 128-bit hash. :class:`LineRuns` keeps how many
documents hold each key, as an index that grows batch by batch:

* a *run* is a table of (hash, documents), hash-bucketed and sorted by the hash
  inside each bucket, so joins with it read it in order and never shuffle it;
* ``add(batch)`` counts the batch's keys (summed in each task before the one
  shuffle), anti-joins them by sort-merge with the runs of keys that are already
  *settled* (found in ``min_docs`` documents), and writes the rest as a run of
  level 0: a settled line is never counted or stored again;
* when a level has ``fanout`` runs they are merged into one run of the next
  level; keys that reach ``min_docs`` then leave the counts for a settled run.
  Every key thus passes each level once, whatever the number of batches;
* ``settled()`` merges what is left and returns all settled keys.

Every state is named by a manifest that is written last, so a job that dies
leaves the state before it, and a batch name that was added already changes
nothing (a replayed batch is not counted twice).

``drop_lines`` removes the lines whose key is settled from whole texts. Where the
settled keys are proven to fit (``broadcast_bytes``) they go to all tasks and the
texts are not shuffled. Otherwise the texts are cut into chunks of rows, each
chunk's distinct keys (a frequent line counts once a chunk, which breaks up hot
lines) are joined with the settled run, and each chunk's hits meet its rows.

Results: a null or empty text is one empty line (its key has no code point and is
never dropped); every row is a document of its own, also rows that repeat an id
or have none; a document holds a key once however often the line stands in it;
line length and text length are not limited; an empty table gives an empty
result; other columns of the input, whatever their names, are carried along.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfactor.llm.tokens import as_bytes
from vecfactor.session import shared_path

STRIP = b"\x20\t\n\x0b\x0c\r"
KEY = "h1 long, h2 long"
KEY_BYTES = 16
FLUSH = 200_000  # distinct keys a task holds before it hands them on


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """(lines, 16-byte keys; b"" for a line without a key)."""
    lines = (text or b"").split(b"\n")
    digest = xxhash.xxh3_128_digest
    return lines, [digest(k) if (k := line.strip(STRIP).lower()) else b"" for line in lines]


def _key_columns(keys) -> list[pa.Array]:
    pair = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))]


def key_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each key stands."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [*_key_columns(seen.keys()), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])
        for b in batches:
            for t in as_bytes(b.column(0)):
                held = set(line_keys(t)[1])
                held.discard(b"")
                seen.update(held)
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"{KEY}, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


class LineRuns:
    """The index of line keys under ``root`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, root: str | None = None, min_docs: int = 10, fanout: int = 4,
                 buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = (root or shared_path(spark, "line_runs")).rstrip("/")
        last = self._last()
        self.buckets = last["buckets"] if last else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = last["version"] if last else 0
        self.batches: list[str] = last["batches"] if last else []
        self.runs: list[dict] = last["runs"] if last else []  # {"name", "level"}; level None: settled keys

    # ------------------------------------------------------------- state
    def _last(self) -> dict | None:
        try:
            row = self.spark.read.text(f"{self.root}/manifest").agg(F.max("value")).first()
        except Exception as e:  # noqa: BLE001 - a new index has no manifest
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return None
            raise
        return json.loads(row[0][20:]) if row[0] else None

    def _commit(self, runs: list[dict], batch: str | None = None) -> None:
        """One line per version, which starts with its number in 20 digits."""
        version, batches = self.version + 1, self.batches + ([batch] if batch else [])
        state = {"version": version, "buckets": self.buckets, "batches": batches, "runs": runs}
        line = f"{version:020d}{json.dumps(state)}"
        self.spark.range(1).select(F.lit(line).alias("value")).write.mode("append").text(f"{self.root}/manifest")
        self.version, self.batches, self.runs = version, batches, runs

    # ------------------------------------------------------------- runs
    def _read(self, run: dict) -> DataFrame:
        """The run as a bucketed, sorted table."""
        table = f"line_run_{run['name']}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({KEY}, n LONG) USING parquet"
                           f" CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
                           f" LOCATION '{self.root}/runs/{run['name']}'")
        return self.spark.table(table)

    def _write(self, keys: DataFrame, level: int | None) -> dict:
        """``keys`` come out of an aggregate or join on (h1, h2): one file a bucket."""
        run = {"name": uuid.uuid4().hex, "level": level}
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            keys = keys.repartition(self.buckets, "h1", "h2")
        (keys.select("h1", "h2", "n").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.root}/runs/{run['name']}").saveAsTable(f"line_run_{run['name']}"))
        return run

    def _of(self, level: int | None) -> list[dict]:
        return [r for r in self.runs if r["level"] == level]

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join: the keys that stand in no settled run."""
        for run in self._of(None):
            keys = keys.join(self._read(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, docs: DataFrame, batch: str, text: str = "text") -> bool:
        """Add a batch of documents; False if a batch of that name is in already."""
        if batch in self.batches:
            return False
        run = self._write(self.unsettled(key_counts(docs, text)), 0)
        self._commit([*self.runs, run], batch)
        level = 0
        while len(self._of(level)) >= self.fanout:
            self._merge(self._of(level), level + 1)
            level += 1
        return True

    def _merge(self, merged: list[dict], level: int) -> None:
        """Compaction: the runs' counts summed; keys that are settled now move to a settled run."""
        both = self._read(merged[0])
        for run in merged[1:]:
            both = both.unionByName(self._read(run))
        sums = both.groupBy("h1", "h2").agg(F.sum("n").alias("n")).persist()
        try:
            new = [self._write(sums.where(F.col("n") < self.min_docs), level),
                   self._write(sums.where(F.col("n") >= self.min_docs), None)]
        finally:
            sums.unpersist()
        names = {r["name"] for r in merged}
        self._commit([r for r in self.runs if r["name"] not in names] + new)

    def settled(self) -> DataFrame:
        """(h1, h2, n) of every settled key; merges the runs of all levels first. ``n`` is
        the count when the key was settled."""
        counts = [r for r in self.runs if r["level"] is not None]
        if counts:
            self._merge(counts, max(r["level"] for r in counts))
        if not self.runs:
            return self.spark.createDataFrame([], f"{KEY}, n long")
        out = None
        for run in self._of(None):
            out = self._read(run) if out is None else out.unionByName(self._read(run))
        return out


# ----------------------------------------------------------------- dropping

def _kept(text: bytes | None, gone) -> tuple[int, int, bytes]:
    """(lines, dropped lines, the other lines joined)."""
    lines, keys = line_keys(text)
    left = [line for line, k in zip(lines, keys, strict=True) if k not in gone]
    return len(lines), len(lines) - len(left), b"\n".join(left)


RESULT = [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]


def _with_kept(batch: pa.RecordBatch, gone, row: int, text: int) -> pa.RecordBatch:
    rows = [_kept(t, gone) for t in as_bytes(batch.column(text))]
    cols = [pa.array([r[i] for r in rows], pa.large_binary() if i == 2 else t).cast(t)
            for i, (_, t) in enumerate(RESULT)]
    return pa.RecordBatch.from_arrays([batch.column(row), *cols], ["_row", *[n for n, _ in RESULT]])


def drop_lines(docs: DataFrame, settled: DataFrame, text: str = "text",
               broadcast_bytes: int = 16 * 1024 * 1024, chunk_rows: int = 512) -> DataFrame:
    """(_row, n_lines, n_dropped, kept_text): ``docs`` without the lines whose key is in ``settled``.

    ``_row`` is the input row. The settled keys are broadcast if they are proven
    to take at most ``broadcast_bytes``; beyond that they are joined chunk by chunk.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{text}`").cast("string").alias("_text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"
    keys = settled.select("h1", "h2")
    if keys.count() * KEY_BYTES <= broadcast_bytes:
        got = keys.toArrow()
        pair = np.column_stack([got.column(i).to_numpy() for i in (0, 1)]).astype("<i8")
        sent = spark.sparkContext.broadcast(pair.tobytes())

        def run(batches):
            raw = sent.value
            gone = {raw[i:i + KEY_BYTES] for i in range(0, len(raw), KEY_BYTES)}
            for b in batches:
                yield _with_kept(b, gone, 0, 1)
        return rows.mapInArrow(run, schema)

    # row numbers are written, so that both reads below see the same chunks
    path = shared_path(spark, "line_chunks")
    rows.withColumn("_chunk", F.floor(F.monotonically_increasing_id() / chunk_rows)).write.parquet(path)
    written = spark.read.parquet(path)

    def chunk_keys(batches):
        for b in batches:
            held: dict = {}
            for c, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                held.setdefault(c, set()).update(line_keys(t)[1])
            for c, k in held.items():
                k.discard(b"")
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(k), pa.int64()), *_key_columns(k)],
                                                     ["_chunk", "h1", "h2"])
    found = written.select("_chunk", "_text").mapInArrow(chunk_keys, f"_chunk long, {KEY}")
    hits = found.join(keys.hint("merge"), ["h1", "h2"], "left_semi").select("_chunk", "h1", "h2")

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = np.column_stack([right.column(c).to_numpy() for c in ("h1", "h2")]).astype("<i8")
        gone = {r.tobytes() for r in pair}
        left = left.select(["_row", "_text"])
        return pa.Table.from_batches([_with_kept(b, gone, 0, 1) for b in left.to_batches()],
                                     schema=pa.schema([left.schema.field("_row"), *RESULT]))
    return written.groupBy("_chunk").cogroup(hits.groupBy("_chunk")).applyInArrow(drop, schema)


def batches_of(spark: SparkSession, docs_path: str, most: int = 4) -> list[tuple[str, DataFrame]]:
    """The files of a table dealt into at most ``most`` batches, each read once."""
    files = sorted(spark.read.parquet(docs_path).inputFiles())
    step = max(1, -(-len(files) // most))
    return [(files[i], spark.read.parquet(*files[i:i + step])) for i in range(0, len(files), step)]


def line_digest(kept: DataFrame) -> DataFrame:
    """The contract's columns from the rows of ``drop_lines``."""
    return kept.select("_row.doc_id", "n_lines", "n_dropped",
                       F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
