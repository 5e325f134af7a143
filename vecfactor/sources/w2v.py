"""Binary word-vector files as a Spark data source (``format("word2vec_bin")``).

File format (as the reference's loader reads it): an ASCII header with the
number of words ``n`` and the dimension ``dim`` separated by white space,
then ``n`` records of ``word`` bytes, one space, and ``dim`` little-endian
float32 values. Newline bytes before a word are not part of it.

A path may be one file or a folder of such files (read in name order); the
``word_idx`` column numbers the records across files in that order, which is
the "file order" that decides duplicate words and nearest-word ties.

Reading: records have variable length and float bytes may look like a space,
so a file cannot be cut at arbitrary byte offsets. An offset index beside the
file (``.offsets-<name>``: the byte offset of every ``every``-th record) lets each
task seek to its record range and read just that: all tasks together read the file
once. :func:`index_vectors` makes it in one sequential pass per file; files that
the writer below makes have it from the start. An index whose file has another
size or age is not used. Without one a task hops word by word from the file's
first record (a ``find`` for the space, then ``4*dim`` bytes). A range is decoded
into Arrow batches with vectorised gathers. Only headers and indexes are read while
planning. Import once, then keep the table as Parquet.

Local paths are memory-mapped; URIs (``file://``, ``hdfs://``, ``s3://``,
whatever pyarrow's file systems reach) are read through a sliding window of
``windowBytes``, so the same reader works on shared cluster storage.

Writing: each task writes files of at most about ``fileBytes`` with their own
headers. They appear under their final names when the whole save commits; names
of a later save sort after those of earlier ones; overwrite removes the earlier
files. Words with a space or a newline are refused.
"""

from __future__ import annotations

import mmap
import os
import re
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

SCHEMA = "word string, word_idx long, vec array<float>"
_HEADER = re.compile(rb"\s*(\d+)\s+(\d+)")


class VectorFileError(ValueError):
    pass


def _is_uri(path: str) -> bool:
    return "://" in path


def _norm(path: str) -> str:
    """Hadoop-style ``file:/x`` is a local path."""
    return path[5:] if path.startswith("file:") and not path.startswith("file://") else path


def _fs(path: str):
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The file itself, or the files of a folder in name order."""
    if _is_uri(path):
        import pyarrow.fs as pafs
        fs, p = _fs(path)
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pafs.FileType.Directory:
            prefix = path[:path.rfind(p.rstrip("/"))]  # scheme and host
            names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(p))
                           if i.type == pafs.FileType.File
                           and not os.path.basename(i.path).startswith((".", "_")))
            return [prefix + n for n in names]
        return [path]
    if os.path.isdir(path):
        names = sorted(f for f in os.listdir(path) if not f.startswith((".", "_")))
        return [os.path.join(path, f) for f in names]
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def read_header(path: str) -> tuple[int, int, int]:
    """``(n, dim, offset of the first record)``."""
    if _is_uri(path):
        fs, p = _fs(path)
        with fs.open_input_file(p) as f:
            head = f.read_at(min(128, f.size()), 0)
    else:
        with open(path, "rb") as f:
            head = f.read(128)
    m = _HEADER.match(head)
    if not m:
        raise VectorFileError(f"{path}: no 'n dim' header")
    return int(m.group(1)), int(m.group(2)), m.end()


class _Window:
    """``find`` and slicing over a remote file through a sliding read window
    (the memory-map interface the scanner uses, for storage without mmap)."""

    def __init__(self, f, window: int, end: int | None = None):
        self.f, self.size, self.window = f, min(f.size(), end or f.size()), window
        self.lo, self.buf = 0, b""

    def _load(self, start: int, need_end: int):
        end = min(self.size, max(need_end, start + self.window))
        self.buf, self.lo = self.f.read_at(end - start, start), start

    def __len__(self):
        return self.size

    def __getitem__(self, sl: slice) -> bytes:
        a, b = sl.start, min(sl.stop, self.size)
        if a < self.lo or b > self.lo + len(self.buf):
            self._load(a, b)
        return self.buf[a - self.lo:b - self.lo]

    def find(self, sub: bytes, pos: int) -> int:
        while pos < self.size:
            if not (self.lo <= pos < self.lo + len(self.buf)):
                self._load(pos, pos + 1)
            i = self.buf.find(sub, pos - self.lo)
            if i >= 0:
                return self.lo + i
            pos = self.lo + len(self.buf)
        return -1


class _Range(InputPartition):
    """``count`` records after skipping ``first`` from byte ``start``; ``end``: where they
    end, if an index tells."""

    def __init__(self, path: str, start: int, first: int, count: int, base_idx: int, dim: int, end: int | None = None):
        self.path, self.start, self.first, self.count = path, start, first, count
        self.base_idx, self.dim, self.end = base_idx, dim, end


# ----------------------------------------------------------------- offset index

EVERY = 4096
_INDEX_HEAD = 5  # file size, age (0: any), records, dimension, every


def _index_path(path: str) -> str:
    folder, name = os.path.split(path)
    return os.path.join(folder, f".offsets-{name}")


def _open_fs(path: str):
    import pyarrow.fs as pafs
    return _fs(path) if _is_uri(path) else (pafs.LocalFileSystem(), path)


def _state(path: str) -> tuple[int, int]:
    fs, p = _open_fs(path)
    info = fs.get_file_info(p)
    return info.size, info.mtime_ns or 0


def _read_index(path: str, n: int, dim: int) -> tuple[int, np.ndarray] | None:
    """``(every, offsets)`` of a usable index of the file."""
    import pyarrow.fs as pafs
    fs, p = _open_fs(_index_path(path))
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_file(p) as f:
        raw = np.frombuffer(f.read(), dtype="<i8")
    size, age = _state(path)
    if len(raw) <= _INDEX_HEAD or raw[0] != size or raw[1] not in (0, age) or tuple(raw[2:4]) != (n, dim):
        return None
    return int(raw[4]), raw[_INDEX_HEAD:]


def _index_bytes(size: int, age: int, n: int, dim: int, every: int, offsets) -> bytes:
    return np.concatenate(([size, age, n, dim, every], offsets)).astype("<i8").tobytes()


def build_index(path: str, every: int = EVERY, window: int = 64 * 1024 * 1024) -> int:
    """Write the offset index of one file; returns the number of offsets."""
    n, dim, pos = read_header(path)
    size, age = _state(path)
    fs, p = _open_fs(path)
    offsets = []
    with fs.open_input_file(p) as f:
        src = _Window(f, window)
        for first in range(0, n, every):
            offsets.append(pos)
            pos = _skip(src, pos, dim, min(every, n - first), path)
    out = _open_fs(_index_path(path))[1]
    own = f"{out}-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(own) as f:
        f.write(_index_bytes(size, age, n, dim, every, offsets))
    fs.move(own, out)
    return len(offsets)


def index_vectors(spark, path: str, every: int = EVERY) -> int:
    """Index the files of ``path`` that have none, one task per file; returns their number."""
    todo = [f for f in _files(_norm(path)) if _read_index(f, *read_header(f)[:2]) is None]
    if todo:
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([build_index(f, every) for f in b.column(0).to_pylist()],
                                                           pa.int64())], ["n"])
        spark.createDataFrame([(f,) for f in todo], "path string").repartition(len(todo)).mapInArrow(run, "n long").count()
    return len(todo)


def _scan(mm, pos: int, dim: int, count: int, path: str):
    """Record starts/word ends for ``count`` records from byte ``pos``."""
    rec = 4 * dim
    size = len(mm)
    wstart = np.empty(count, dtype=np.int64)
    wend = np.empty(count, dtype=np.int64)
    for k in range(count):
        sp = mm.find(b" ", pos)
        if sp < 0 or sp + 1 + rec > size:
            raise VectorFileError(f"{path}: file ends inside record {k}")
        wstart[k], wend[k] = pos, sp
        pos = sp + 1 + rec
    return wstart, wend, pos


def _skip(mm, pos: int, dim: int, count: int, path: str) -> int:
    rec = 4 * dim
    for k in range(count):
        sp = mm.find(b" ", pos)
        if sp < 0:
            raise VectorFileError(f"{path}: file ends inside record {k}")
        pos = sp + 1 + rec
    return pos


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = _norm(options.get("path"))
        self.records_per_partition = int(options.get("recordsPerPartition", "250000"))
        self.batch_rows = int(options.get("batchRows", "8192"))
        self.window_bytes = int(options.get("windowBytes", str(64 * 1024 * 1024)))

    def partitions(self):
        parts, base = [], 0
        for fp in _files(self.path):
            n, dim, start = read_header(fp)
            step = max(1, self.records_per_partition)
            index = _read_index(fp, n, dim) if n > step else None
            if index:
                every, offsets = index
                step = -(-step // every) * every
            for first in range(0, n, step):
                count = min(step, n - first)
                if index:
                    last = (first + step) // every
                    parts.append(_Range(fp, int(offsets[first // every]), 0, count, base + first, dim,
                                        int(offsets[last]) if last < len(offsets) else None))
                else:
                    parts.append(_Range(fp, start, first, count, base + first, dim))
            base += n
        return parts or [_Range("", 0, 0, 0, 0, 0)]

    def read(self, part: _Range):
        if part.count == 0:
            return
        if _is_uri(part.path):
            fs, p = _fs(part.path)
            with fs.open_input_file(p) as f:
                src = _Window(f, self.window_bytes, part.end)
                pos = _skip(src, part.start, part.dim, part.first, part.path)
                yield from self._batches(src, pos, part)
            return
        with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mm:
            pos = _skip(mm, part.start, part.dim, part.first, part.path)
            yield from self._batches(mm, pos, part)

    def _batches(self, mm, pos, part):
        done = 0
        while done < part.count:
            k = min(self.batch_rows, part.count - done)
            wstart, wend, end = _scan(mm, pos, part.dim, k, part.path)
            # copy this batch's bytes: no numpy view stays on the memory map
            buf = np.frombuffer(mm[pos:end], dtype=np.uint8)
            base, pos = pos, end
            words = [bytes(mm[a:b]).replace(b"\n", b"").decode("utf-8", "replace")
                     for a, b in zip(wstart.tolist(), wend.tolist())]
            offs = (wend + 1 - base)[:, None] + np.arange(4 * part.dim, dtype=np.int64)[None, :]
            vals = buf[offs].reshape(-1).view("<f4").astype(np.float32, copy=False)
            vec = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (k + 1) * part.dim, part.dim, dtype=np.int32)), pa.array(vals))
            idx = pa.array(np.arange(part.base_idx + done, part.base_idx + done + k, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), idx, vec],
                                             names=["word", "word_idx", "vec"])
            done += k


class _Commit(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # (hidden name, final name)


class _Writer(DataSourceArrowWriter):
    """Tasks write files under hidden names of their own; the driver's commit
    publishes those of the successful attempts, so a retry adds nothing twice."""

    def __init__(self, options, overwrite: bool):
        self.path = _norm(options.get("path"))
        self.overwrite = overwrite
        self.file_bytes = int(options.get("fileBytes", str(64 * 1024 * 1024)))
        # names sort after those of earlier saves, so appended records follow
        self.save = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _target(self):
        import pyarrow.fs as pafs
        fs, p = _fs(self.path) if _is_uri(self.path) else (pafs.LocalFileSystem(), self.path)
        return fs, p.rstrip("/")

    @staticmethod
    def _records(batch: pa.RecordBatch, dim: int | None):
        """(dim, records as bytes) of a batch, with the file-format checks."""
        vec = batch.column(batch.schema.get_field_index("vec"))
        lengths = set(vec.value_lengths().to_pylist()) | ({dim} if dim is not None else set())
        if len(lengths) != 1 or None in lengths:
            raise VectorFileError(f"vectors of different lengths in one file: {sorted(map(str, lengths))}")
        dim = lengths.pop()
        vals = vec.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
        records = []
        for word, row in zip(batch.column(batch.schema.get_field_index("word")).to_pylist(), vals):
            if word is None or " " in word or "\n" in word:
                raise VectorFileError(f"not a word of a vector file: {word!r}")
            records.append(word.encode("utf-8") + b" " + row.tobytes())
        return dim, records

    def write(self, batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid, attempt = ctx.partitionId() if ctx else 0, uuid.uuid4().hex[:8]
        fs, folder = self._target()
        fs.create_dir(folder, recursive=True)
        files, held, size, dim = [], [], 0, None

        def flush():
            # the header comes first and needs the count: a file is held in memory, and is of bounded size
            name = f"part-{self.save}-{pid:05d}-{len(files):05d}.bin"
            hidden = f"_{attempt}-{name}"
            with fs.open_output_stream(f"{folder}/{hidden}") as f:
                f.write(f"{len(held)} {dim}\n".encode())
                for record in held:
                    f.write(record)
            files.append((hidden, name))
            if len(held) > EVERY:
                ends = np.cumsum([len(f"{len(held)} {dim}\n")] + [len(r) for r in held])
                with fs.open_output_stream(f"{folder}/{hidden}-offsets") as f:
                    f.write(_index_bytes(int(ends[-1]), 0, len(held), dim, EVERY, ends[:-1:EVERY]))
                files.append((f"{hidden}-offsets", f".offsets-{name}"))
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, records = self._records(batch, dim)
            for record in records:
                held.append(record)
                size += len(record)
                if size >= self.file_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return _Commit(files)

    @staticmethod
    def _names(fs, folder: str) -> list[str]:
        import pyarrow.fs as pafs
        return [os.path.basename(i.path) for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
                if i.type == pafs.FileType.File]

    def commit(self, messages):
        fs, folder = self._target()
        fs.create_dir(folder, recursive=True)
        old = [n for n in self._names(fs, folder) if not n.startswith((".", "_"))]
        for m in messages:
            for hidden, name in m.files if m else []:
                fs.move(f"{folder}/{hidden}", f"{folder}/{name}")
        if self.overwrite:
            there = set(self._names(fs, folder))
            for n in old:
                for x in {n, f".offsets-{n}"} & there:
                    fs.delete_file(f"{folder}/{x}")
        self._clean(fs, folder)

    def abort(self, messages):
        self._clean(*self._target())

    def _clean(self, fs, folder: str):
        """Remove the hidden files of this save (failed or doubled attempts)."""
        for n in self._names(fs, folder):
            if n.startswith("_") and self.save in n:
                fs.delete_file(f"{folder}/{n}")


class Word2VecBinary(DataSource):
    @classmethod
    def name(cls):
        return "word2vec_bin"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Word2VecBinary)


def read_vectors(spark, path: str, records_per_partition: int = 250000):
    register(spark)
    return (spark.read.format("word2vec_bin").option("path", path)
            .option("recordsPerPartition", str(records_per_partition)).load())


def write_vectors(df, path: str, n_files: int | None = None):
    """Write ``word, word_idx, vec`` in ``word_idx`` order, one file per range."""
    register(df.sparkSession)
    out = df.repartitionByRange(n_files or df.sparkSession.sparkContext.defaultParallelism, "word_idx") \
        .sortWithinPartitions("word_idx") if "word_idx" in df.columns else df
    out.select("word", "vec").write.format("word2vec_bin").mode("append").option("path", path).save()


def import_vectors(spark, path: str, out: str, records_per_partition: int = 250000):
    """Import a vector file (or folder) once into Parquet, one row per word.

    A repeated word keeps its first vector in file order, as the lookup of the
    service did. Files without an offset index get one first. Later jobs read the
    table with ``spark.read.parquet(out)`` and its size from the manifest
    (:func:`vecfactor.operators.centers.read_manifest`).
    """
    from vecfactor.operators.centers import dedup_vocabulary, save_vocabulary
    index_vectors(spark, path)
    return save_vocabulary(dedup_vocabulary(read_vectors(spark, path, records_per_partition)), out)
