import os
import struct

import numpy as np
import pytest

from vecfactor.sources.w2v import VectorFileError, read_vectors, write_vectors


def _write(path, words, vecs, n=None, dim=None, newline=True):
    dim = dim if dim is not None else len(vecs[0])
    with open(path, "wb") as f:
        f.write(f"{n if n is not None else len(words)} {dim}\n".encode())
        for w, v in zip(words, vecs):
            f.write(w.encode() + b" " + struct.pack(f"<{dim}f", *v))
            if newline:
                f.write(b"\n")


def test_read_file(spark, tmpdir_shared):
    p = os.path.join(tmpdir_shared, "v.bin")
    words = ["a", "b", "a", "héllo"]
    vecs = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0], [0.5, 0.25, 0.125]]
    _write(p, words, vecs)
    rows = sorted(read_vectors(spark, p, records_per_partition=1).collect(), key=lambda r: r["word_idx"])
    assert [r["word"] for r in rows] == words
    assert [r["word_idx"] for r in rows] == [0, 1, 2, 3]
    assert np.allclose([r["vec"] for r in rows], vecs)


def test_space_like_float_bytes(spark, tmpdir_shared):
    # 32.0 as float32 is 0x42000000 -> contains no space, but 2.0000076 contains 0x20 bytes
    p = os.path.join(tmpdir_shared, "s.bin")
    v = struct.unpack("<f", b"\x20\x20\x20\x40")[0]
    _write(p, ["x", "y"], [[v, v], [1.0, v]], newline=False)
    rows = sorted(read_vectors(spark, p).collect(), key=lambda r: r["word_idx"])
    assert [r["word"] for r in rows] == ["x", "y"]
    assert np.allclose(rows[1]["vec"], [1.0, v])


def test_short_and_missing_file(spark, tmpdir_shared):
    p = os.path.join(tmpdir_shared, "short.bin")
    _write(p, ["a"], [[1.0, 2.0]], n=3)
    with pytest.raises(Exception) as e:
        read_vectors(spark, p).collect()
    assert "ends inside record" in str(e.value) or isinstance(e.value, VectorFileError)
    with pytest.raises(Exception):
        read_vectors(spark, os.path.join(tmpdir_shared, "nope.bin")).collect()


def test_write_then_read_roundtrip(spark, tmpdir_shared):
    rows = [(f"w{i}", i, [float(i), float(-i), 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "word string, word_idx long, vec array<float>")
    out = os.path.join(tmpdir_shared, "vecs")
    write_vectors(df, out, n_files=3)
    back = sorted(read_vectors(spark, out, records_per_partition=7).collect(), key=lambda r: r["word_idx"])
    assert [(r["word"], r["word_idx"]) for r in back] == [(w, i) for w, i, _ in rows]
    assert np.allclose([r["vec"] for r in back], [v for _, _, v in rows])


def test_long_and_non_ascii_words_kept_whole(spark, tmpdir_shared):
    p = os.path.join(tmpdir_shared, "long.bin")
    words = ["b" * 70, "ñandú", "x"]
    _write(p, words, [[1.0], [2.0], [3.0]])
    rows = sorted(read_vectors(spark, p).collect(), key=lambda r: r["word_idx"])
    assert [r["word"] for r in rows] == words


def test_uri_paths_use_windowed_reads(spark, tmpdir_shared):
    """Storage addressed by URI (read through pyarrow.fs, no mmap) gives the
    same rows, also with a read window smaller than one record."""
    rows = [(f"w{i}" * (1 + i % 5), i, [float(i), float(-i), 0.25, 32.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "word string, word_idx long, vec array<float>")
    out = "file://" + os.path.join(tmpdir_shared, "uri_vecs")
    write_vectors(df, out, n_files=3)
    for window in ("7", "100000"):
        back = (spark.read.format("word2vec_bin").option("path", out).option("recordsPerPartition", "40")
                .option("windowBytes", window).load().collect())
        back = sorted(back, key=lambda r: r["word_idx"])
        assert [(r["word"], r["word_idx"]) for r in back] == [(w, i) for w, i, _ in rows]
        assert np.allclose([r["vec"] for r in back], [v for _, _, v in rows])
    with pytest.raises(Exception):
        read_vectors(spark, "file://" + os.path.join(tmpdir_shared, "missing")).collect()


def test_import_keeps_first_of_repeated_words(spark, tmpdir_shared):
    from vecfactor.sources.w2v import import_vectors
    p = os.path.join(tmpdir_shared, "dup.bin")
    _write(p, ["a", "b", "a"], [[1.0], [2.0], [3.0]])
    v = {r["word"]: (r["word_idx"], r["vec"]) for r in
         import_vectors(spark, p, os.path.join(tmpdir_shared, "dup_parquet")).collect()}
    assert v == {"a": (0, [1.0]), "b": (1, [2.0])}


def _save(spark, rows, out, mode):
    from vecfactor.sources.w2v import register
    register(spark)
    df = spark.createDataFrame(rows, "word string, vec array<float>")
    df.coalesce(1).write.format("word2vec_bin").mode(mode).option("path", out).save()


def _words(spark, out):
    return [r["word"] for r in sorted(read_vectors(spark, out).collect(), key=lambda r: r["word_idx"])]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_append_overwrite_and_refused_words(spark, tmpdir_shared, scheme):
    out = scheme + os.path.join(tmpdir_shared, "modes" + scheme[:4])
    _save(spark, [("a", [1.0]), ("b", [2.0])], out, "append")
    _save(spark, [("c", [3.0])], out, "append")
    assert _words(spark, out) == ["a", "b", "c"]
    for bad in ("x\ny", "x y", None):
        with pytest.raises(Exception):
            _save(spark, [("d", [1.0]), (bad, [1.0])], out, "append")
    with pytest.raises(Exception):
        _save(spark, [("d", [1.0]), ("e", [1.0, 2.0])], out, "append")
    folder = out[len(scheme):]
    assert _words(spark, out) == ["a", "b", "c"] and not [n for n in os.listdir(folder) if n.startswith("_")]
    _save(spark, [("z", [9.0])], out, "overwrite")
    assert _words(spark, out) == ["z"] and len(os.listdir(folder)) == 1


def test_files_of_bounded_size(spark, tmpdir_shared):
    from vecfactor.sources.w2v import register
    register(spark)
    out = os.path.join(tmpdir_shared, "bounded")
    rows = [(f"w{i:03d}", [float(i), 0.5]) for i in range(100)]
    spark.createDataFrame(rows, "word string, vec array<float>").coalesce(1).write.format("word2vec_bin") \
        .mode("append").option("path", out).option("fileBytes", "130").save()
    assert len(os.listdir(out)) == 10 and _words(spark, out) == [w for w, _ in rows]


def _reader_bytes(monkeypatch, path, step):
    """(records, bytes fetched) when every range of the file is read on its own."""
    from vecfactor.sources import w2v
    fetched = []
    load = w2v._Window._load

    def counting(self, start, need_end):
        load(self, start, need_end)
        fetched.append(len(self.buf))
    monkeypatch.setattr(w2v._Window, "_load", counting)
    reader = w2v._Reader({"path": path, "recordsPerPartition": str(step)})
    rows = [w for p in reader.partitions() for b in reader.read(p) for w in b.column(0).to_pylist()]
    return rows, sum(fetched), len(reader.partitions())


def test_offset_index_reads_the_file_once(spark, tmpdir_shared, monkeypatch):
    from vecfactor.sources.w2v import index_vectors
    p = os.path.join(tmpdir_shared, "big.bin")
    words = [f"w{i}" * (1 + i % 4) for i in range(3000)]
    _write(p, words, [[float(i), 32.0, -1.0] for i in range(3000)])
    uri, size = "file://" + p, os.path.getsize(p)
    rows, plain, _ = _reader_bytes(monkeypatch, uri, 100)
    assert rows == words and plain > 5 * size                 # hopping from the first record
    assert index_vectors(spark, uri, every=50) == 1 and index_vectors(spark, uri, every=50) == 0
    for step in (100, 70, 1):
        rows, got, parts = _reader_bytes(monkeypatch, uri, step)
        assert rows == words and got <= size and parts == (60 if step == 1 else 30)
    assert [r["word"] for r in sorted(read_vectors(spark, p, 100).collect(), key=lambda r: r["word_idx"])] == words
    # a file that was replaced is not read by the old index
    _write(p, words[::-1], [[1.0, 32.0, -1.0]] * 3000)
    os.utime(p, ns=(1, 1))
    assert _reader_bytes(monkeypatch, uri, 1000)[0] == words[::-1]
    assert index_vectors(spark, uri) == 1


def test_written_files_have_an_index(spark, tmpdir_shared, monkeypatch):
    out = os.path.join(tmpdir_shared, "indexed")
    rows = [(f"w{i}", i, [float(i)]) for i in range(10_000)]
    write_vectors(spark.createDataFrame(rows, "word string, word_idx long, vec array<float>"), out, n_files=1)
    names = sorted(os.listdir(out))
    assert len(names) == 2 and names[0] == f".offsets-{names[1]}"
    got, fetched, parts = _reader_bytes(monkeypatch, f"file://{out}/{names[1]}", 4096)
    assert got == [w for w, _, _ in rows] and parts == 3 and fetched <= os.path.getsize(f"{out}/{names[1]}")
