"""Words of many texts at once, read off one byte buffer with NumPy and Arrow.

Tokenising is exact: words are compared byte by byte (Arrow's dictionary
encoding), hashes are made for the distinct words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WORD, SPACE, SEPARATOR = 0, 1, 2


def byte_classes(spaces: bytes, separators: bytes = b"") -> np.ndarray:
    """Class of every byte: of a word, a space, or a separator of pieces."""
    cls = np.full(256, WORD, np.uint8)
    cls[list(spaces)] = SPACE
    cls[list(separators)] = SEPARATOR
    return cls


_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)  # A-Z only


def words(data: bytes, classes: np.ndarray, lower: bool = False):
    """(distinct words, number of the distinct word at each place, start byte of each word)."""
    raw = np.frombuffer(data, np.uint8)
    in_word = np.zeros(len(raw) + 2, bool)
    in_word[1:-1] = classes[raw] == WORD
    edge = np.flatnonzero(in_word[1:] != in_word[:-1])
    start, end = edge[::2], edge[1::2]
    kept = raw[in_word[1:-1]]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    encoded = pa.Array.from_buffers(pa.large_string(), len(start), [
        None, pa.py_buffer(offsets), pa.py_buffer(LOWER[kept] if lower else kept)]).dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), start


def as_bytes(column: pa.Array) -> list:
    """The texts of an Arrow column as bytes; None stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def sliced(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``most`` bytes together (or one item)."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    p = np.full(n, base, dtype=U64)
    p[:1] = 1
    return np.multiply.accumulate(p)
