"""Vectorised text primitives for Arrow batches: words, hashes and encodings in numpy.

A batch of texts is one byte array with offsets, so every step below works on all texts of the batch at once.
Words are maximal runs of bytes outside space and \\t..\\r, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RADIX = U(0x9E3779B97F4A7C15)
_WORD = U(0xD6E8FEB86659FD93)
NULL_ID = np.iinfo(np.int64).max  # a null id owns nothing: it sorts after every other id


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def combine(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def ids_of(column) -> np.ndarray:
    """int64 ids; null becomes NULL_ID."""
    return combine(column).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and offsets (n + 1). Null counts as empty."""
    arr = combine(column)
    arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string())
    arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=arr.offset + n + 1)[arr.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if n and arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

NOT_ALNUM = np.ones(256, bool)  # separators for tokens of letters and digits; bytes of multi-byte characters count as letters
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = _LOWER


@dataclass
class Words:
    """The words of a batch: byte spans, index of the text each stands in, first word of each text (n + 1)."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are not in the byte set ``space``."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(len(offsets), np.int64))
    ink = ~space[data]
    head, tail = ink.copy(), ink.copy()
    head[1:] &= ~ink[:-1]
    tail[:-1] &= ~ink[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]  # a word never runs from one text into the next
    head[edge] |= ink[edge]
    tail[edge - 1] |= ink[edge - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 256) - 1, _WORD, U), dtype=U)])
    return _powers


def hash_words(data: np.ndarray, words: Words, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every word's bytes (after the byte map ``fold``, such as _LOWER)."""
    length = words.end - words.start
    if not len(length):
        return np.zeros(0, U)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    inside = np.arange(int(length.sum())) - np.repeat(begin, length)
    chars = data[np.repeat(words.start, length) + inside]
    if fold is not None:
        chars = fold[chars]
    with np.errstate(over="ignore"):
        value = (chars.astype(U) + U(1)) * powers(int(length.max()))[inside]
        return mix(np.add.reduceat(value, begin) + length.astype(U) * _RADIX)


def roll(hashes: np.ndarray, width: int, radix: U = _RADIX) -> np.ndarray:
    """Rabin-Karp value of every run of ``width`` hashes: sum of h[i + j] * radix ** (width - 1 - j), modulo 2 ** 64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc = hashes[:n].copy()
        for j in range(1, width):
            acc *= radix
            acc += hashes[j:n + j]
    return acc


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Little-endian integers as byte planes: high planes of small numbers are runs of zeros, which block compression drops."""
    x = np.ascontiguousarray(x)
    view = x.view(np.uint8).reshape(-1, x.dtype.itemsize)
    return view[:, :width or x.dtype.itemsize].T.tobytes()


def unplanes(raw: bytes | np.ndarray, n: int, width: int, dtype=U) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def join_words(data: np.ndarray, words: Words, keep: np.ndarray, n_texts: int) -> pa.Array:
    """The kept words of each text, joined by one space, as large strings."""
    length = (words.end - words.start)[keep]
    text = words.text[keep]
    size = length + 1  # each with the space after it; a text's last one is cut off by its offsets
    total = np.bincount(text, weights=size, minlength=n_texts).astype(np.int64) if len(text) else np.zeros(n_texts, np.int64)
    if not len(text):
        return pa.array([""] * n_texts, pa.large_string())
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(int(size.sum())) - np.repeat(begin, size)
    at = np.repeat(words.start[keep], size) + inside
    last = inside == np.repeat(length, size)
    out = np.where(last, np.uint8(32), data[np.minimum(at, len(data) - 1)])
    ends_text = np.ones(len(text), bool)
    ends_text[:-1] = text[1:] != text[:-1]
    drop = np.zeros(len(out), bool)
    drop[(begin + length)[ends_text]] = True
    out = out[~drop]
    sizes = np.maximum(total - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def spans_cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask of positions 0..n-1 that lie in [s, s + width) for some s in ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:n]) > 0


def slices(batches, column: str, most: int = 2 << 20):
    """Arrow batches cut so that the texts of a piece hold about ``most`` bytes (one text at least): memory follows that, not the rows."""
    for batch in batches:
        size = np.diff(bytes_of(batch.column(column))[1])
        done = np.cumsum(size)
        at = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
