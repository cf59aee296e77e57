"""Words of whole texts and their hashes, many texts at a time, as numpy arrays inside a task.

A piece is a run of rows of an Arrow batch with a bounded number of text bytes (one row at least), so a task holds
a few such pieces at most. Within a piece the temporary arrays of the hashes cover `BLOCK` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20
BLOCK = 1 << 18
U = np.uint64

#: Bytes between words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes between words where only letters and digits (and all of the non-ASCII bytes) count.
MARKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def combine(a: np.ndarray, b: np.ndarray, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    return mix(a * U(factor) + b)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK) + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


@dataclass
class Words:
    """Words of a piece in order: their row, first byte, byte after the last, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: For each row of the piece the number of its first word, and the number of all words at the end.
    first: np.ndarray


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


SAME = np.arange(256, dtype=np.uint8)
LOWER = lower_table()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at most `limit` text bytes, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at, n = 0, batch.num_rows
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(column: pa.Array, separators: bytes = SPACES, lower: bool = False, hashed: bool = True) -> Words:
    """Words are the longest runs of bytes that are no separators. The hash is of the bytes, A-Z lowered if asked."""
    raw, at = buffer_of(column)
    n = len(raw)
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    if lower:
        is_word = is_word[LOWER]
    inside = is_word[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = inside.copy()
    begins[1:] &= cut[1:n] | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= cut[1:n] | ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at, "left")
    row = np.repeat(np.arange(len(column)), np.diff(first))
    hashes = _hashes(raw, start, end, LOWER if lower else SAME) if hashed else np.zeros(0, np.uint64)
    return Words(row, start, end, hashes, first)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    out, at, n = np.empty(len(start), np.uint64), 0, len(start)
    code = _BYTE[table]
    while at < n:
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        part = raw[low : end[to - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(code[part] * power[: len(part)], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hash(h: np.ndarray, k: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive entries, put together from windows of 1, 2, 4, ... entries."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, length, power, p = None, 0, h, 1
    while True:
        if k & p:
            if out is None:
                out = power
            else:
                m = len(h) - length - p + 1
                out = combine(out[:m], power[length : length + m], factor)
            length += p
        if 2 * p > k:
            return out
        m = len(h) - 2 * p + 1
        power = combine(power[:m], power[p : p + m], factor)
        p *= 2


def windows(words: Words, k: int, factor: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows of k words that lie in one row."""
    h = window_hash(words.hash, k, factor)
    ok = words.row[: len(h)] == words.row[k - 1 : k - 1 + len(h)]
    at = np.flatnonzero(ok)
    return at, h[at]


def covered(at: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Marks of the n words that a window of k words from one of `at` covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1]) > 0


def without(raw: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the marked words: each goes with the white space after it, up to the next word."""
    keep = np.ones(len(raw), bool)
    following = np.append(start[1:], len(raw))
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, start[gone], 1)
    np.add.at(edges, following[gone], -1)
    keep &= np.cumsum(edges[:-1]) == 0
    return np.frombuffer(raw, np.uint8)[keep].tobytes()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return values.view(np.int64) if values.flags["C_CONTIGUOUS"] else np.ascontiguousarray(values).view(np.int64)
