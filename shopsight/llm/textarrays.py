"""Text columns as flat numpy arrays inside one task.

A batch of texts is one UTF-8 byte array plus offsets; words, lines and their 64-bit
fingerprints come from whole-array operations.  Word separators are the six ASCII
blanks ``\\x20 \\x09-\\x0D``, which never occur inside a multi-byte character, so words
found on bytes are words found on code points.  Batches are cut by bytes, never texts:
a text longer than the bound is a batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
U = np.uint64
_LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of text (at least one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 offsets; null is the empty text."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~BLANK[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte ranges; equal ranges have equal fingerprints."""
    lens = (ends - starts).astype(np.int64)
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", buf, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)
    h = mix(lens.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    if len(h):
        h = mix(h ^ (lanes[starts] & keep[np.minimum(lens, 8)]))
    at = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD))
    k = 8
    while len(at):
        h[at] = mix(h[at] * U(3) ^ (lanes[starts[at] + k] & keep[np.minimum(lens[at] - k, 8)]))
        k += 8
        at = at[lens[at] > k]
    for i in np.flatnonzero(lens > _LONG_WORD):
        d = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(d, "<u8")[0]
    return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of ``size`` consecutive values (order counts); position i
    holds the run that starts at i.  Doubling: log2(size) passes."""
    out, covered, power, span = None, 0, h, 1
    while True:
        if size & span:
            if out is None:
                out, covered = power, span
            else:
                n = len(h) - covered - span + 1
                out = mix(out[:max(n, 0)] * U(0xD6E8FEB86659FD93) + power[covered:covered + max(n, 0)])
                covered += span
        if covered == size:
            return out
        n = len(power) - span
        power = mix(power[:max(n, 0)] * U(0xA0761D6478BD642F) + power[span:span + max(n, 0)]) if n > 0 else power[:0]
        span *= 2


def owner(off: np.ndarray) -> np.ndarray:
    """Index of the text that each element belongs to, from n + 1 offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def spread_counts(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def take_ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s:s + c] for each range, concatenated."""
    return values[np.repeat(starts, counts) + spread_counts(counts)]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in one of the runs [s, s + size)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + size, n), 1)
    return np.cumsum(edge[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)


def list_array(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
