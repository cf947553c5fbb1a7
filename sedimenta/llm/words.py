"""Word and n-gram hashing of whole Arrow batches at numpy speed: no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, so memory doesn't follow the batch size.
SLICE_BYTES = 2_000_000
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: 0 white space, 1 letters, digits and everything beyond ASCII, 2 ASCII punctuation and controls.
CLASS = np.full(256, 2, np.uint8)
CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
CLASS[48:58] = CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1

_rng = np.random.default_rng(20240607)
_BYTE = [_rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse))
    return _powers


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT)))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _pow(max(hi - lo, _SEGMENT))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[which][data[lo:hi]] * up[: hi - lo], out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return mix(out)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; NULL is as the empty string."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of column `name`; a longer row comes alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def _spans(cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one class other than white space, within rows."""
    n = len(cls)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    edge[1:n] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(edge)
    used = cls[at[:-1]] != 0
    return at[:-1][used], at[1:][used]


def words_of(column: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the offsets of the rows in them.

    A word is a maximal run of bytes between ASCII white space, in lower case, with ASCII punctuation taken out;
    what is nothing but punctuation is no word, or, with marks, a word as it stands.
    """
    data, offsets = raw(pc.utf8_lower(column))
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    cls = CLASS[data]
    if marks:
        start, end = _spans(np.minimum(cls, 1), offsets)
        letters = np.concatenate([[0], np.cumsum(cls == 1)])
        only = letters[end] == letters[start]
        # Bytes of such words count as letters.
        at = np.zeros(len(data) + 1, np.int8)
        at[start[only]] += 1
        at[end[only]] -= 1
        cls = np.where(np.cumsum(at[:-1], dtype=np.int8) > 0, np.uint8(1), cls)
    keep = cls != 2
    moved = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data, cls = data[keep], cls[keep]
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = _spans(cls, moved)
    return hash_spans(data, start, end), np.searchsorted(start, moved)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and punctuation runs as they stand, case kept, and the offsets of the rows in them."""
    data, offsets = raw(column)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = _spans(CLASS[data], offsets)
    return hash_spans(data, start, end), np.searchsorted(start, offsets)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster here than numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def summed(key: np.ndarray, weight: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `keys` and the sums of their weights."""
    # No more room than for some times the values at hand.
    if keys <= max(1 << 16, 8 * len(key)):
        total = np.bincount(key, weight, keys).astype(np.float64, copy=False)
        at = np.flatnonzero(total)
        return at, total[at]
    at, inverse = np.unique(key, return_inverse=True)
    # Without any key numpy would count in integers.
    return at, np.bincount(inverse, weight, len(at)).astype(np.float64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _run(h: np.ndarray, at: np.ndarray | slice, k: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(k):
        part = h[at + i] if isinstance(at, np.ndarray) else h[i : i + n]
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(29)
    return mix(out)


def grams_of(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within rows and their row numbers; a row of fewer words is one run of all it has."""
    size = np.diff(offsets)
    rows = row_of(offsets)
    values, owners = [], []
    if len(h) >= n:
        inside = np.arange(len(h) - n + 1) + n <= offsets[1:][rows[: len(h) - n + 1]]
        values.append(_run(h, slice(None), n, len(h) - n + 1)[inside])
        owners.append(rows[: len(h) - n + 1][inside])
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            values.append(_run(h, offsets[short], k, len(short)))
            owners.append(short)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(owners)
