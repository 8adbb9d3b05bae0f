"""Rolling hashes, window anchors and packed columns for exact repeats, all in numpy.

A window is `length` units (bytes or words). Its anchor is the place of the smallest hash of its k-unit runs, the
first one in a tie, so equal windows have their anchors at equal places with equal hashes. Neighbouring windows mostly
share an anchor: about 2 / (length - k + 2) anchors per unit stand for all windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BASE = np.uint64(xxhash.xxh64_intdigest(b"base", 1) | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([i]), 2) for i in range(256)], dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: Values of which several forms are in memory at once.
SLICE = 1 << 15
_LOW = np.uint64((1 << 26) - 1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base or of its inverse."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK + (1 << 16)), BASE if kind == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the upper bits over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    down, out = _power("down", len(values) + 1), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), SLICE):
        a, z = starts[i:i + SLICE], ends[i:i + SLICE]
        out[i:i + SLICE] = mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a byte array; slices are cut between words."""
    edges = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    hashes, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK)))
        a, z = starts[i], ends[j - 1]
        hashes[i:j] = spans_hash(BYTE_VALUES[data[a:z]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return hashes, starts, ends


def _smallest(c: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours."""
    span = 1
    while 2 * span <= w:
        c = np.minimum(c[:-span], c[span:])
        span *= 2
    return np.minimum(c[: len(c) - (w - span)], c[w - span:]) if w > span else c


def anchors(values: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) over the concatenated units of texts with these sizes."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    at = np.arange(n - k + 1)
    h = spans_hash(values, at, at + k)
    low = h & ~_LOW
    low |= at.view(np.uint64)
    del at
    smallest = _smallest(low, length - k + 1)
    del low
    ends = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    starts = np.flatnonzero(ends[: n - length + 1] - np.arange(n - length + 1, dtype=np.int32) >= length)
    del ends
    place = (smallest[starts] & _LOW).astype(np.int64)
    if not len(place):
        return h[:0], place, place, place
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[new]], place[new], starts[new], starts[np.append(new[1:], len(place)) - 1]


def chunks(bodies: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, sizes): whole texts of together about CHUNK bytes, nulls empty."""
    bodies = bodies.fill_null(b"")
    offsets = np.frombuffer(bodies.buffers()[1], np.int32 if bodies.type == pa.binary() else np.int64)[bodies.offset: bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8) if bodies.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(bodies):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], np.diff(offsets[i:j + 1])
        i = j


def slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start:start + size] of each pair, one after another; the places of a part of them at a time are in memory."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out, i = np.empty(cuts[-1], data.dtype), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SLICE, side="right")) - 1)
        at = np.repeat(starts[i:j] - cuts[i:j], sizes[i:j])
        at += np.arange(cuts[i], cuts[j])
        out[cuts[i]:cuts[j]] = data[at]
        i = j
    return out


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column with values[cut:next cut] in each row; cuts has one more entry than rows."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all rows of a binary column, one after another."""
    return np.frombuffer(b"".join(v.as_py() or b"" for v in column), kind)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Cuts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
