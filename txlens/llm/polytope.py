"""Cross-polytope hashing after fast Hadamard rotations, with several probes per table.

A rotation is three rounds of random signs and a Walsh-Hadamard transform, in n log n steps. The hash of a rotated
vector is its nearest vertex of the cross-polytope: the coordinate of largest size, with its sign. A table joins `depth`
hashes, each with a rotation of its own. A vector's probes in a table are the vertex combinations it lies closest to,
by the sum of what each vertex falls short of the nearest one, so the first probe is the plain hash.
"""

from __future__ import annotations

from itertools import product

import numpy as np

#: Rounds of signs and transforms of a rotation; with three the result is close to a random rotation.
ROUNDS = 3
#: Nearest vertices of one hash that probes choose from.
VERTICES = 4


def width(dimensions: int) -> int:
    """The power of two that vectors are padded to; at least four, so that a hash has vertices to choose from."""
    return max(4, 1 << (dimensions - 1).bit_length())


def signs(table: int, hash_no: int, size: int) -> np.ndarray:
    """Random signs of a rotation, the same in every process."""
    return np.random.default_rng([17, table, hash_no, size]).choice(np.array([-1, 1], np.float32), (ROUNDS, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, without the scale."""
    rows, size = x.shape
    half = 1
    while half < size:
        y = x.reshape(rows, size // (2 * half), 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(rows, size)
        half *= 2
    return x


def rotated(x: np.ndarray, table: int, hash_no: int) -> np.ndarray:
    size = x.shape[1]
    for s in signs(table, hash_no, size):
        x = hadamard(x * s) / np.float32(np.sqrt(size))
    return x


def vertices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, shortfalls) of the nearest vertices of each row, nearest first; a code is 2 x coordinate + sign."""
    size = np.abs(x)
    # equal sizes: the smaller coordinate first
    near = np.argsort(-size, axis=1, kind="stable")[:, :VERTICES]
    at = np.take_along_axis(size, near, axis=1)
    negative = np.take_along_axis(x, near, axis=1) < 0
    return 2 * near + negative, (at[:, :1] - at) ** 2


def _choices(depth: int) -> np.ndarray:
    """Combinations of vertex ranks that can be among the nearest few."""
    return np.array([c for c in product(range(VERTICES), repeat=depth) if np.prod(np.array(c) + 1) <= 2 * VERTICES], np.int64)


def most_probes(depth: int, count: int) -> int:
    """How many of the probes asked for a table of this depth has."""
    return min(count, len(_choices(depth)))


def probes(x: np.ndarray, table: int, depth: int, count: int) -> np.ndarray:
    """Bucket numbers (rows: vectors, columns: probes, the plain hash first) of padded unit vectors in a table."""
    found = [vertices(rotated(x, table, h)) for h in range(depth)]
    choices = _choices(depth)
    short = sum(v[1][:, choices[:, h]] for h, v in enumerate(found))
    best = np.argsort(short, axis=1, kind="stable")[:, :count]
    bucket = np.zeros((len(x), best.shape[1]), np.int64)
    for h, (codes, _) in enumerate(found):
        bucket = bucket * (2 * x.shape[1]) + np.take_along_axis(codes, choices[best, h], axis=1)
    return bucket


def meeting_share(dimensions: int, cosine: float, depth: int, count: int, pairs: int = 4000) -> float:
    """How many of random pairs at exactly this cosine share a bucket of a table; over two tables."""
    dimensions = max(dimensions, 2)
    rng = np.random.default_rng(23)
    a, n = rng.standard_normal((pairs, dimensions)), rng.standard_normal((pairs, dimensions))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n -= (n * a).sum(axis=1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine * cosine) * n
    pad = np.zeros((pairs, width(dimensions) - dimensions))
    met = 0.0
    for table in (0, 1):
        x, y = (probes(np.hstack([v, pad]).astype(np.float32), table, depth, count) for v in (a, b))
        met += (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean()
    return met / 2
