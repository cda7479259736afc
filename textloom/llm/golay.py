"""Keys from the perfect binary Golay code (23, 12, 7).

Every 23-bit vector lies within 3 bits of exactly one codeword. ``near`` gives that
codeword's index, and for a vector at distance 3 also the five codewords at distance 4.
For two vectors that differ in at most one bit, the nearest codeword of either one is
among the keys of the other: at distance 2 or less from its codeword a vector keeps that
codeword when a bit flips, and one at distance 3 holds every codeword within 4.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, permutations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
KEYS = 6


def _syndrome(v: int) -> int:
    for shift in range(11, -1, -1):
        if v >> (shift + 11) & 1:
            v ^= GENERATOR << shift
    return v


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the unit vectors, and for each syndrome its error patterns (-1: none)."""
    unit = np.array([_syndrome(1 << b) for b in range(23)], np.int64)
    errors = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(unit[b])
            if weight < 4 or len(errors[s]) and bin(errors[s][0]).count("1") == 3:
                errors[s].append(sum(1 << b for b in bits))
    table = np.full((1 << 11, KEYS), -1, np.int64)
    for s, found in enumerate(errors):
        table[s, : len(found)] = found
    return unit, table


def near(vectors: np.ndarray) -> np.ndarray:
    """For each vector up to six 12-bit codeword indices, the nearest first; -1 fills up."""
    unit, table = _tables()
    v = vectors.astype(np.int64)
    syndrome = np.zeros(len(v), np.int64)
    for b in range(23):
        syndrome ^= (v >> b & 1) * unit[b]
    errors = table[syndrome]
    return np.where(errors < 0, -1, (v[:, None] ^ errors) >> 11)


#: Lowest bit, width, and zero bits put below each segment of a 64-bit fingerprint.
SEGMENTS = ((0, 22, 1), (22, 21, 2), (43, 21, 2))
#: Bit from which a key holds its kind, and for each kind a segment of which the key says nothing (for the last two: little).
KIND_BIT = 52
OPEN_SEGMENTS = (*(3 - i - j for i, j in permutations(range(3), 2)), 0, 0)


def _parity(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.astype(np.uint64)).astype(np.int64) & 1


def pair_keys(fingerprints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys of both sides of a join that brings together all fingerprints within 3 bits.

    Up to three differing bits over three segments leave either one segment equal and
    another with one bit at most, or one bit in each. For the first case the key is a whole
    segment and a codeword of another: the nearest on the left side, all on the right. For
    the second it has codewords of the first two segments, one of them the nearest on each
    side, the parities of all three, which differ, and a half of the third, which is equal
    in one of its halves. Each side is (row number of the fingerprint, key).
    """
    f = fingerprints.astype(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width, _ in SEGMENTS]
    keys = [near(part << pad) for part, (_, _, pad) in zip(parts, SEGMENTS)]
    parity = sum(_parity(part) << k for k, part in enumerate(parts))
    halves = parts[2] & 0x3FF, parts[2] >> 10
    sides = []
    for left in (True, False):
        rows, found = [], []

        def add(kind: int, many: np.ndarray, fixed: np.ndarray, shift: int) -> None:
            row, column = np.nonzero(many >= 0)
            rows.append(row)
            found.append(kind << KIND_BIT | fixed[row] | many[row, column] << shift)

        for kind, (i, j) in enumerate(permutations(range(3), 2)):
            add(kind, keys[j][:, :1] if left else keys[j], parts[i] << 12, 0)
        for kind, half in enumerate(halves, 6):
            rest = half << 27 | (parity if left else parity ^ 7) << 24
            if left:
                add(kind, keys[1], rest | keys[0][:, 0] << 12, 0)
            else:
                add(kind, keys[0], rest | keys[1][:, 0], 12)
        sides.append((np.concatenate(rows), np.concatenate(found)))
    return sides[0], sides[1]
