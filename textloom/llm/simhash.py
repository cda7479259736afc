"""64-bit SimHash over word shingles, computed for batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from textloom.llm.common import slices, split_words, strings

SEED = 42
#: Rows of bits that are summed at a time.
BLOCK = 1 << 17


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group of hashes (``starts`` has one entry more than groups) the bits set in over half of them; 0 for none."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    counts = np.zeros((len(n), 64), np.int64)
    group = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        g = group[at : at + len(part)]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(g)])):
            counts[g[a]] += _column_sums(bits[a:b])
    full = n > 0
    out[full] = np.packbits(2 * counts[full] > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns; eight columns at a time as bytes of a 64-bit integer."""
    total = np.zeros(64, np.int64)
    lanes = bits.view(np.uint64)
    for a in range(0, len(lanes), 255):
        total += lanes[a : a + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words joined by a space; a text of fewer words gives one hash of all of them, none gives none."""
    words, starts = split_words(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), " ")
    data = b"".join(strings(joined.cast(pa.binary())))
    n = np.diff(starts)
    full = n > 0
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length + 1) - 1 - np.repeat(np.cumsum(full) - full, n)
    begins = ends - length
    m = np.where(full, np.maximum(n - size + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(m)])
    first = np.repeat(starts[:-1] - out[:-1], m) + np.arange(out[-1])
    last = np.minimum(first + size, np.repeat(starts[1:], m)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist())), np.uint64, int(out[-1]))
    return hashes, out


def fingerprints(texts: pa.Array, size: int = 3) -> np.ndarray:
    """Fingerprints of texts (A-Z lower-cased) as unsigned 64-bit integers."""
    parts = [majority(*shingle_hashes(pc.ascii_lower(texts[a:b]), size)) for a, b in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
