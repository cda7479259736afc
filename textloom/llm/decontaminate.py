"""Benchmark decontamination by SimHash windows, Hamming blocks and exact verification.

Every item has fingerprints of windows nearly as large as itself, which meet passages of
the same words in another order or with little changed, and of the largest windows of
which one must lie untouched inside any passage similar enough. Documents have windows of
the same sizes, at steps that make one lie inside such a passage. Fingerprints within
``radius`` bits agree in one of ``radius`` + 1 blocks, so a lookup of every block finds
all of them. Of each hit all item-sized windows of the document that hold it are compared
with the item by their weighted shingles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, keep_rows, slices, strings, table, text_array
from textloom.llm.simhash import BLOCK

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 3
#: Items, and bytes of their texts, that are broadcast at a time; more are taken in blocks of about that size.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20
#: Shingles in an untouched window, each twice the one before.
WINDOWS = (1, 2, 4, 8, 16)
#: Shingles in an item-sized window: powers of two, and these by half more.
SIZED = tuple(w for k in range(2, 15) for w in (1 << k, 3 << (k - 1)))
#: Pairs of windows that are compared at a time.
PAIRS = 1 << 20
#: Pairs of a text and an item with hits that are gathered before they are verified.
SEEN = 1 << 17
_MULTIPLIER = 0x9E3779B97F4A7C15


def clean_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and digits of all texts, and where each text's begin."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
    words = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.filter(full), at[np.concatenate([[0], np.cumsum(counts)])]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of ``size`` words, and where each text's begin; shorter texts have none."""
    words, starts = clean_words(texts)
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in strings(coded.dictionary)], np.uint64)
    own = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    n = np.maximum(np.diff(starts) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(starts[:-1] - out[:-1], n) + np.arange(out[-1])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total = total * np.uint64(_MULTIPLIER) + own[first + k]
    return _mix(total), out


def window_of(weights: np.ndarray, similarity: float = SIMILARITY) -> int:
    """The largest window of which one lies untouched inside every passage similar enough.

    ``weights`` are those of an item's shingles in their places. A passage that reaches
    ``similarity`` may lose shingles up to the rest of the weight, at most ``lost`` when the
    cheapest go first. Where one untouched run ends and another begins a word was put in
    (four shingles are spoiled), left out or replaced (five), so there are at most
    ``edits`` + 1 runs and the longest has at least ``run`` shingles, wherever the
    words are. A run of one and a half windows holds a whole one, as windows begin at every
    half window (at every shingle for those of one or two). Some shingle is always left.
    """
    n = len(weights)
    lost = int(np.searchsorted(np.cumsum(np.sort(weights)), (1 - similarity) * weights.sum() + 1e-9, "right"))
    edits = lost // (SHINGLE - 1)
    run = -(-(n - lost) // (edits + 1))
    return max((w for w in WINDOWS if w + step_of(w) - 1 <= run), default=WINDOWS[0])


def step_of(size: int) -> int:
    """Shingles from one document window to the next."""
    return max(1, size // 2) if size in WINDOWS else size // 8 or 1


def sized_window(n: int) -> int:
    """The largest window of ``SIZED`` that lies whole inside every run of ``n`` shingles; 0 if there is none."""
    return max((w for w in SIZED if w + step_of(w) - 1 <= n), default=0)


def _kept(item: np.ndarray, weights: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Places of the dearest shingles, of which a passage similar enough cannot lose all."""
    own, first, at, counts = np.unique(item, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-weights[first], kind="stable")
    mass = np.cumsum((weights[first] * counts)[order])
    chosen = np.zeros(len(own), bool)
    chosen[order[: np.searchsorted(mass, (1 - similarity) * weights.sum() + 1e-9, "right") + 1]] = True
    return np.flatnonzero(chosen[at])


def _halves(size: int) -> tuple[int, int]:
    """A window size as the sum of two powers of two, the second 0 for a power of two."""
    high = 1 << (size.bit_length() - 1)
    return high, size - high


def windows(hashes: np.ndarray, starts: np.ndarray, steps: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Fingerprints of windows inside each text, for each size at its step: size, text, place, fingerprint.

    Counts of the 64 bits stand side by side in bytes (larger sizes: two bytes each). Those of
    a window are the sum of its halves', so every doubling is one addition for all places.
    ``BLOCK`` places are taken at a time.
    """
    most = max(steps, default=0)
    places = {}
    for size, step in steps.items():
        n = np.where(np.diff(starts) < size, 0, np.maximum((np.diff(starts) - size) // step + 1, 0))
        text = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
        places[size] = text, place, starts[text] + place
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK + most - 1]
        sums = {1: np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)}
        for size in sorted(steps):
            text, place, at = places[size]
            x, y = np.searchsorted(at, (a, a + BLOCK))
            if x == y:
                continue
            high, low = _halves(size)
            for w in [1 << k for k in range(1, high.bit_length()) if 1 << k not in sums]:
                half = sums[w // 2]
                if w == 256:  # no longer fits in a byte
                    half = half.view(np.uint8).astype(np.uint16).view(np.uint64)
                sums[w] = half[: -(w // 2)] + half[w // 2 :]
            rows = at[x:y] - a
            kind = np.uint8 if size < 256 else np.uint16
            counts = sums[high][rows].view(np.uint8 if high < 256 else np.uint16).astype(kind)
            if low:
                counts = counts + sums[low][rows + high].view(np.uint8 if low < 256 else np.uint16)
            yield size, text[x:y], place[x:y], np.packbits(counts > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Window fingerprints of a block of items, by Hamming blocks.

    ``df`` has the number of items that hold a shingle, over all blocks, at least where
    it is above 1; without it the given items are all there are.
    """

    def __init__(self, ids: list[int], texts: list[str], df: dict[int, int] | None = None, radius: int = RADIUS):
        self.ids, self.radius = ids, radius
        column = text_array(pa.array(texts, pa.string()))
        hashes, starts = shingles(column)
        n = np.diff(starts)
        self.lengths = n
        self.items = [hashes[a:b] for a, b in zip(starts[:-1], starts[1:])]
        if df is None:
            df = Counter(h for item in self.items for h in set(item.tolist()))
        #: rarer shingles weigh more
        self.counts = [Counter(item.tolist()) for item in self.items]
        self.weights = [{h: 1 / (1 + math.log(df.get(h, 1))) for h in own} for own in self.counts]
        self.totals = [sum(c * w[h] for h, c in own.items()) for own, w in zip(self.counts, self.weights)]
        places = [np.array([w[h] for h in item.tolist()]) for w, item in zip(self.weights, self.items)]
        untouched = np.array([window_of(w) if len(w) else 0 for w in places], np.int64)
        sized = np.array([sized_window(int(k)) for k in n], np.int64)
        self.bits = 64 // (radius + 1)
        self.sizes = {}
        for size in sorted({*untouched.tolist(), *sized.tolist()} - {0}):
            chosen = np.flatnonzero((untouched == size) | (sized == size))
            own = np.concatenate([[0], np.cumsum(n[chosen])])
            text, place, prints = (np.concatenate(x) for x in list(zip(*windows(np.concatenate([self.items[k] for k in chosen]), own, {size: 1})))[1:])
            if size == 1:  # one of the dearest is enough
                kept = np.concatenate([a + _kept(self.items[k], places[k]) for a, k in zip(own, chosen)])
                text, place, prints = text[kept], place[kept], prints[kept]
            tables = []
            for b in range(radius + 1):
                key = self._block(prints, b)
                order = np.argsort(key, kind="stable")
                tables.append((np.searchsorted(key[order], np.arange((1 << self.bits) + 1, dtype=np.uint64)), order))
            self.sizes[size] = chosen[text], place, prints, tables
        self._short(column)

    def _short(self, column: pa.Array) -> None:
        """Items of too few words for a shingle, by their number of words: the hash of all of them, and the items."""
        _, starts = clean_words(column)
        words = np.diff(starts)
        self.short = {}
        for size in range(1, SHINGLE):
            chosen = np.flatnonzero(words == size)
            if len(chosen):
                hashes, _ = shingles(column.take(pa.array(chosen)), size)
                order = np.argsort(hashes, kind="stable")
                self.short[size] = hashes[order], chosen[order]

    def _whole(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, words) of items of too few words for a shingle that a text holds, at their first place."""
        for size, (known, items) in self.short.items():
            hashes, starts = shingles(texts, size)
            lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            at = np.flatnonzero(hi > lo)
            n = (hi - lo)[at]
            place = np.repeat(at, n)
            item = items[np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            text = np.searchsorted(starts, place, "right") - 1
            _, one = np.unique(text * len(self.ids) + item, return_index=True)
            for k in one.tolist():
                yield int(text[k]), int(item[k]), int(place[k] - starts[text[k]]), size

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)

    def _near(self, size: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (document window, item window) within the radius, all of them."""
        _, _, items, tables = self.sizes[size]
        for b, (begins, order) in enumerate(tables):
            key = self._block(prints, b).astype(np.int64)
            lo = begins[key]
            n = begins[key + 1] - lo
            ends = np.cumsum(n)
            start = 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                own = n[start:stop]
                row = np.repeat(np.arange(start, stop), own)
                at = np.repeat(lo[start:stop] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                col = order[at]
                ok = np.bitwise_count(prints[row] ^ items[col]) <= self.radius
                yield row[ok], col[ok]
                start = stop

    def search(self, texts: pa.Array, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): for each text and item the best window."""
        steps = {size: step_of(size) for size in self.sizes}
        for a, b in slices(texts):
            hashes, starts = shingles(texts[a:b])
            hits: dict[tuple[int, int], set[tuple[int, int]]] = {}
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for size, text, place, prints in windows(hashes, starts, steps):
                item_of = self.sizes[size][0]
                for row, col in self._near(size, prints):
                    for t, i, at in set(zip(text[row].tolist(), item_of[col].tolist(), place[row].tolist())):
                        hits.setdefault((t, i), set()).add((at + size - int(self.lengths[i]), at))
                if len(hits) > SEEN:
                    self._verify(hits, hashes, starts, least, best)
            self._verify(hits, hashes, starts, least, best)
            for (t, i), (value, first) in sorted(best.items()):
                yield a + t, i, -first, int(self.lengths[i]) + SHINGLE - 1, value
            if self.short:
                for t, i, first, words in self._whole(texts[a:b]):
                    yield a + t, i, first, words, 1.0

    def _verify(self, hits: dict, hashes: np.ndarray, starts: np.ndarray, least: float, best: dict) -> None:
        """Put the best window of each hit text and item into ``best`` if it is similar enough; empties ``hits``.

        Of every hit all item-sized windows that hold it are compared, from its first place to its last.
        """
        for (t, i), places in hits.items():
            own = hashes[starts[t] : starts[t + 1]].tolist()
            last = max(0, len(own) - int(self.lengths[i]))
            done = -1
            for lo, hi in sorted(places):
                lo, hi = max(done + 1, min(max(lo, 0), last)), min(max(hi, 0), last)
                if lo <= hi:
                    done = hi
                    value, first = self._similarity(i, own, lo, hi)
                    if value >= least and (value, -first) > best.get((t, i), (0.0, 0)):
                        best[t, i] = value, -first
        hits.clear()

    def _similarity(self, i: int, own: list[int], lo: int, hi: int) -> tuple[float, int]:
        """The greatest weighted share of item ``i``'s shingles in a window of its size that begins from ``lo`` to ``hi``, and the first such place."""
        n, weights, counts = int(self.lengths[i]), self.weights[i], self.counts[i]
        held = Counter(h for h in own[lo : lo + n] if h in counts)
        shared = sum(weights[h] * min(c, counts[h]) for h, c in held.items())
        top, first = shared, lo
        for at in range(lo + 1, hi + 1):
            gone, come = own[at - 1], own[at + n - 1]
            if gone in counts:
                shared -= weights[gone] * (held[gone] <= counts[gone])
                held[gone] -= 1
            if come in counts:
                shared += weights[come] * (held[come] < counts[come])
                held[come] += 1
            if shared > top + 1e-9:
                top, first = shared, at
        whole = Counter(h for h in own[first : first + n] if h in counts)  # without the rounding of many steps
        return sum(weights[h] * min(c, counts[h]) for h, c in whole.items()) / self.totals[i], first


def _held_shingles(rows: DataFrame) -> DataFrame:
    """``h`` (signed long): each item's shingles, once an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(0))
            for a, b in slices(texts):
                hashes, starts = shingles(texts[a:b])
                own = [np.unique(hashes[x:y]) for x, y in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["h"])

    return rows.select("text").mapInArrow(run, "h long")


def _blocks(items: DataFrame, item: str, text: str, size: int) -> Iterator[Index]:
    """Indexes over all items, about ``size`` or ``BLOCK_BYTES`` at a time; shingles are counted over the whole table."""
    rows = items.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    count, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-count // size), -(-held // BLOCK_BYTES))
    shared = cut(_held_shingles(rows).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")) if blocks > 1 else None
    for k in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        part = own.orderBy("id", "text").collect()
        if part:
            df = None
            if shared is not None:  # of the block's shingles, those that several items hold
                df = {h % (1 << 64): n for h, n in shared.join(_held_shingles(own).distinct(), "h", "left_semi").collect()}
            yield Index([r["id"] for r in part], [r["text"] for r in part], df)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item of which it holds a passage.

    ``similarity`` is the weighted share of the item's 5-word shingles in the best
    item-sized window, of at least the given value; ``start`` and ``words`` are the
    window's place in words (runs of letters and digits, lower-cased). Shingles that more
    items of the whole table hold weigh less, whatever ``block`` is. An item of fewer than
    five words has no shingle: it is found where all its words stand in a row, with
    similarity 1, at the first place. Null and wordless texts match nothing. Items are a
    stated query set: each block of a bounded number and size is sent to all executors and
    held against all documents in a pass of its own. Texts are read whole; one longer than
    a slice is a slice of its own. Repeated documents and items each give their rows. Other
    columns are not read.
    """
    if similarity < 0.8:
        raise ValueError("the windows find similarities of 0.8 or more")
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, start long, words long"
    out = None
    for index in _blocks(items, item, item_text, block):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(sent.value.search(text_array(batch.column(1)), similarity))
                rows, own, first, n, value = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "item_id": pa.array([sent.value.ids[k] for k in own], pa.int64()), "similarity": pa.array(value, pa.float64()), "start": pa.array(first, pa.int64()), "words": pa.array(n, pa.int64())})

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that hold no passage of any item, all columns, without a shuffle."""
    for index in _blocks(items, item, item_text, block):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def verdict(texts: pa.Array, sent=sent) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[row for row, *_ in sent.value.search(texts, similarity)]] = False
            return keep

        docs = keep_rows(docs, text, verdict)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
