"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, slices, strings, table, text_array
from textloom.llm.language_id import remainder
from textloom.llm.quality import one_label

#: Bounds of the fit: labelled documents of each class, and the hashed features.
MAX_EACH, BITS, EPOCHS = 4_000, 20, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
#: Word prefixes that count as words too, so that inflected forms share weights.
STEMS = (4, 6)
_ODD = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: first and last row, the hashed features, and each one's row from the first.

    Features are lower-cased words (runs of letters and digits), their prefixes, pairs of
    neighbours, and pairs with one word between.
    """
    shift = np.uint64(64 - bits)
    for a, b in slices(texts):
        lists = pc.split_pattern_regex(pc.utf8_lower(texts[a:b]), r"[^\p{L}\p{N}]+")
        coded = pc.list_flatten(lists).dictionary_encode()
        words = strings(coded.dictionary)
        digest = xxhash.xxh64_intdigest
        table_ = np.array([[digest(w, 1), *(digest(w[:n], n) if len(w) > n else 0 for n in STEMS)] for w in words], np.uint64).reshape(len(words), 1 + len(STEMS))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        full = np.array([bool(w) for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
        row = np.repeat(np.arange(b - a), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))[full]
        own = table_[codes[full]]
        word = own[:, 0]
        parts, rows = [word], [row]
        for k in range(len(STEMS)):
            has = own[:, k + 1] != 0
            parts.append(own[has, k + 1])
            rows.append(row[has])
        for gap in (1, 2):
            same = row[gap:] == row[:-gap]
            parts.append(_mix(word[:-gap] * np.uint64(_ODD) + word[gap:] + np.uint64(gap))[same])
            rows.append(row[gap:][same])
        yield a, b, (_mix(np.concatenate(parts)) >> shift).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """Weights with a rate of their own for each coordinate; L1 leaves most of them zero."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One step on an example whose distinct features ``at`` are 1."""
        w = self.weights(at)
        gradient = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] = n + gradient * gradient


class Model:
    """Nonzero weights by feature; the last one is the bias."""

    def __init__(self, weights: np.ndarray, bits: int, default: float):
        self.bits = bits
        self.at = np.flatnonzero(weights[:-1])
        self.values = weights[self.at]
        self.bias = default if not len(self.at) else float(weights[-1])

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.values
        for a, b, found, row in features(texts, self.bits):
            hit = dense[found] != 0
            pairs = np.unique(row[hit] << self.bits | found[hit])  # a feature counts once in a text
            out[a:b] += np.bincount(pairs >> self.bits, dense[pairs & ((1 << self.bits) - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_each: int = MAX_EACH, bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on at most about ``max_each`` documents of each class, drawn by a hash of their key.

    The draw, a bounded table, is sent to where the documents are, so that no text is
    shuffled; executors hash its texts. A feature moves its weight by less than 1 for each
    document and epoch, so that one held by L1 / ``epochs`` documents or fewer keeps a weight
    of exactly 0: Spark counts them, and only the others come to the driver, with the same
    weights as all would give. Rows without a 0/1 label are left out, and a key that has
    several labels counts once, as 1 if any is. With one class, or none, scores are that
    class's rate (a half if none).
    """
    known = one_label(labels, key, label)
    sizes = dict(known.groupBy("label").count().collect())
    share = F.when(F.col("label") == 1, min(1.0, max_each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_each / max(1, sizes.get(0, 0))))
    picked = known.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    drawn = own.join(F.broadcast(picked), "key").select("key", "text", "label")  # about 2 * max_each rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, row in features(text_array(batch.column(1)), bits):
                pairs = np.unique(row << bits | found)
                starts = np.searchsorted(pairs >> bits, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], lists], ["key", "label", "found"])

    weights = np.zeros((1 << bits) + 1)
    total = sum(sizes.values())
    rate = (sizes.get(1, 0) + 0.5) / (total + 1)
    if len(sizes) < 2:
        return Model(weights, bits, math.log(rate / (1 - rate)))
    hashed = cut(drawn.mapInArrow(run, "key long, label int, found array<int>"))
    common = hashed.select(F.explode("found").alias("f")).groupBy("f").count().filter(F.col("count") > L1 / epochs).select("f").toArrow()
    useful = np.zeros(1 << bits, bool)  # a bit for each of at most 2^bits features
    useful[common.column("f").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(useful))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            ok = known[values]
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[ok], minlength=len(n)))
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[ok], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["key", "label", "found"])

    got = hashed.mapInArrow(keep, hashed.schema).toArrow()
    labels, keys = got.column("label").to_numpy(), got.column("key").fill_null(0).to_numpy()
    lists = got.column("found").combine_chunks()
    values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.lexsort((keys, _mix(keys.astype(np.uint64) * np.uint64(_ODD))))
    learner = Ftrl(len(weights))
    for _ in range(epochs):
        for k in order:
            learner.learn(np.append(values[starts[k] : starts[k + 1]], len(weights) - 1), float(labels[k]))
    weights = learner.weights(slice(None))
    # the draw's classes are not as frequent as all labels' are: put the bias right
    drawn_rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weights[-1] += math.log(rate / (1 - rate)) - math.log(drawn_rate / (1 - drawn_rate))
    return Model(weights, bits, 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` of each whole text. A null or empty text, having no features, gets the bias alone.

    Rows stay apart, whatever their id, null ones too; texts are read whole, in slices of
    about a megabyte or one text; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(text_array(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(remainder("doc_id", 5) != 0)
    model = fit(docs, known)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
