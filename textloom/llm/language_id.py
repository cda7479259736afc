"""Language identification by words, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import SLICE_BYTES, keep_rows, slices, strings, table, text_array

#: Bounds of the fit: labelled documents, and words and n-grams of each length for each language.
MAX_DOCS, MAX_WORDS, MAX_GRAMS, MAX_N = 20_000, 20_000, 5_000, 4
#: More languages than this are taken for a mistake (another column), and are an error.
MOST_LANGS = 5_000
UNKNOWN = "und"
#: Bits of a code point.
POINT = 21


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased runs of letters (Unicode class L), the number of each run's word, and its text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    own = full[codes] if len(codes) else np.zeros(0, bool)
    number = np.cumsum(full) - 1
    return coded.dictionary.filter(pa.array(full)), number[codes[own]], owner[own]


class Points:
    """Code points of words, each word between two blanks, and the n-grams in them."""

    def __init__(self, words: list[str]):
        joined = "".join(f" {w} " for w in words)
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.lengths = np.array([len(w) + 2 for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of every n-gram, and its word."""
        count = np.maximum(self.lengths - n + 1, 0)
        word = np.repeat(np.arange(len(count)), count)
        return np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + self.starts[word], word

    def key(self, at: np.ndarray, n: int) -> np.ndarray:
        """``n`` code points, at most three, as one integer."""
        out = self.points[at]
        for k in range(1, n):
            out = out << POINT | self.points[at + k]
        return out


def _find(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each value in sorted ``among``, -1 for none."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


class Grams:
    """The known n-grams of one length: exact keys in order, and a row of values for each."""

    def __init__(self, n: int, known: dict[str, np.ndarray], width: int):
        self.n = n
        points = [np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.int64) for g in known]
        codes = np.stack(points) if points else np.zeros((0, n), np.int64)
        halves = [codes[:, : n // 2], codes[:, n // 2 :]]
        whole = [sum((h[:, k] << POINT * (h.shape[1] - 1 - k) for k in range(h.shape[1])), np.zeros(len(codes), np.int64)) for h in halves]
        #: the first and the second halves that occur; a key is a pair of their numbers
        self.halves = [np.unique(w) for w in whole]
        key = _find(whole[0], self.halves[0]) * len(self.halves[1]) + _find(whole[1], self.halves[1])
        order = np.argsort(key)
        self.keys = key[order]
        self.values = np.stack([known[g] for g in known])[order] if points else np.zeros((0, width), np.float32)

    def rows(self, text: Points, at: np.ndarray) -> np.ndarray:
        """The row of values of each n-gram, -1 where it is unknown."""
        first = self.n // 2
        a = _find(text.key(at, first), self.halves[0]) if first else np.zeros(len(at), np.int64)
        b = _find(text.key(at + first, self.n - first), self.halves[1])
        return np.where((a < 0) | (b < 0), -1, _find(a * len(self.halves[1]) + b, self.keys))


class Model:
    """Negative log frequencies of words and n-grams, one column for each language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        """``rows``: language, length (0 for words), word or n-gram, count."""
        self.langs = sorted({r[0] for r in rows})
        column = {lang: k for k, lang in enumerate(self.langs)}
        totals: Counter = Counter()
        for lang, n, _, count in rows:
            totals[lang, n] += count
        self.penalty = max((math.log(t) for t in totals.values()), default=0.0) + 1
        tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(MAX_N + 1)}
        for lang, n, gram, count in rows:
            values = tables[n].setdefault(gram, np.full(len(self.langs), self.penalty, np.float32))
            values[column[lang]] = math.log(totals[lang, n] / count)
        self.words = pa.array(list(tables[0]), pa.string())
        self.word_values = np.stack(list(tables[0].values())) if tables[0] else np.zeros((0, len(self.langs)), np.float32)
        self.grams = [Grams(n, tables[n], len(self.langs)) for n in range(MAX_N, 0, -1)]

    def values(self, words: pa.Array) -> np.ndarray:
        """A row for each word: a known word's values, else the mean of its known n-grams of the greatest length that has any."""
        out = np.full((len(words), len(self.langs)), self.penalty, np.float32)
        row = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        out[row >= 0] = self.word_values[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for known in self.grams:
            if not len(left):
                break
            text = Points(strings(words.take(pa.array(left))))
            at, word = text.grams(known.n)
            hit = known.rows(text, at)
            word, hit = word[hit >= 0], hit[hit >= 0]
            number = np.bincount(word, minlength=len(left))
            some = number > 0
            for k in range(len(self.langs)):
                out[left[some], k] = (np.bincount(word, known.values[hit, k], len(left)) / np.maximum(number, 1))[some]
            left = left[~some]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language number of each text (-1: none) and the posterior of it."""
        lang, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        for a, b in slices(texts, max(1 << 14, SLICE_BYTES * 16 // max(16, len(self.langs)))):
            words, codes, owner = words_of(texts[a:b])
            values = self.values(words)
            cost = np.stack([np.bincount(owner, values[codes, k], b - a) for k in range(len(self.langs))], axis=1)
            some = np.bincount(owner, minlength=b - a) > 0
            odds = np.exp(np.maximum(cost.min(axis=1, keepdims=True) - cost, -700)).sum(axis=1)
            lang[a:b] = np.where(some, cost.argmin(axis=1), -1)
            score[a:b] = np.where(some, 1 / odds, 0.0)
        return lang, score


def _numbered(values: np.ndarray) -> np.ndarray:
    """The number of each value among the distinct ones, in order of first sight."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def counted(words: list[str], counts: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of words that occur ``counts`` times, and how often each occurs."""
    text = Points(words)
    at, word = text.grams(n)
    if not len(at):
        return [], np.zeros(0, np.int64)
    first = n // 2
    a = _numbered(text.key(at, first)) if first else np.zeros(len(at), np.int64)
    b = _numbered(text.key(at + first, n - first))
    same = _numbered(a * (b.max() + 1) + b)
    one = np.empty(same.max() + 1, np.int64)
    one[same[::-1]] = np.arange(len(same))[::-1]
    points = text.points[at[one][:, None] + np.arange(n)].astype(np.uint32)
    whole = points.tobytes().decode("utf-32-le")
    return [whole[k : k + n] for k in range(0, len(whole), n)], np.bincount(same, counts[word]).astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS, max_words: int | None = MAX_WORDS, max_grams: int | None = MAX_GRAMS) -> Model:
    """Count words and n-grams in a bounded sample of labelled documents.

    Of each language about ``max_docs`` / languages documents are drawn by a hash of
    their key, or all if there are fewer; every language is learned, and over
    ``MOST_LANGS`` of them are an error. Executors count, Spark sums, and the most frequent
    ``max_words`` words and ``max_grams`` n-grams of each length and language come to the
    driver: a fixed number, or with None all that the sample holds. Rows without text or
    language are left out.
    """
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages in {lang}")
    if not sizes:
        return Model([])
    each = max(1, max_docs // len(sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, each / r["count"]))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = text_array(batch.column(0)), batch.column(1).dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False)
            for a, b in slices(texts, 4 * SLICE_BYTES):
                words, codes, owner = words_of(texts[a:b])
                for k in np.unique(number[a:b]):
                    times = np.bincount(codes[number[a:b][owner] == k], minlength=len(words))
                    own = strings(words.filter(pa.array(times > 0)))
                    times = times[times > 0]
                    for n in range(MAX_N + 1):
                        grams, c = counted(own, times, n) if n else (own, times)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([langs.dictionary[k].as_py()] * len(grams), pa.string()), "n": pa.array([n] * len(grams), pa.int32()), "gram": pa.array(grams, pa.string()), "c": pa.array(c, pa.int64())})

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    if max_words is not None or max_grams is not None:
        place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
        most = F.when(F.col("n") == 0, F.lit(max_words).cast("int")).otherwise(F.lit(max_grams).cast("int"))
        counts = counts.withColumn("place", place).filter(most.isNull() | (F.col("place") <= most))
    got = counts.select("lang", "n", "gram", "c").toArrow()
    return Model(sorted(zip(*(got.column(k).to_pylist() for k in range(4)))))


def remainder(key: str, of: int) -> Column:
    """crc32 of a key as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of each whole text.

    The score is the language's share of the likelihood of all. Letters are Unicode's class
    L: a text of digits, fractions, circled numbers or marks alone, an empty or null one,
    and any text under a model of no language give ``und`` with score 0; equal likelihoods
    give the first language in order. Texts are read whole, in slices of about a megabyte;
    a longer one is a slice of its own. Repeated ids and null ids keep their rows; columns
    other than key and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*sent.value.langs, UNKNOWN]
        for batch in batches:
            lang, score = sent.value.predict(text_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in lang], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> tuple[DataFrame, Model]:
    model = fit(docs.filter(remainder("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"), model


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose text is in a learned language with at least ``min_score``, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(remainder("doc_id", 4) != 2)))

    def verdict(texts: pa.Array) -> np.ndarray:
        lang, score = sent.value.predict(texts)
        return (lang >= 0) & (score >= min_score)

    return keep_rows(docs, "text", verdict)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(table(spark, sf_dir, "documents"))[0]
