"""Quality rules by repetition inside a text, found with a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import keep_rows, slices, split_words, strings, table, text_array, word_codes

#: Words of the shortest repeat that counts, the largest share of words in such repeats,
#: and the words of the longest repeat that a kept text may hold.
MIN_WORDS, MAX_FRACTION, MAX_LONGEST = 12, 0.2, 64
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_SPACE_OR_TAIL = _SPACE + bytes(range(0x80, 0xC0))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_fraction double, longest_repeat long, repeats array<struct<start:long,stop:long>>, base_failed boolean, kept boolean"


def longest_repeats(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run that begins there and occurs again in its text.

    ``starts`` separates the texts. The suffix arrays of all texts are built together by
    prefix doubling, sorting only suffixes that still share their prefix; common prefixes
    of neighbours come from the ranks of each round. A suffix's longest repeat is the
    deepest LCP interval that holds it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.diff(starts)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(starts[1:], lengths)
    key = text * (int(codes.max()) + 1) + codes
    suffixes = np.argsort(key, kind="stable")
    key = key[suffixes]
    begins = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int32)
    rank[suffixes] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rounds, step = [rank], 1
    while True:
        alone = begins & np.concatenate([begins[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        i = suffixes[slots]
        behind = np.minimum(i + step, n - 1)
        key = rank[i].astype(np.int64) * (n + 1) + np.where(i + step < end[i], rank[behind].astype(np.int64) + 1, 0)
        order = np.argsort(key, kind="stable")
        i, key = i[order], key[order]
        suffixes[slots] = i
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        begins[slots] = fresh
        rank = rank.copy()
        rank[i] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rounds.append(rank)
        step *= 2
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(rounds[0][a] == rounds[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (rounds[k][np.minimum(x, n - 1)] == rounds[k][np.minimum(y, n - 1)])
        common[equal] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``min_words``."""
    at = np.flatnonzero(longest >= min_words)
    at = at[(at == 0) | (longest[at - 1] != longest[at] + 1)]  # others lie inside the repeat that begins a word earlier
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _measure(texts: pa.Array, min_words: int, max_fraction: float, max_longest: int) -> Iterator[dict]:
    for a, b in slices(texts):
        part = texts[a:b]
        words, starts = split_words(part)
        codes, _ = word_codes(words)
        n = np.diff(starts)
        longest = longest_repeats(codes, starts)
        spans = covered(longest, min_words)
        most = np.zeros(len(n), np.int64)
        most[n > 0] = np.maximum.reduceat(longest, starts[:-1][n > 0]) if len(longest) else 0
        raw = strings(part.cast(pa.binary()))
        short = _sums(covered(longest, 3), starts)
        fraction = _sums(spans, starts) / np.maximum(n, 1)
        failed = (n < 50) | (100 * short > 50 * n)
        # runs of covered words, none across two texts
        edge = np.zeros(len(spans) + 1, bool)
        edge[starts] = True
        first = np.flatnonzero(spans & (edge[:-1] | ~np.concatenate([[False], spans[:-1]])))
        last = np.flatnonzero(spans & (edge[1:] | ~np.concatenate([spans[1:], [False]]))) + 1
        owner = np.searchsorted(starts, first, "right") - 1
        counts = np.bincount(owner, minlength=len(n)) if len(first) else np.zeros(len(n), np.int64)
        base = starts[owner] if len(first) else first
        yield {
            "n_words": n,
            "word_chars": np.array([len(x.translate(None, _SPACE_OR_TAIL)) for x in raw], np.int64),
            "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in raw], np.int64),
            "n_dup_lines": np.array([_lines(x) for x in raw], np.int64),
            "n_repeat_words": short,
            "repeat_fraction": fraction,
            "longest_repeat": np.where(most >= min_words, most, 0),
            "repeats": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "stop"])),
            "base_failed": failed,
            "kept": ~failed & (fraction <= max_fraction) & (most <= max_longest),
        }


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Repetition measures and the verdict of each document's whole text.

    ``repeats`` are the united spans, in words, of all maximal repeats of at least
    ``min_words``; ``repeat_fraction`` is the share of words in them, ``longest_repeat``
    the longest (0 if none). A text is kept if it has 50 words or more, no more than half
    of its words in repeated 3-word windows, no more than ``max_fraction`` in repeats, and
    no repeat of more than ``max_longest`` words. A null or empty text has no words and is
    not kept. Rows stay apart, whatever their id; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in _measure(text_array(batch.column(1)), min_words, max_fraction, max_longest):
                n = len(found["n_words"])
                values = [v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], *values], ["doc_id", *found])
                at += n

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that the rules keep, all columns, without a shuffle."""
    return keep_rows(docs, text, lambda texts: np.concatenate([np.zeros(0, bool), *(m["kept"] for m in _measure(texts, min_words, max_fraction, max_longest))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).drop("repeats", "longest_repeat")


def _doubled(size: int) -> str:
    """SQL that ranks the windows of 2 * size words by the ranks of their halves."""
    return f"""
r{2 * size} AS (
  SELECT doc_id, i, dense_rank() OVER (ORDER BY doc_id, a, b) AS g FROM (
    SELECT doc_id, i, g AS a, lead(g, {size}) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r{size}) WHERE b IS NOT NULL),"""


#: The same rules without a suffix array: a word lies in a repeat of m words or more if a window of m words around it occurs twice.
SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
r1 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY doc_id, word) AS g FROM pos),"""
    + "".join(map(_doubled, (1, 2, 4, 8, 16, 32)))
    + r"""
win AS (
  SELECT doc_id, i, m, count(*) OVER (PARTITION BY doc_id, m, a, b) AS c FROM (
    SELECT x.doc_id, x.i, 3 AS m, x.g AS a, y.g AS b FROM r2 x JOIN r1 y ON x.doc_id = y.doc_id AND y.i = x.i + 2
    UNION ALL
    SELECT x.doc_id, x.i, 12, x.g, y.g FROM r8 x JOIN r4 y ON x.doc_id = y.doc_id AND y.i = x.i + 8
    UNION ALL
    SELECT x.doc_id, x.i, 65, x.g, y.g FROM r64 x JOIN r1 y ON x.doc_id = y.doc_id AND y.i = x.i + 64)),
cov AS (
  SELECT doc_id, m, count(DISTINCT i + k) AS words
  FROM win, range(0, 65) AS r(k) WHERE c > 1 AND k < m GROUP BY doc_id, m),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c3.words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(c12.words, 0) AS covered, c65.words IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (doc_id)
  LEFT JOIN (SELECT * FROM cov WHERE m = 3) c3 USING (doc_id)
  LEFT JOIN (SELECT * FROM cov WHERE m = 12) c12 USING (doc_id)
  LEFT JOIN (SELECT * FROM cov WHERE m = 65) c65 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       covered / greatest(n_words, 1) AS repeat_fraction,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered / greatest(n_words, 1) <= 0.2 AND NOT too_long AS kept
FROM base
"""
)
