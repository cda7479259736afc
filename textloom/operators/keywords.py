"""Many keywords against many texts: an automaton over distinct tokens, then keys of token and text.

A keyword's words lie within tokens, so the automaton runs once for each distinct token and
not for each text or rule. A phrase is looked at only in texts that hold its rarest word, and
then all its words; those whose words aren't near each other are found in a text by a second
automaton, once for all. The time follows the text and what it holds, not the number of rules.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.operators.matching import cleaned, indicator_rows

#: Distinct keywords that are sent to all executors at most, of some 1,000 bytes each in every Python worker.
MAX_KEYWORDS = 1_000_000
#: Distinct tokens whose words a task keeps, texts that it matches at a time, and tasks for each core.
MAX_TOKENS, TEXTS, TASKS = 500_000, 500, 4
#: Places of texts times words up to which a table says which text holds which word.
DENSE = 32 << 20
#: The rule pack that a Python worker has prepared, kept from task to task.
_PREPARED: dict[str, Matcher] = {}
SPACE = "[ \t\n\r\f\x0b]+"


def _ragged(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of lists (``starts``, one entry more) the places of all items of ``rows``, and which row each is of."""
    n = starts[rows + 1] - starts[rows]
    own = np.repeat(np.arange(len(rows)), n)
    return np.repeat(starts[rows], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), own


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and each once; for integers sorting is faster than ``np.unique``, which hashes them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are among the sorted ``known``."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), bool)


class Matcher:
    """Keywords prepared for matching. ``span``: tokens within which a phrase's words may be apart."""

    def __init__(self, keywords: list[str], span: int):
        import ahocorasick

        self.keywords, self.span = keywords, span
        exact = [re.split(" +", k) for k in keywords]
        parts = [sorted({p for p in re.split(SPACE, k) if p}) for k in keywords]
        names = sorted({p for own in parts for p in own})
        number = {p: k for k, p in enumerate(names)}
        self.words, self.number = len(names), number
        self.automaton = ahocorasick.Automaton()
        for p, k in number.items():
            self.automaton.add_word(p, k)
        if names:
            self.automaton.make_automaton()
        #: keywords that fire wherever their one word occurs; those without a word fire in every text
        self.always = np.array([k for k, own in enumerate(parts) if not own and not keywords[k]], np.int64)
        single = [(number[keywords[k]], k) for k, own in enumerate(parts) if own == [keywords[k]]]
        self.single = np.full(self.words + 1, -1, np.int64)
        for word, k in single:
            self.single[word] = k
        done = {k for _, k in single} | set(self.always.tolist())
        self.phrases = np.array([k for k in range(len(keywords)) if k not in done], np.int64)
        lists = [np.array([number[p] for p in parts[k]], np.int64) for k in self.phrases]
        #: words of a phrase; ``odd``: it holds other white space than spaces, so that its words aren't tokens' parts
        self.exact = [exact[k] for k in self.phrases]
        self.odd = np.array([sorted({w for w in self.exact[r] if w}) != parts[k] for r, k in enumerate(self.phrases)], bool)
        self.apart = np.array([len(w) > 1 for w in self.exact], bool)
        self.part_at = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        self.part = np.concatenate([np.zeros(0, np.int64), *lists])
        often = np.bincount(self.part, minlength=self.words + 1)
        self.whole = ahocorasick.Automaton()
        for r, k in enumerate(self.phrases.tolist()):
            self.whole.add_word(keywords[k], r)
        if len(self.phrases):
            self.whole.make_automaton()
        self.bare = np.array([r for r, x in enumerate(lists) if not len(x)], np.int64)
        anchor = np.array([x[np.argmin(often[x])] if len(x) else self.words for x in lists], np.int64)
        self.anchored = np.argsort(anchor, kind="stable")
        self.anchor_at = np.searchsorted(anchor[self.anchored], np.arange(self.words + 2))
        self.tokens: dict[str, np.ndarray] = {}

    def _words(self, tokens: list[str]) -> list[np.ndarray]:
        """The words that each token holds. New tokens go through the automaton as one text, since no word has a space."""
        new = [t for t in tokens if t not in self.tokens]
        if len(self.tokens) + len(new) > MAX_TOKENS:
            self.tokens.clear()
            new = tokens
        if new:
            hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(" ".join(new))), np.int64).reshape(-1, 2) if self.words else np.zeros((0, 2), np.int64)
            ends = np.cumsum([len(t) + 1 for t in new])
            words = max(1, self.words)
            pairs = _distinct(np.searchsorted(ends, hits[:, 0], "right") * words + hits[:, 1])
            at = np.searchsorted(pairs, np.arange(len(new) + 1) * words).tolist()
            held = pairs % words
            for k, t in enumerate(new):
                self.tokens[t] = held[at[k] : at[k + 1]].copy()
        return [self.tokens[t] for t in tokens]

    def match(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and of the keywords that fire in them, each pair once; texts are cleaned and not null."""
        lists = pc.split_pattern_regex(texts, SPACE)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = coded.dictionary.to_pylist()
        n_tokens, n = max(1, len(tokens)), len(texts)
        row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        found = self._words(tokens)
        starts = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
        held = np.concatenate([np.zeros(0, np.int64), *found])
        empty = np.array([not t for t in tokens], bool)
        # the texts' distinct tokens, and their first and last places without empty ones
        full = ~empty[codes] if len(codes) else np.zeros(0, bool)
        row, codes = row[full], codes[full]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        key = row * n_tokens + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        first, last, key = order[new], order[np.append(new, len(key))[1:] - 1], key[new]
        low, high = place[first], place[last]
        at, own = _ragged(starts, key % n_tokens)
        words = max(1, self.words)
        pairs, dense = (key // n_tokens)[own] * words + held[at], None  # text and word
        if n * words <= DENSE:
            dense = np.zeros(n * words, bool)
            dense[pairs] = True
        pairs = _distinct(pairs) if dense is None else np.flatnonzero(dense)
        text_of, word_of = pairs // words, pairs % words
        single = self.single[word_of]
        out_text, out_key = [text_of[single >= 0]], [single[single >= 0]]
        out_text.append(np.repeat(np.arange(n), len(self.always)))
        out_key.append(np.tile(self.always, n))
        # phrases of which a text holds the rarest word, then all words
        at, own = _ragged(self.anchor_at, word_of)
        text, phrase = np.append(text_of[own], np.repeat(np.arange(n), len(self.bare))), np.append(self.anchored[at], np.tile(self.bare, n))
        at, own = _ragged(self.part_at, phrase)
        asked = text[own] * words + self.part[at]
        there = _among(asked, pairs) if dense is None else dense[asked]
        ok = np.bincount(own[~there], minlength=len(phrase)) == 0
        text, phrase = text[ok], phrase[ok]
        # how far apart the tokens lie that equal a word of the phrase
        token_of = np.full(words + 1, -1, np.int64)
        for k, t in enumerate(tokens):
            word = self.number.get(t)
            if word is not None:
                token_of[word] = k
        at, own = _ragged(self.part_at, phrase)
        token = token_of[self.part[at]]
        where = np.searchsorted(key, text[own] * n_tokens + token)
        equal = (token >= 0) & (where < len(key))
        equal[equal] = key[where[equal]] == (text[own] * n_tokens + token)[equal]
        begin, end = np.full(len(phrase), np.iinfo(np.int64).max), np.full(len(phrase), -1)
        np.minimum.at(begin, own[equal], low[where[equal]])
        np.maximum.at(end, own[equal], high[where[equal]])
        close = self.apart[phrase] & ~self.odd[phrase] & (end >= 0) & (end - begin < self.span)
        rest = np.flatnonzero(~close)
        if len(rest):
            # the others fire only as part of the text; each text goes through the automaton of phrases once
            some, wanted = _distinct(text[rest]).tolist(), max(1, len(self.phrases))
            plain = texts.to_pylist()
            parts = [np.array([r for _, r in self.whole.iter(plain[t])], np.int64) + t * wanted for t in some]
            close[rest] = _among(text[rest] * wanted + phrase[rest], _distinct(np.concatenate(parts)))
            for k in rest[~close[rest] & self.odd[phrase[rest]] & self.apart[phrase[rest]]].tolist():
                r, own_text = phrase[k], plain[text[k]]
                if all(w in own_text for w in self.exact[r]):
                    split = [t for t in re.split(SPACE, own_text) if t]
                    places = [p for p, t in enumerate(split) if t in self.exact[r]]
                    close[k] = bool(places) and max(places) - min(places) < self.span
        out_text.append(text[close])
        out_key.append(self.phrases[phrase[close]])
        return np.concatenate(out_text), np.concatenate(out_key)


def keyword_hits(texts: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", span: int = 20, most: int = MAX_KEYWORDS) -> DataFrame:
    """``keys``, ``keyword``: the lower-cased keywords that fire in each text, once for each text and keyword.

    A keyword fires as part of the cleaned text, a phrase (words with spaces between) also where it holds all
    its words and the tokens equal to any of them lie within ``span``. Keywords are a rule pack, of ``most`` at
    most (else an error), and sent to all executors; texts are whole, and dealt out evenly
    where they come from fewer files than there are cores; null ones have no hits. An empty keyword fires in every text.
    """
    own = rules.select(F.lower("keyword").alias("keyword")).filter("keyword IS NOT NULL").distinct().limit(most + 1).toArrow().column("keyword").to_pylist()
    if len(own) > most:
        raise ValueError(f"more than {most} keywords")
    sent = texts.sparkSession.sparkContext.broadcast(sorted(own))
    name = uuid.uuid4().hex
    schema = StructType([*(texts.schema[k] for k in keys), StructField("keyword", StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _PREPARED:
            _PREPARED.clear()
            _PREPARED[name] = Matcher(sent.value, span)
        matcher = _PREPARED[name]
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                row, keyword = matcher.match(some.column(len(keys)))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(row) for k in range(len(keys))), known.take(pa.array(keyword))], names)

    prepared = texts.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if len(texts.inputFiles()) < cores:  # a file may be one row group, which one task reads
        prepared = prepared.repartition(TASKS * cores)
    prepared = prepared.select(*keys, cleaned("_text").alias("_clean"))
    return prepared.mapInArrow(run, schema)


def many_indicators(texts: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", span: int = 20, service: str = "general") -> DataFrame:
    """``matching.indicators`` for rule packs of any size up to ``MAX_KEYWORDS``: same rows. Rules that share a keyword fire together."""
    hits = keyword_hits(texts, rules, keys, text, span)
    own = rules.withColumn("_keyword", F.lower("keyword"))
    return indicator_rows(hits.join(own, F.col("_keyword") == hits["keyword"]).drop(hits["keyword"]), keys, service)
