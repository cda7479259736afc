"""Token ids of whole texts, each distinct piece of text encoded once.

A pre-tokenizer that never joins text across a space lets a text be encoded space by
space: equal pieces have equal ids. Pieces repeat a lot, so a worker keeps their ids.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from textloom.llm.common import held, split_words, strings

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces whose ids a worker keeps, and bytes of text encoded at a time. Beyond the first, pieces that have come once are let go.
CACHE, SLICE = 900_000, 16 << 20
BLOCK = 1 << 15
#: Words that are encoded in one text, and what stands before a piece that has no space before it.
TOGETHER, HEAD = 256, "\0"
TAILS = (",", ".", "\n")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file (a vocabulary, its size fixed), sent to the executors once."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return spark.sparkContext.broadcast((hashlib.sha1(source.encode()).hexdigest(), source))


class Encoder:
    """``boundary``: "space" if pieces begin at single spaces and keep them (byte-level BPE),
    "word" if white space is dropped, "text" if texts can't be split. ``lower``: the tokenizer ignores A-Z's case.
    ``plain``: strings of special tokens in a text are ordinary text; else they are these tokens, as the library has it.
    ``lead``: a space goes before every text (boundary "space" only).

    Pieces that begin a text stand in ``rows`` with ``HEAD`` before them, others by themselves.
    """

    def __init__(self, source: str, boundary: str, lower: bool = False, cache: int = CACHE, plain: bool = False, lead: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = plain
        self.boundary, self.lower, self.cache, self.lead = boundary, lower, cache, lead
        #: between words that are encoded together; a single token that letters never give
        self.mark = "\n" if boundary == "space" else " | "
        own = self._ids([self.mark])[0]
        self.mark_id = int(own[0]) if len(own) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        #: in how many batches of texts each piece has come
        self.used = np.empty(0, np.int32)

    def _trim(self) -> None:
        """Keep what has come more than once, half of the cache at most, the most frequent first."""
        names = np.array(list(self.rows), object)  # in the order of their rows
        kept = np.flatnonzero(self.used > 1)
        kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: self.cache // 2]])
        flat, size, used = self._gather(kept), self.size[kept], self.used[kept]
        self._reset()
        self._store(names[kept].tolist(), flat, size)
        self.used = used // 2

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, piece: str) -> str:
        if piece[:1] == HEAD:
            return piece[1:]
        return " " + piece if self.boundary == "space" else piece

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces of letters, many encoded at once between marks."""
        texts = [self.mark.join([self._text(p) for p in pieces[k : k + TOGETHER]]) + self.mark for k in range(0, len(pieces), TOGETHER)]
        ids = np.concatenate(self._ids(texts))
        marks = ids == self.mark_id
        ends = np.flatnonzero(marks)
        if len(ends) != len(pieces):
            return self._singly(pieces)
        return ids[~marks], np.diff(np.concatenate([[-1], ends])) - 1

    def _singly(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids([self._text(p) for p in pieces])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _store(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.rows)
        self.rows.update(zip(pieces, range(first, first + len(pieces))))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int32)])

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        n = self.size[rows]
        to = np.cumsum(n) - n
        return self.flat[np.repeat(self.at[rows] - to, n) + np.arange(int(n.sum()))]

    def _parts(self, piece: str) -> list[str] | None:
        """Letters, commas, full stops and line ends of a piece, where pre-tokenizers cut as well; none if it has others."""
        head = piece[:1] == HEAD
        out = []
        for k, line in enumerate((piece[1:] if head else piece).split("\n")):
            core, tail = (line[:-1], line[-1]) if line[-1:] in TAILS[:2] else (line, "")
            if not core.isalpha() or self.boundary == "word" and not core.isascii():  # normalised, others may end in a mark
                return None
            out += [HEAD + "\n"] * (k > 0) + [core if k == 0 and not head else HEAD + core] + [HEAD + tail] * bool(tail)
        return out

    def _add(self, pieces: list[str]) -> np.ndarray:
        """The rows of pieces, new ones encoded."""
        found = list(map(self.rows.get, pieces))
        if None in found:
            if len(self.rows) > self.cache:
                self._trim()
                found = list(map(self.rows.get, pieces))
            words: dict[str, None] = {}
            others: dict[str, None] = {}
            parts: dict[str, list[str]] = {}
            rows = self.rows
            for p, r in zip(pieces, found):
                if r is None:
                    if p.isalpha():
                        words[p] = None
                    elif own := self._parts(p):
                        parts[p] = own
                    else:
                        others[p] = None
            for own in parts.values():
                for x in own:
                    if x not in rows:
                        (words if x[-1] not in TAILS else others)[x] = None
            if self.mark_id is None:
                others, words = others | words, {}
            if words:
                self._store(list(words), *self._words(list(words)))
            if others:
                self._store(list(others), *self._singly(list(others)))
            whole = [p for p in parts if p not in rows]
            if whole:
                count = np.array([len(parts[p]) for p in whole])
                own = np.array([rows[x] for p in whole for x in parts[p]])
                self._store(whole, self._gather(own), np.add.reduceat(self.size[own], np.cumsum(count) - count))
            found = [rows[p] if r is None else r for p, r in zip(pieces, found)]
        rows = np.array(found, np.int64)
        self.used[rows] += 1
        return rows

    def _whole(self, text: str) -> str:
        return " " + text if self.lead else text

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), ``end`` (unless it is None) behind each text's, and where each text's begin (one entry more)."""
        whole: list[str] = []
        if self.boundary == "word":
            words, starts = split_words(texts)
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = coded.dictionary
            plain = pc.and_(pc.string_is_ascii(pieces), pc.invert(pc.match_substring(pieces, "<|")))  # special tokens have a case
            pieces = strings(pc.if_else(plain, pc.ascii_lower(pieces), pieces) if self.lower else pieces)
            pieces = [HEAD + p if p[0] == HEAD else p for p in pieces]
        else:
            codes, pieces, whole, starts = self._by_space(texts)
        rows = self._add(pieces)
        extra = [*self._ids([self._whole(t) for t in whole]), *([] if end is None else [np.array([end], np.uint32)])]
        flat = np.concatenate([self.flat, *extra])
        sizes = np.array([len(x) for x in extra], np.int64)
        at = np.concatenate([self.at[rows], len(self.flat) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.size[rows], sizes])
        if end is not None:
            codes = np.insert(codes, starts[1:], len(size) - 1)
            starts = starts + np.arange(len(starts))
        n = size[codes]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(int(to[-1]), np.uint32)
        for a in range(0, len(codes), BLOCK):  # in steps that stay in the processor's cache
            b = min(a + BLOCK, len(codes))
            ids[to[a] : to[b]] = flat[np.repeat(at[codes[a:b]] - (to[a:b] - to[a]), n[a:b]) + np.arange(to[b] - to[a])]
        return ids, to[starts]

    def _by_space(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        # white space beside a space belongs to one piece with it: such texts are encoded whole
        edge = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(distinct), distinct), pc.or_(pc.equal(distinct, ""), pc.starts_with(distinct, HEAD)))
        odd = edge.to_numpy(zero_copy_only=False) | (self.boundary == "text")
        pieces = strings(pc.if_else(pa.array(odd), "", distinct))
        slow = np.zeros(len(texts), bool)
        slow[owner[odd[codes]]] = True
        first = np.zeros(len(codes), bool)
        first[starts[:-1]] = True
        begins = first & ~slow[owner] & (not self.lead)
        heads, head_codes = np.unique(codes[begins], return_inverse=True)
        size = len(pieces)
        codes[begins] = size + head_codes
        at = size + len(heads)
        codes[first & slow[owner]] = at + np.arange(slow.sum())
        keep = first | ~slow[owner]
        named = pieces + [HEAD + pieces[k] for k in heads]
        whole = texts.filter(pa.array(slow)).to_pylist()
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])
        return codes[keep], named, whole, starts


class PieceEncoder(Encoder):
    """Ids of a sentencepiece model that puts a space before a text and whose pieces hold spaces only at their start."""

    def __init__(self, model: bytes, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.boundary, self.lower, self.cache, self.lead = "space", False, cache, True
        self.mark, self.mark_id = "", None
        self._reset()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]

    def _text(self, piece: str) -> str:
        return piece

    def _whole(self, text: str) -> str:
        return text

    def _parts(self, piece: str) -> list[str] | None:
        return None


def encoder(source: Broadcast, boundary: str, lower: bool = False, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a broadcast tokenizer."""
    digest, text = source.value
    return held(("encoder", digest, boundary, lower, cache), lambda: Encoder(text, boundary, lower, cache))
