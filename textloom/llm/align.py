"""Alignment of two tokenizers' tokens over the same bytes.

A merges with B as two sorted lists of token ends do, for all documents of a batch in
lockstep: one state vector holds every document's place in A and in B, a step advances the side
that ends first, or both where they end together, which cuts a group and links two tokens.
Finished documents leave the vector. Links are then counted over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import held, shared_dir, slices, table, text_array
from textloom.llm.tokens import Encoder, PieceEncoder, load, public_path

#: Pieces whose ids a worker keeps for each tokenizer, bytes of text aligned at a time, tokens of A in a lane, groups written at a time.
CACHE, SLICE, LANE, GROUPS = 250_000, 2 << 20, 512, 1 << 16
#: Tokens of A that are tried for a cut between two lanes.
TRIES = 64
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
SPAN = "doc_id long, start long, stop long, a array<int>, b array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its rule: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    letters = byte_letters()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(letters[c] for c in token)
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model."""
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return out


class Vocabulary:
    """The bytes of all ids, one after another."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        to = np.cumsum(n) - n
        return self.flat[np.repeat(self.at[ids] - to, n) + np.arange(int(n.sum()))]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, length: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin in A and in B: at each document's first token, and in a long one also behind a common end every
    ``length`` tokens or so, so that it doesn't go on alone when all others have finished. ``first_a`` has one entry more than there are documents."""
    n = np.diff(first_a)
    extra = np.maximum(n - 1, 0) // length
    doc = np.repeat(np.arange(len(n)), extra)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    tried = (first_a[doc] + step * length)[:, None] + np.arange(TRIES)
    tried = np.where(tried < first_a[doc + 1][:, None] - 1, tried, -1)
    value = np.where(tried >= 0, ends_a[tried], -1)
    place = np.minimum(np.searchsorted(ends_b, value), len(ends_b) - 1)
    same = (ends_b[place] == value) if len(ends_b) else np.zeros_like(tried, bool)
    pick = np.argmax(same, axis=1)
    rows = np.flatnonzero(same.any(axis=1)) if len(same) else np.zeros(0, np.int64)
    cut_a = np.unique(np.concatenate([first_a[:-1][n > 0], tried[rows, pick[rows]] + 1]))
    before = np.where(cut_a > 0, ends_a[cut_a - 1], 0)
    return cut_a, np.searchsorted(ends_b, before, "right")


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B that end together, in order. ``start_a``, ``start_b``: where the lanes begin; all lanes advance at once."""
    i, j = start_a.copy(), start_b.copy()
    stop = np.append(start_a[1:], len(ends_a))
    linked_a, linked_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        a, b = ends_a[i], ends_b[j]
        both = a == b
        linked_a.append(i[both])
        linked_b.append(j[both])
        i = i + (a <= b)
        j = j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    return np.sort(np.concatenate(linked_a)), np.sort(np.concatenate(linked_b))


class Digits:
    """Decimal texts of ids with a separator behind each, made by table."""

    def __init__(self, top: int):
        self.size = np.char.str_len(np.arange(top).astype(str)).astype(np.int64)
        self.width = int(self.size.max()) + 1
        self.table = np.zeros((top, self.width), np.uint8)
        for k in range(self.width - 1):
            shift = self.size - 1 - k
            self.table[:, k] = np.where(shift >= 0, np.arange(top) // 10 ** np.maximum(shift, 0) % 10 + 48, 0)

    def text(self, ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and how many each id with its separator takes; a separator 0 is left out."""
        cells = self.table[ids]
        size = self.size[ids]
        cells[np.arange(len(ids)), size] = behind
        taken = size + (behind > 0)
        return cells[np.arange(self.width)[None, :] < taken[:, None]], taken


class Aligned:
    """Tokens of the documents of a slice whose bytes agree, their groups and links."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, lane: int):
        self.ids_a, self.ids_b, self.first_a, self.first_b = ids_a, ids_b, first_a, first_b
        self.ends_a, self.ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
        self.link_a, self.link_b = lockstep(self.ends_a, self.ends_b, *lanes(self.ends_a, self.ends_b, first_a, lane))
        self.doc = np.searchsorted(first_a, self.link_a, "right") - 1
        #: groups of documents: the first, one entry more
        self.groups = np.searchsorted(self.doc, np.arange(len(first_a)))

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins in A and in B, one entry more."""
        return np.append(0, self.link_a + 1), np.append(0, self.link_b + 1)

    def pairs(self, top_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct linked ids of each document: document, id of A, id of B, times."""
        a, b = self.ids_a[self.link_a].astype(np.int64), self.ids_b[self.link_b].astype(np.int64)
        top_a = int(a.max(initial=0)) + 1
        key, times = np.unique((self.doc * top_a + a) * top_b + b, return_counts=True)
        doc, pair = np.divmod(key, top_a * top_b)
        return doc, pair // top_b, pair % top_b, times

    def digests(self, digits: Digits) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document, written some groups at a time."""
        begin_a, begin_b = self.starts()
        made = [hashlib.sha256() for _ in range(len(self.groups) - 1)]
        last = np.zeros(len(self.link_a), bool)
        last[self.groups[1:][np.diff(self.groups) > 0] - 1] = True
        for g in range(0, len(self.link_a), GROUPS):
            h = min(g + GROUPS, len(self.link_a))
            n_a, n_b = np.diff(begin_a[g : h + 1]), np.diff(begin_b[g : h + 1])
            both = np.column_stack([n_a, n_b]).ravel()
            ids = np.empty(int(both.sum()), np.int64)
            of_a = np.repeat(np.tile([True, False], h - g), both)
            ids[of_a] = self.ids_a[begin_a[g] : begin_a[h]]
            ids[~of_a] = self.ids_b[begin_b[g] : begin_b[h]]
            behind = np.full(len(ids), ord(","), np.uint8)
            ends = np.cumsum(both) - 1
            behind[ends[0::2]] = ord("|")
            behind[ends[1::2]] = np.where(last[g:h], 0, ord(";"))
            text, taken = digits.text(ids, behind)
            to = np.append(0, np.cumsum(taken))[np.append(0, ends[1::2] + 1)]  # where each group's text begins
            view = memoryview(text)
            for d in range(int(self.doc[g]), int(self.doc[h - 1]) + 1):
                x, y = max(int(self.groups[d]), g), min(int(self.groups[d + 1]), h)
                if x < y:
                    made[d].update(view[to[x - g] : to[y - g]])
        return [m.hexdigest() for m in made]


class Aligner:
    """A worker's two encoders, their vocabularies' bytes and decimal texts."""

    def __init__(self, source_a: str, model_b: bytes, cache: int = CACHE, lane: int = LANE):
        self.a, self.b = Encoder(source_a, "space", cache=cache, plain=True, lead=True), PieceEncoder(model_b, cache)
        self.bytes_a, self.bytes_b = Vocabulary(byte_level_bytes(self.a.tokenizer)), Vocabulary(piece_bytes(self.b.model))
        self.top_b = len(self.bytes_b.size)
        self.digits = Digits(max(len(self.bytes_a.size), self.top_b))
        self.lane = lane

    def align(self, texts: pa.Array) -> tuple[np.ndarray, Aligned]:
        """Which texts are aligned, and their tokens. Others are empty or give other bytes back."""
        texts = texts.cast(pa.large_string())
        wanted = [(" " + t).encode() if t else b"" for t in texts.to_pylist()]
        length = np.array([len(w) for w in wanted], np.int64)
        ids_a, first_a = self.a.encode(texts, None)
        ids_b, first_b = self.b.encode(texts, None)
        ok = length > 0
        for vocabulary, ids, first in ((self.bytes_a, ids_a, first_a), (self.bytes_b, ids_b, first_b)):
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            size = vocabulary.size[ids]
            ok &= np.bincount(owner, size, len(texts)).astype(np.int64) == length
            ok &= np.bincount(owner, size == 0, len(texts)) == 0
        for vocabulary, ids, first in ((self.bytes_a, ids_a, first_a), (self.bytes_b, ids_b, first_b)):
            keep = np.flatnonzero(ok)
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            given = vocabulary.join(ids[ok[owner]])
            differ = np.flatnonzero(given != np.frombuffer(b"".join([wanted[k] for k in keep]), np.uint8))
            ok[keep[np.searchsorted(np.cumsum(length[keep]), differ, "right")]] = False
        kept = []
        for ids, first in ((ids_a, first_a), (ids_b, first_b)):
            n = np.diff(first)
            kept += [ids[np.repeat(ok, n)].astype(np.int64), np.append(0, np.cumsum(n[ok]))]
        return ok, Aligned(kept[0], kept[2], kept[1], kept[3], self.bytes_a.size, self.bytes_b.size, self.lane)


def _lists(owner: np.ndarray, values: np.ndarray, count: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


def _sent(spark: SparkSession, tokenizer: str | None, model: str | None) -> tuple[Broadcast, Broadcast]:
    with open(model or public_path("piece_bpe_32k.model"), "rb") as f:
        content = f.read()
    return load(spark, tokenizer or public_path("byte_bpe_50k.json")), spark.sparkContext.broadcast((hashlib.sha1(content).hexdigest(), content))


def _aligner(sent: tuple[Broadcast, Broadcast], lane: int) -> Aligner:
    (name_a, source), (name_b, model) = sent[0].value, sent[1].value
    return held(("aligner", name_a, name_b, lane), lambda: Aligner(source, model, lane=lane))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def aligned(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, key: str = "doc_id", text: str = "text", lane: int = LANE) -> DataFrame:
    """A row for each document: tokens, groups, links, the groups' digest, and its distinct linked ids ``a``, ``b`` with their ``times``."""
    sent = _sent(docs.sparkSession, tokenizer, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(sent, lane)
        for batch in batches:
            texts = text_array(batch.column(1))
            for x, y in slices(texts, SLICE):
                ok, found = own.align(texts[x:y])
                n = y - x
                numbers = np.zeros((4, n), np.int64)
                numbers[:, ok] = np.diff(found.first_a), np.diff(found.first_b), np.diff(found.groups), np.diff(found.groups)
                digest = np.full(n, "", object)
                digest[ok] = found.digests(own.digits)
                doc, a, b, times = found.pairs(own.top_b)
                doc = np.flatnonzero(ok)[doc]
                arrays = [batch.column(0)[x:y], *(pa.array(v) for v in numbers), pa.array(digest, pa.string()), *(_lists(doc, v, n) for v in (a, b, times))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    return _texts(docs, key, text).mapInArrow(run, ROW)


def token_groups(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, key: str = "doc_id", text: str = "text", lane: int = LANE) -> DataFrame:
    """The groups themselves: ``doc_id``, byte range ``start`` to ``stop`` in space + text, ids ``a`` and ``b``. Texts without tokens give no rows."""
    sent = _sent(docs.sparkSession, tokenizer, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(sent, lane)
        for batch in batches:
            texts = text_array(batch.column(1))
            for x, y in slices(texts, SLICE):
                ok, found = own.align(texts[x:y])
                begin_a, begin_b = found.starts()
                stop = found.ends_a[found.link_a]
                base = np.append(0, stop)[found.groups[:-1]]
                lists = [pa.ListArray.from_arrays(pa.array(v, pa.int32()), pa.array(ids.astype(np.int32))) for v, ids in ((begin_a, found.ids_a), (begin_b, found.ids_b))]
                where = base[found.doc]
                ids = batch.column(0)[x:y].take(pa.array(np.flatnonzero(ok)[found.doc]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.append(0, stop[:-1]) - where), pa.array(stop - where), *lists], ["doc_id", "start", "stop", "a", "b"])

    return _texts(docs, key, text).mapInArrow(run, SPAN)


def link_counts(rows: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count``, ``best``: how many links hold each pair of ids, and whether no other pair of that ``b`` has more.

    Of two tokens that end together one ends with the other, so there are at most as many pairs
    as both vocabularies have bytes. Counts are added up in each task before they are shuffled.
    """
    each = rows.select(F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("x.a", "x.b", "x.times")
    counts = each.groupBy("a", "b").agg(F.sum("times").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def alignments(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, key: str = "doc_id", text: str = "text", lane: int = LANE) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of all documents.

    A encodes a space and the text, B the text, to which it adds a space itself; strings of
    special tokens are plain text. Null and empty texts, and those whose joined tokens differ
    from space + text, count as without tokens: zeros and an empty digest. Whole texts, long
    ones in several lanes. Rows that share an id or a text are rows each, null ids
    too; other columns aren't read, so their names don't matter. No documents give no rows.

    Texts are encoded once: the documents' links are written to the shared folder, counted there,
    and looked up in the counts, whose number the vocabularies bound.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "links")
    aligned(docs, tokenizer, model, key, text, lane).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = link_counts(rows).toPandas()  # at most as many rows as the vocabularies have bytes
    code = (counts["a"].to_numpy(np.int64) << 32) | counts["b"].to_numpy(np.int64)
    order = np.argsort(code)
    sent = spark.sparkContext.broadcast((code[order], counts["count"].to_numpy(np.int64)[order], counts["best"].to_numpy(bool)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = sent.value
        for batch in batches:
            a, b, times = (batch.column(c) for c in ("a", "b", "times"))
            owner = np.repeat(np.arange(len(batch)), a.value_lengths().to_numpy())
            a, b, times = (v.flatten().to_numpy().astype(np.int64) for v in (a, b, times))
            at = np.searchsorted(codes, a << 32 | b)
            sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, times * best[at])
            np.add.at(sums[1], owner, times * count[at])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s) for s in sums), batch.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
