"""Packing of token sequences: bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textloom.llm.common import cut, slices, table, text_array
from textloom.llm.tokens import CACHE, SLICE, encoder, load, public_path

#: Open bins of a packer, and pieces that it packs at least; their ratio bounds what bins left open waste.
OPEN_BINS, PIECES = 512, 50_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sequence ids: the packer above, its bins below.
BIN_BITS = 36


class OpenBins:
    """At most ``count`` open bins in a bitset keyed by their free space.

    A piece goes to the fullest bin that holds it. Where none does, a new bin opens, and
    if all are in use the fullest closes first.
    """

    def __init__(self, capacity: int, count: int):
        self.capacity, self.count = capacity, count
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        own = self.free[space]
        bin_id = own.pop()
        if not own:
            self.bits ^= 1 << space
        return bin_id

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of ``size``."""
        fitting = self.bits >> size
        if fitting:
            space = size + ((fitting & -fitting).bit_length() - 1)
            bin_id = self._take(space)
        else:
            if self.open == self.count:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            space, bin_id = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = space - size
        if left:
            if not self.free[left]:
                self.bits |= 1 << left
            self.free[left].append(bin_id)
        else:
            self.open -= 1
        return bin_id, self.capacity - space


def pieces(docs: DataFrame, tokenizer: str, boundary: str, lower: bool, end: int, capacity: int, key: str = "doc_id", text: str = "text", cache: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """The pieces of each document's ids: all of them, or cuts of ``capacity`` of a longer document."""
    sent = load(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent, boundary, lower, cache)
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in slices(texts, slice_bytes):
                ids, starts = own.encode(texts[a:b], end)
                n = np.diff(starts)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = piece * capacity
                length = np.minimum(n[doc] - first, capacity)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = (starts[doc] + first) * 4
                crc = [zlib.crc32(view[x:y]) for x, y in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(first), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(sized: DataFrame, capacity: int, open_bins: int = OPEN_BINS, packer_pieces: int = PIECES) -> DataFrame:
    """``sized`` (``doc_id``, ``piece``, ``length``, more) with ``sequence_id`` and ``offset``.

    Pieces are dealt over packers by a hash, each of about ``packer_pieces`` or more, and come to
    a packer in the order of another hash, so that the result depends on neither their
    place nor the number of partitions. Packers work in one pass and keep only their open bins.
    """
    count = sized.count()
    packers = max(1, count // packer_pieces)
    columns = sized.columns
    schema = StructType([*sized.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    dealt = sized.withColumn("_packer", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers)))
    ordered = dealt.repartitionById(packers, F.col("_packer").cast("int")).sortWithinPartitions("_packer", F.xxhash64("piece", "doc_id"), "doc_id", "piece", "start", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            sequence, offset = [], []
            for own, size in zip(batch.column("_packer").to_pylist(), batch.column("length").to_pylist()):
                if own != packer:
                    packer, bins = own, OpenBins(capacity, open_bins)
                bin_id, at = bins.put(size)
                sequence.append(packer << BIN_BITS | bin_id)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    return ordered.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, boundary: str = "word", lower: bool = True, end: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", open_bins: int = OPEN_BINS, cache: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """Pieces of documents with the sequence of ``capacity`` ids that holds each, and their place in it.

    A document is its ids followed by ``end``; a null or empty text is ``end`` alone. Only
    longer documents are cut. Pieces with equal lengths or ids are packed apart, and
    sequences are gapless. Ids should be unique: rows that share one are packed each, and
    their pieces can't be told apart by number. No documents give no rows. Other columns are not read.
    ``cache`` and ``slice_bytes`` bound a worker's memory.
    """
    sized = pieces(docs, tokenizer or public_path("word_bpe_49k.json"), boundary, lower, end, capacity, key, text, cache, slice_bytes)
    return best_fit(cut(sized), capacity, open_bins)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, boundary: str = "word", lower: bool = True, end: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences: ``sequence_id``, ``input_ids``, ``segments`` (1, 2, ... for its pieces in order).

    ``packed`` is the result of ``pack`` for these ``docs`` with the same arguments. Rows that share an id, or have
    none, are told apart by their pieces' checksums. Null and empty texts are ``end`` alone, texts
    are read whole, other columns not at all. No rows give none.
    """
    sent = load(docs.sparkSession, tokenizer or public_path("word_bpe_49k.json"))
    own_places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("piece", "start", "length", "ids_crc32", "sequence_id", "offset")).alias("places"))
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).groupBy("_id").agg(F.array_sort(F.collect_list("text")).alias("texts"), F.count("*").alias("n"))
    texts = F.concat("texts", F.array_repeat(F.lit("").cast("string"), (F.col("n") - F.size("texts")).cast("int")))
    rows = rows.select("_id", texts.alias("texts")).join(own_places, F.col("_id").eqNullSafe(F.col("doc_id"))).select("texts", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent, boundary, lower)
        for batch in batches:
            lists = batch.column(0)
            ids, starts = own.encode(text_array(lists.flatten()), end)
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            found = []
            for k, places in enumerate(batch.column(1).to_pylist()):
                rest: dict[tuple, list[dict]] = {}
                for p in places:
                    rest.setdefault((p["start"], p["length"], p["ids_crc32"]), []).append(p)
                for row in range(first[k], first[k + 1]):  # rows that share an id: each takes a place of its own pieces
                    whole = ids[starts[row] : starts[row + 1]]
                    for at in range(0, len(whole), capacity):
                        part = whole[at : at + capacity]
                        p = rest[at, len(part), zlib.crc32(part.astype("<u4").tobytes())].pop()
                        found.append((p["sequence_id"], p["offset"], part))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["sequence_id", "offset", "ids"])

    tokens = rows.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    ordered = tokens.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most one sequence's ids a group
    numbered = F.transform("parts", lambda p, k: F.array_repeat(k + 1, F.size(p["ids"])))
    return ordered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("input_ids"), F.flatten(numbered).alias("segments"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
