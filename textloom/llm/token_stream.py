"""Token ids in Arrow stream files of fixed-size lists.

A file is an Arrow IPC stream whose batches all have the same number of equal-length
sequences: ``input_ids``, unsigned integers, and ``mask``, false behind the last id. Equal
batches have equal sizes in the file, so the place of any sequence is computed and its
values are views of the mapped file. Beside it a second stream lists the documents:
``doc_id``, ``start`` and ``n_tokens`` in the file's ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, shared_dir, slices, table, text_array
from textloom.llm.files import open_file, writer
from textloom.llm.tokens import SLICE, encoder, load, public_path

SEQUENCE, ROWS = 2048, 32
MANIFEST = "part int, path string, docs_path string, n_docs long, n_tokens long, n_sequences long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFile:
    """Random access to one file's sequences, masks and ids; values are views where the file is mapped."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        self.schema = pa.ipc.read_schema(self.file)
        self.first = self.file.tell()
        message = pa.ipc.read_message(self.file)
        self.stride = self.file.tell() - self.first
        batch = pa.ipc.read_record_batch(message, self.schema)
        self.rows, self.length = batch.num_rows, batch.schema.field("input_ids").type.list_size
        self.batches = (self.file.size() - self.first) // self.stride
        #: a mapped file as one buffer; of any other only the batches asked for are read
        self.data = None
        if isinstance(self.file, pa.MemoryMappedFile):
            self.file.seek(0)
            self.data = self.file.read_buffer()

    def batch(self, k: int) -> pa.RecordBatch:
        at = self.first + k * self.stride
        part = self.data.slice(at, self.stride) if self.data is not None else pa.py_buffer(self.file.read_at(self.stride, at))
        return pa.ipc.read_record_batch(pa.ipc.read_message(part), self.schema)

    def __len__(self) -> int:
        return self.batches * self.rows

    def sequence(self, k: int) -> np.ndarray:
        return self._ids(k // self.rows)[(at := k % self.rows * self.length) : at + self.length]

    def mask(self, k: int) -> pa.Array:
        return self.batch(k // self.rows).column("mask").values[(at := k % self.rows * self.length) : at + self.length]

    def _ids(self, k: int) -> np.ndarray:
        return self.batch(k).column("input_ids").values.to_numpy()

    def documents(self, docs: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) of each listed document, in order."""
        size = self.rows * self.length
        held, ids = -1, np.zeros(0, np.uint32)
        for doc_id, start, n in zip(*(docs.column(c).to_pylist() for c in DOCS.names)):
            parts = []
            while n:
                if start // size != held:
                    held = start // size
                    ids = self._ids(held)
                part = ids[start % size : start % size + n]
                parts.append(part)
                start, n = start + len(part), n - len(part)
            whole = np.concatenate(parts) if parts else np.zeros(0, ids.dtype)
            yield doc_id, start - len(whole), whole


def _batch(ids: np.ndarray, length: int, rows: int, schema: pa.Schema) -> pa.RecordBatch:
    """One batch; zeros and a false mask fill it up."""
    size = length * rows
    mask = np.zeros(size, bool)
    mask[: len(ids)] = True
    full = np.zeros(size, ids.dtype)
    full[: len(ids)] = ids
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), type=schema.field(0).type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=schema.field(1).type)], schema=schema)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, boundary: str = "space", lower: bool = False, end: int = 0, length: int = SEQUENCE, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids, each followed by ``end``, in ascending order of their keys.

    Tasks sort a range of keys each and write one file, in batches of ``rows`` sequences
    of ``length`` ids; they hold one batch and one Arrow batch of texts. Returns the files:
    ``part`` (ascending with the keys), ``path``, ``docs_path`` and counts. A null or empty
    text gives ``end`` alone; rows with one key are ordered by text; null keys come first.
    No documents give no files. Other columns are not read.
    """
    sent = load(docs.sparkSession, tokenizer or public_path("byte_bpe_50k.json"))
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent, boundary, lower)
        kind = pa.uint16() if max(own.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
        schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path, docs_path = f"{folder}/part-{part:06d}.arrow", f"{folder}/part-{part:06d}.docs.arrow"
        n_docs = n_tokens = written = 0
        rest = np.zeros(0, kind.to_pandas_dtype())
        with writer(path) as out, writer(docs_path) as index, pa.ipc.new_stream(out, schema) as stream, pa.ipc.new_stream(index, DOCS) as listed:
            for batch in _chain(first, batches):
                texts = text_array(batch.column(1))
                for a, b in slices(texts, SLICE):
                    ids, starts = own.encode(texts[a:b], end)
                    listed.write_batch(pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n_tokens + starts[:-1]), pa.array(np.diff(starts))], schema=DOCS))
                    rest = np.concatenate([rest, ids.astype(rest.dtype)])
                    n_docs, n_tokens = n_docs + b - a, n_tokens + len(ids)
                    at = 0
                    while len(rest) - at >= length * rows:
                        stream.write_batch(_batch(rest[at : at + length * rows], length, rows, schema))
                        at += length * rows
                        written += rows
                    rest = rest[at:]
            if len(rest):
                stream.write_batch(_batch(rest, length, rows, schema))
                written += rows
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs_path]), pa.array([n_docs]), pa.array([n_tokens]), pa.array([written])], ["part", "path", "docs_path", "n_docs", "n_tokens", "n_sequences"])

    return cut(ordered.mapInArrow(run, MANIFEST))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` in the ids of all files, ``n_tokens``, ``ids_crc32``.

    One task reads one file. The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = (F.row_number().over(Window.orderBy("part")) - 1).alias("number")
    listed = files.select("part", "path", "docs_path", before.alias("base"), number)  # a row for each file
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = pa.ipc.open_stream(open_file(row["docs_path"])).read_all()
                found = [(i, row["base"] + s, len(ids), zlib.crc32(ids.astype("<u4"))) for i, s, ids in TokenFile(row["path"]).documents(docs)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartitionById(tasks, "number").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens")))
