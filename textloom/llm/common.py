"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that an operator turns into words at a time; bounds a worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine; an error on a cluster, whose executors wouldn't see it."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="textloom-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) it is a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own_folder(spark))
    return df.checkpoint()


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, one thing at a time: another key lets go of the last one."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array, null texts empty. Gives memory of the batch before back first."""
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # over 2 GB of text stays chunked
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` text bytes, at least one row each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, stop
        at, done = stop, int(ends[stop - 1])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's words start.

    The second value has one entry more than there are texts.
    """
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return words.filter(full), at[offsets]


def strings(values: pa.Array) -> list:
    """The values as Python objects; faster than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """An integer for each word, and the distinct words by that integer."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def keep_rows(docs: DataFrame, text: str, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for whose texts ``verdict`` is true, as they are; nothing is shuffled."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(text_array(batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)
