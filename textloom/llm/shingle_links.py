"""Links between texts whose word shingles overlap: MinHash bands propose, exact overlaps decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, slices, text_array
from textloom.llm.simhash import shingle_hashes

#: Minima of a signature: bands of so many. A pair that shares 0.8 of its shingles agrees in one band with probability 0.998.
BANDS, WIDTH = 12, 4
#: Members of a hub that are held against one copy of it.
MEMBERS = 64


def signatures(hashes: np.ndarray, starts: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """The least hash of each set under ``count`` mixings; sets aren't empty."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    out = np.empty((len(starts) - 1, count), np.uint64)
    for k in range(count):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * odd[k]
        mixed ^= mixed >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(mixed * odd[count - 1 - k], starts[:-1])
    return out


def _text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL")


def banded(docs: DataFrame, shingle: int, bands: int, width: int, key: str, text: str) -> DataFrame:
    """``doc_id``, ``values`` (one for each band) for every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in slices(texts):
                hashes, starts = shingle_hashes(pc.ascii_lower(texts[a:b]), shingle)
                full = np.flatnonzero(np.diff(starts))
                if not len(full):
                    continue
                least = signatures(hashes, np.append(starts[:-1][full], starts[-1]), bands * width).reshape(len(full), bands, width)
                value = np.zeros((len(full), bands), np.uint64)
                for k in range(width):
                    value = value * np.uint64(0x9E3779B97F4A7C15) ^ least[:, :, k]
                ends = pa.array(np.arange(0, value.size + 1, bands), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(full)), pa.ListArray.from_arrays(ends, pa.array(value.ravel().view(np.int64)))], ["doc_id", "values"])

    return _text(docs, key, text).mapInArrow(run, "doc_id long, values array<long>")


def sets(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``doc_id``, ``hashes``: the distinct shingles of each text, by 32 bits of their hash.

    Of two texts of 1,000 words, different shingles agree by chance once in some 4,000 pairs, which moves their similarity by 0.001.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in slices(texts):
                hashes, starts = shingle_hashes(pc.ascii_lower(texts[a:b]), shingle)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                own = [np.unique(short[x:y]) for x, y in zip(starts[:-1], starts[1:])]
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in own])), pa.int32())
                flat = np.concatenate([np.zeros(0, np.uint32), *own]).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "hashes"])

    return _text(docs, key, text).mapInArrow(run, "doc_id long, hashes array<int>")


def overlaps(pairs: DataFrame, docs: DataFrame, shingle: int, least: float, key: str, text: str, most_ids: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``; many of ``a`` for one ``b``) whose texts share ``least`` of their distinct shingles or more."""
    named = cut(pairs.select(F.col("a").alias("_n")).union(pairs.select("b")).distinct())
    few = named.count() <= most_ids
    own = sets(docs.join(F.broadcast(named) if few else named, docs[key] == named["_n"], "left_semi"), shingle, key, text)
    # a hub of many members is one join key: it goes to a place for every MEMBERS of them
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("places"))
    left = own.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    spread = own.join(hubs, own["doc_id"] == hubs["b"]).select("b", F.col("hashes").alias("y"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    placed = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"))
    both = placed.join(left, "a").join(spread, ["b", "place"])
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def shingle_links(docs: DataFrame, least: float = 0.8, shingle: int = 5, bands: int = BANDS, width: int = WIDTH, key: str = "doc_id", text: str = "text", most_ids: int = 2_000_000) -> DataFrame:
    """Edges (``a``, ``b``) between documents whose distinct ``shingle``-word shingles have a Jaccard similarity of ``least`` or more.

    Documents that agree in a band are held against the smallest of them, so a group of near copies costs a
    comparison a member. Those that fail are held against the smallest that agrees with them in two neighbouring
    bands, then three, and so on: documents that only share a passage soon agree with none, and
    each costs at most a comparison for every band and round. Like the bands themselves this finds near all links, not surely all.
    Words are those between white space, A-Z lower-cased; a text of fewer words is one shingle, one without words links to
    none. Texts are read whole, null ids left out, other columns not read. No documents give no rows.
    """
    signed = cut(banded(docs, shingle, bands, width, key, text).distinct())
    open_bands = signed.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).distinct()
    known: list[DataFrame] = []
    for agreeing in range(1, bands + 1):
        value = F.xxhash64(F.slice(F.concat("values", "values"), F.col("band") + 1, agreeing)).alias("value")
        rows = open_bands.join(signed, "doc_id").select("doc_id", "band", value).distinct()
        hubs = rows.groupBy("band", "value").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).filter("hub != other").drop("other")
        met = cut(rows.join(hubs, ["band", "value"]).filter("doc_id != hub"))
        pairs = cut(met.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
        if not pairs.limit(1).count():
            break
        near = cut(overlaps(pairs, docs, shingle, least, key, text, most_ids))
        known.append(near)
        failed = met.join(near, (met["doc_id"] == near["a"]) & (met["hub"] == near["b"]), "left_anti")
        open_bands = cut(failed.select("doc_id", "band").distinct())
    if not known:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.unionByName, known).distinct()
