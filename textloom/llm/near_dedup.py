"""SimHash near-duplicates, joined on Golay-code keys and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, table, text_array
from textloom.llm.components import components
from textloom.llm.golay import KIND_BIT, OPEN_SEGMENTS, SEGMENTS, pair_keys
from textloom.llm.shingle_links import shingle_links
from textloom.llm.simhash import fingerprints

RADIUS = 3
SALTS = 16
#: Fingerprints under a key from which on its pairs are searched by finer keys, and the parts of a segment that those take two of.
HOT, PARTS = 1_000, 5
#: Ids that a broadcast may hold; more are joined by a shuffle.
MOST_IDS = 2_000_000


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (signed long): a 64-bit SimHash of each whole text, 0 for a null or wordless one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(text_array(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keyed(nodes: DataFrame) -> DataFrame:
    """``key``, ``side`` (0 left, 1 right), ``node``, ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(fp), 20_000):
                part, own = fp[at : at + 20_000], node[at : at + 20_000]
                for side, (row, key) in enumerate(pair_keys(part.view(np.uint64))):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(row), side, np.int8)), pa.array(own[row]), pa.array(part[row])], ["key", "side", "node", "fp"])

    # some sixty rows come of each: more tasks than the few that so small an input gets
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("node", "fp").repartition(tasks, "node").mapInArrow(run, "key long, side byte, node long, fp long")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _finer(fp: str) -> Column:
    """For a key (column ``key``) the keys of its finer search: two parts, untouched, of the segment that it leaves open.

    Fingerprints within 3 bits agree in two of the segment's five parts at least.
    """
    open_segment = F.element_at(F.array(*[F.lit(s) for s in OPEN_SEGMENTS]), F.shiftright("key", KIND_BIT).cast("int") + 1)
    chosen = F.lit(None).cast("array<long>")
    for number, (at, width, _) in enumerate(SEGMENTS):
        cuts = [width * k // PARTS for k in range(PARTS + 1)]
        parts = [F.shiftrightunsigned(fp, at + a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        pairs = [F.lit(k << 10) + F.shiftleft(parts[x], 5) + parts[y] for k, (x, y) in enumerate(combinations(range(PARTS), 2))]
        chosen = F.when(open_segment == number, F.array(*pairs)).otherwise(chosen)
    return chosen


def _under_keys(nodes: DataFrame, radius: int, hot: int) -> DataFrame:
    """``_keyed`` rows of the keys that bring nodes of both sides together, with each key's ``hub`` (smallest node) and whether the row is ``near`` it."""
    keyed = _keyed(nodes)
    hub = (
        keyed.groupBy("key")
        .agg(F.min_by("fp", "node").alias("hub_fp"), F.min("node").alias("hub"), F.max("node").alias("other"), F.min("side").alias("first"), F.max("side").alias("last"), F.count("*").alias("members"))
        .filter("hub != other AND first = 0 AND last = 1")
        .select("key", "hub", "hub_fp", (F.col("members") >= hot).alias("hot"))
    )
    # merge: Spark sizes the sixty rows of a node as one, and would broadcast them
    return keyed.hint("merge").join(hub, "key").withColumn("near", _apart("fp", "hub_fp") <= radius)


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (``a``, ``b``) between ``node``s of distinct ``fp`` that connect all within ``radius`` bits (at most 3).

    All fingerprints within the radius meet under a key. Under each key those within the
    radius of its smallest node link to that one, so a tight group costs as many rows as
    it has members; pairs of which at least one is outside it are compared. Under a key of
    ``hot`` fingerprints or more only those pairs are compared that also agree in two of
    five parts of the segment that the key leaves open, as all within the radius do. Every
    edge is verified, and whatever is linked directly stays connected.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the keys bring together fingerprints within 3 bits at most")
    rows = cut(_under_keys(nodes, radius, hot))  # few: most keys have one fingerprint
    star = rows.filter(F.col("near") & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    close = (_apart("fa", "fb") <= radius) & (F.col("a") != F.col("b"))
    found = star
    for own, on in ((rows.filter("NOT hot"), ["key"]), (rows.filter("hot").withColumn("finer", F.explode(_finer("fp"))), ["key", "finer"])):
        left = own.filter("side = 0").select(*on, F.col("node").alias("a"), F.col("fp").alias("fa"), "near")
        right = own.filter("side = 1").select(*on, F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("near").alias("near_b"))
        far = left.filter("NOT near").join(right, on).filter(close).select("a", "b")
        mixed = left.filter("near").join(right.filter("NOT near_b"), on).filter(close).select("a", "b")
        found = found.unionByName(far).unionByName(mixed)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents link when their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the smallest id reachable. Null, empty and wordless texts have
    fingerprint 0 and link like any other. Equal fingerprints count once in the search,
    however many documents hold them. Ids are integers; rows that share one each get a
    row, and a row without an id gets its fingerprint's component but is none itself (null
    if no other row has that fingerprint). Texts are read whole, in slices of about a
    megabyte or one text. Other columns are not read, so clashing names don't matter. No
    documents give no rows.
    """
    marked = cut(with_fingerprints(docs, key, text, shingle))
    nodes = cut(marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, radius))
    least = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # a fingerprint of a third of all documents would be one join key: spread it
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # merge: Spark sizes the rows of all salts as those of one
    return salted.join(spread.hint("merge"), ["fp", "salt"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _without(docs: DataFrame, gone: DataFrame, key: str, most_ids: int) -> DataFrame:
    few = gone.count() <= most_ids
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["_gone"], "left_anti")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", most_ids: int = MOST_IDS, near: float | None = None, shingle: int = 5) -> DataFrame:
    """The documents that have the smallest id of their group; all columns.

    With ``near``, of what fingerprints leave, documents that share so much of their
    ``shingle``-word shingles (Jaccard similarity, exact) form groups as well, of which the smallest id stays.
    Rows that share an id stay or go together, and rows without one stay. The ids that go
    are sent to where the documents are, so that no text is shuffled, if they are
    ``most_ids`` or fewer; else both are joined by a shuffle. Texts are read whole, however long; other columns
    are kept, and one named ``_gone`` is an error. No documents give no rows.
    """
    gone = cut(near_duplicates(docs, key, text).filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct())
    left = _without(docs, gone, key, most_ids)
    if near is None:
        return left
    found = components(shingle_links(left, near, shingle, key=key, text=text, most_ids=most_ids))
    more = cut(found.filter("node != component").select(F.col("node").alias("_gone")))
    return _without(docs, gone.unionByName(more), key, most_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
