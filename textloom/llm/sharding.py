"""Shards by weighted rendezvous hashing, with a gapless place for each record.

Built-in functions only. A record's shard depends on its key and the shards' weights, so a
new shard takes records from all others and no record moves between old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.checks import crc32_sql
from textloom.llm.common import cut, table

#: Shards of the registered query.
SHARDS = 8
#: Hexadecimal digits of a record's digest that name its bucket; places are numbered by bucket, so no task numbers a whole shard.
DIGITS = 3
#: Buckets of all shards together: so many rows are broadcast at most, of some 40 bytes.
MAX_BUCKETS = 1 << 20


def _text(key: Column | str) -> Column:
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def unit(key: Column | str, shard: int) -> Column:
    """A number in (0, 1), the same for a key and shard everywhere: 52 bits of an MD5."""
    digest = F.md5(F.concat(_text(key), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column | str, weights: Sequence[float]) -> Column:
    """The shard 0, 1, ... with the highest score for the key; each takes keys in proportion to its weight.

    A shard of weight 0 takes nothing. A null key counts as an empty one. Of equal scores
    the first shard's counts.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    scored = [F.struct((F.lit(-float(w)) / F.ln(unit(key, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return -(F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def numbered(records: DataFrame, shard: str = "shard", digits: int = DIGITS) -> DataFrame:
    """``records`` with ``slot``: their places 0, 1, ... in their shard, in the order of a digest of their values.

    Equal rows are counted before they are moved and come back at the end, so a row that
    repeats without bound numbers no task full. Neither a shard nor a bucket of it that
    grows is held in memory: a bucket's rows are sorted, and only the counts of buckets
    (16 ** ``digits`` for each shard) are added up. The order depends on values alone, not on
    partitions. All columns are part of a row's value, so texts are better left out. No
    records give no rows.
    """
    columns = records.columns
    clash = {"slot", "_times", "_digest", "_bucket", "_before"} & set(columns)
    if clash:
        raise ValueError(f"columns have names that are used here: {sorted(clash)}")
    digest = F.md5(F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns if c != shard)))
    rows = records.groupBy(*(f"`{c}`" for c in columns)).agg(F.count("*").alias("_times")).withColumn("_digest", digest)
    rows = cut(rows.withColumn("_bucket", F.conv(F.substring("_digest", 1, digits), 16, 10).cast("int")))
    counts = rows.groupBy(shard, "_bucket").agg(F.sum("_times").alias("_before"))
    if counts.select(shard).distinct().count() * 16**digits > MAX_BUCKETS:
        raise ValueError("too many shards for so many digits: take fewer digits")
    above = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_before").over(above), F.lit(0)).alias("_before"))
    order = Window.partitionBy(shard, "_bucket").orderBy("_digest", *(f"`{c}`" for c in columns)).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_times").over(order), F.lit(0)))
    placed = placed.join(F.broadcast(starts), (F.col(shard).eqNullSafe(F.col("_shard"))) & (F.col("_bucket") == F.col("_of")))
    first = F.col("_before") + F.col("_inside")
    return placed.select(*(f"`{c}`" for c in columns), F.explode(F.sequence(first, first + F.col("_times") - 1)).alias("slot"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text and 1) and ``text_crc32``; a null text counts as an empty one."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole).alias("text_crc32"))


def shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", digits: int = DIGITS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` ("key"), ``shard``, ``slot``, ``grown_shard`` of all documents.

    ``grown`` are other weights, such as those with one more shard (null without them): with
    one more, a document either stays or moves to the new shard. Texts are read once and not
    shuffled, however long; other columns are not read, so their names don't matter. Rows
    that repeat, with or without an id, are kept each with a slot of its own; null ids share
    the shard of the empty key. No documents give no rows.
    """
    rows = sized(docs, key, text).withColumn("shard", shard_of("doc_id", weights))
    placed = numbered(rows, digits=digits)
    later = shard_of("doc_id", grown) if grown else F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", later.alias("grown_shard"))


def moved(records: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id") -> DataFrame:
    """``from_shard``, ``to_shard``, ``n_rows``: how many records go where when the weights change."""
    pairs = records.select(shard_of(key, before).alias("from_shard"), shard_of(key, after).alias("to_shard"))
    return pairs.groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def write_shards(records: DataFrame, weights: Sequence[float], path: str, files: int = 1, key: str = "doc_id", seed: int = 0) -> None:
    """Whole records as Parquet, a folder for each shard, of about ``files`` files.

    Rows are dealt over files by a random number, not by their key, so that one key with many
    rows doesn't fill a file. Replaces what ``path`` holds. All columns are kept; one
    named ``shard`` is an error.
    """
    if "shard" in records.columns:
        raise ValueError("a column is named shard already")
    dealt = records.withColumn("shard", shard_of(key, weights)).withColumn("_file", F.floor(F.rand(seed) * files).cast("int"))
    dealt.repartition(files * len(weights), "shard", "_file").drop("_file").write.partitionBy("shard").mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def _shard_sql(count: int) -> str:
    scores = ", ".join(f"struct_pack(score := -1.0 / ln((('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':{s}')[:13])::BIGINT + 0.5) / {float(1 << 52)!r}::DOUBLE), shard := {-s})" for s in range(count))
    return f"-list_max([{scores}]).shard"


SQL = f"""
WITH sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, ({crc32_sql("coalesce(text, '')")})::BIGINT AS text_crc32 FROM documents),
placed AS (SELECT *, ({_shard_sql(SHARDS)})::INTEGER AS shard, ({_shard_sql(SHARDS + 1)})::INTEGER AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), doc_id, size, text_crc32) - 1 AS slot
FROM placed
"""
