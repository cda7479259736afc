"""Document tables that are replaced and deleted on disk, several at once, behind one manifest.

Rows lie in buckets of their document's hash. A change writes the buckets that it touches as
new folders and then one manifest file, which names the folder of every bucket of every table.
Readers follow the newest manifest, so they see a change in all tables or in none; folders of
earlier versions stay readable until they are cleared. One writer at a time, any number of readers.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Buckets of a table; a manifest has a row for each, so their number is bounded.
BUCKETS, MAX_BUCKETS = 64, 10_000
MANIFEST = "version long, table string, key string, buckets int, schema string, bucket int, written long, rows long"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests")


def versions(spark: SparkSession, store: str) -> DataFrame:
    """``version``, ``table``, ``rows``, ``rewritten`` (buckets that the version wrote), oldest first."""
    own = _manifests(spark, store).groupBy("version", "table")
    out = own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if((F.col("written") == F.col("version")) & F.col("bucket").isNotNull()).alias("rewritten"))
    return out.orderBy("version", "table")


def _manifest(spark: SparkSession, store: str, version: int | None = None) -> list:
    """The rows of one version, the newest by default; as many as tables have buckets at most."""
    found = _manifests(spark, store)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    rows = found.filter(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"no version {version} in {store}")
    return rows


def _read(spark: SparkSession, store: str, rows: list, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(rows[0]["schema"]))
    own = [f"{store}/{r['table']}/version={r['written']}/bucket={r['bucket']}" for r in rows if r["bucket"] is not None and (buckets is None or r["bucket"] in buckets)]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def read(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """A table as the newest version, or a given one, has it. What a started read sees doesn't change."""
    rows = [r for r in _manifest(spark, store, version) if r["table"] == table]
    if not rows:
        raise ValueError(f"no table {table} in {store}")
    return _read(spark, store, rows)


def _write(spark: SparkSession, store: str, version: int, table: str, rows: DataFrame, key: str, buckets: int) -> list[tuple]:
    """Write ``rows`` by bucket; the manifest rows of what was written, counted from there."""
    folder = f"{store}/{table}/version={version}"
    own = rows.withColumn("_bucket", _bucket(key, buckets))
    # a bucket goes to one task, and one that is far larger than others (a document with a third of all rows) to several
    own.hint("rebalance", "_bucket").withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    found = spark.read.schema(StructType([*rows.schema.fields]).add("bucket", IntegerType())).parquet(folder)
    text = rows.schema.json()
    return [(version, table, key, buckets, text, r["bucket"], version, r["n"]) for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect()]


def _publish(spark: SparkSession, store: str, version: int, rows: list[tuple]) -> None:
    """One file, which its writer renames to its place once it is whole."""
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{store}/manifests")


def _empty(version: int, table: str, key: str, buckets: int, schema: str) -> tuple:
    return (version, table, key, buckets, schema, None, version, 0)


def create(spark: SparkSession, store: str, tables: Mapping[str, DataFrame], key: str, buckets: int = BUCKETS) -> None:
    """Version 1 of a store: every table has the column ``key``. A column named ``bucket`` is an error."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"between 1 and {MAX_BUCKETS} buckets")
    for name, rows in tables.items():
        if {"bucket", "_bucket"} & {c.lower() for c in rows.columns}:
            raise ValueError(f"{name} has a column bucket or _bucket")
    own: list[tuple] = []
    for name, rows in tables.items():
        own += _write(spark, store, 1, name, rows, key, buckets) or [_empty(1, name, key, buckets, rows.schema.json())]
    _publish(spark, store, 1, own)


def _change(spark: SparkSession, store: str, gone: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> int:
    """Rewrite the buckets of ``gone`` keys (by table) without their rows and with those of ``new``; the new version."""
    old = _manifest(spark, store)
    version, out = old[0]["version"] + 1, []
    for name in dict.fromkeys(r["table"] for r in old):
        rows = [r for r in old if r["table"] == name]
        key, buckets, schema = rows[0]["key"], rows[0]["buckets"], rows[0]["schema"]
        if name not in gone:
            out += [(version, *tuple(r)[1:]) for r in rows]
            continue
        keys = gone[name].select(key).distinct()
        touched = {r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect()}  # buckets, not keys
        kept = _read(spark, store, rows, touched)
        kept = kept.join(keys, key, "left_anti").select(*kept.columns)
        if name in new:
            kept = kept.unionByName(new[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept.schema.fields]))
        own = _write(spark, store, version, name, kept, key, buckets) if touched else []
        own += [(version, *tuple(r)[1:]) for r in rows if r["bucket"] is not None and r["bucket"] not in touched]
        out += own or [_empty(version, name, key, buckets, schema)]
    _publish(spark, store, version, out)
    return version


def replace(spark: SparkSession, store: str, new: Mapping[str, DataFrame]) -> int:
    """In each table of ``new`` the rows of its documents replaced by those, in one version, whose number is returned.

    Only buckets of these documents are read and written. Rows with a null key match none:
    old ones stay and new ones are added. No rows change nothing.
    """
    return _change(spark, store, new, new)


def delete(spark: SparkSession, store: str, gone: DataFrame) -> int:
    """The documents of ``gone`` (the key column) deleted from every table, children and all, in one version."""
    names = {r["table"] for r in _manifest(spark, store)}
    return _change(spark, store, dict.fromkeys(names, gone), {})
