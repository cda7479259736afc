"""What the plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: name -> (query, SQL or None)
Plans = dict[str, tuple[Query, str | None]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A small rule table."""
    return spark.createDataFrame(values, schema)
