"""Mergeable summaries: distinct counts and quantiles of small spans that add up to those of large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the counters of a distinct count: a relative standard error of 1.04 / sqrt(2 ** LG), 1.1 %.
LG = 13
#: Size of a quantile summary: with 99 % a rank is off by less than about 0.007.
K = 400


def sketched(rows: DataFrame, by: list[str], distinct: str, value: str, lg: int = LG, k: int = K) -> DataFrame:
    """``by``, ``n`` rows, ``ids`` (distinct ``distinct``: integer, string or binary) and ``values`` (quantiles of ``value``) as binary summaries.

    Partial summaries are made before the shuffle, so a day that holds most rows moves a few
    kilobytes for each task. Nulls count in ``n`` only; a group without values has an empty summary.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, lg).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("values"))


def merged(summaries: DataFrame, by: list[str | Column]) -> DataFrame:
    """Summaries of larger spans, from those of smaller ones that don't overlap; they can be merged again."""
    return summaries.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("values").alias("values"))


def read_out(summaries: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """Summaries as numbers: ``distinct``, and a quantile (null without values) for each name of ``ranks``."""
    some = F.kll_sketch_get_n_double("values") > 0
    found = {name: F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(rank))) for name, rank in ranks.items()}
    return summaries.withColumns({"distinct": F.hll_sketch_estimate("ids"), **found}).drop("ids", "values")
