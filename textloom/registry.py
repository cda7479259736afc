"""Queries over the given tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import detail_plans, keyword_plans, model_plans, more_plans, paging_plans, report_plans, scoring_plans, sketch_plans, source_plans, stage_plans, structure_plans, text_plans, vector_plans
from textloom.plans.common import Plans, Query


def plans() -> Plans:
    found: Plans = {}
    for part in (text_plans, structure_plans, scoring_plans, vector_plans, report_plans, source_plans, more_plans, model_plans, stage_plans, detail_plans, keyword_plans, paging_plans, sketch_plans):
        found |= part.PLANS
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in plans().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_plans.flagship(spark, sf_dir)
