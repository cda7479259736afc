"""Stored model responses and texts made from indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("high", "medium", "low")


def parse_response(raw: Column, least: float = 0.0) -> Column:
    """``confidence`` (``least`` to 1), ``overall_risk``, ``summary``, ``recovered``: from JSON, or by patterns from broken JSON, or defaults."""
    own = F.from_json(raw, "confidence double, overall_risk string, summary string")
    whole = own["confidence"].isNotNull() & own["overall_risk"].isNotNull() & own["summary"].isNotNull()
    number = F.nullif(F.regexp_extract(raw, '"confidence"\\s*:\\s*([0-9.eE+-]+)', 1), F.lit("")).try_cast("double")
    risk = F.nullif(F.regexp_extract(raw, '"overall_risk"\\s*:\\s*"([a-z]+)"', 1), F.lit(""))
    said = F.nullif(F.regexp_extract(raw, '"summary"\\s*:\\s*"([^"]*)"', 1), F.lit(""))
    confidence = F.greatest(F.lit(least), F.least(F.lit(1.0), F.when(whole, own["confidence"]).otherwise(F.coalesce(number, F.lit(0.5)))))
    level = F.lower(F.when(whole, own["overall_risk"]).otherwise(F.coalesce(risk, F.lit("medium"))))
    return F.struct(confidence.alias("confidence"), F.when(level.isin(*LEVELS), level).otherwise("medium").alias("overall_risk"), F.when(whole, own["summary"]).otherwise(F.coalesce(said, F.lit("Analysis unavailable"))).alias("summary"), (~whole).alias("recovered"))


def fallback_explanation(descriptions: Column, prevalence: Column) -> Column:
    """The first three descriptions and how rare the clause is."""
    named = F.array_join(F.slice(descriptions, 1, 3), "; ")
    head = F.when(F.size(descriptions) > 0, F.concat(F.lit("This clause contains: "), named, F.lit("."))).otherwise("This clause is unusual.")
    return F.concat(head, F.when(prevalence < 0.30, " It is rare in similar documents.").when(prevalence > 0.70, " It is common in similar documents.").otherwise(""))


def fallback_level(severities: Column) -> Column:
    return F.when(F.exists(severities, lambda s: s == "high"), "high").when(F.exists(severities, lambda s: s == "medium"), "medium").otherwise("low")
