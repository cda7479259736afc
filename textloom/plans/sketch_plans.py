"""Summaries kept by day and merged into weeks and months, held against exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import sketches
from textloom.plans.common import Plans, table
from textloom.session import shared_dir

RANKS = {"median": 0.5, "p95": 0.95}
#: Bounds asserted: more than four standard errors of a distinct count, three times the 99 % bound of a rank.
DISTINCT, RANK = 0.05, 0.02


def spans(s, d):
    """Lines by week and month of shipping, from a written table of days: rows, and whether parts and prices are within bounds."""
    lines = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("double").alias("price"))
    folder = shared_dir(s, "daily-summaries")
    sketches.sketched(lines, ["day"], "part", "price").write.parquet(folder)
    days = s.read.parquet(folder)
    out = []
    for span in ("week", "month"):
        start = F.date_trunc(span, "day").cast("date").alias("start")
        own = sketches.read_out(sketches.merged(days, [start]), RANKS).select("start", F.col("n").alias("merged"), "distinct", *RANKS)
        both = lines.select(start, "part", "price").join(own, "start")
        n = F.count("price")
        held = {name: (F.count_if(F.col("price") < F.col(name)) / n <= rank + RANK) & (F.count_if(F.col("price") <= F.col(name)) / n >= rank - RANK) for name, rank in RANKS.items()}
        exact = both.groupBy("start").agg(F.max("merged").alias("n"), F.count_distinct("part").alias("parts"), F.max("distinct").alias("_d"), *[held[name].alias(f"{name}_within") for name in RANKS])
        within = F.abs(F.col("_d") - F.col("parts")) <= F.col("parts") * DISTINCT
        out.append(exact.select(F.lit(span).alias("span"), "start", "n", "parts", within.alias("parts_within"), *[f"{name}_within" for name in RANKS]))
    return out[0].unionByName(out[1])


_SPAN = "SELECT '{0}' AS span, CAST(date_trunc('{0}', l_shipdate) AS DATE) AS start, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS parts_within, true AS median_within, true AS p95_within FROM lineitem GROUP BY 2"

PLANS: Plans = {"h26_h37_merged_sketches": (spans, f"{_SPAN.format('week')} UNION ALL {_SPAN.format('month')}")}
