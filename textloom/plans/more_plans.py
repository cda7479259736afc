"""Responses, lookups, semi joins, set operators, and the report of all stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import responses as P
from textloom.functions import text as X
from textloom.operators import models as M
from textloom.operators import reports as R
from textloom.operators import scoring as S
from textloom.operators import stages
from textloom.plans.common import Plans, rows, table
from textloom.plans.report_plans import _ROUTED, _routed
from textloom.plans.scoring_plans import _MATCHED, ANOMALIES, COMPONENT_SCHEMA, COMPONENTS, _daily, anomalies


TYPES = [("view", "Page view", "A page was seen"), ("click", "Click", "Something was chosen"), ("error", "Error", "Something failed")]


def b15(s, d):
    e = table(s, d, "events")
    whole = F.format_string('{"confidence": %s, "overall_risk": "%s", "summary": "%s"}', (F.col("value") / 100).cast("string"), F.element_at(F.array(*map(F.lit, ("high", "LOW", "odd"))), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_type"))
    raw = F.when(F.col("event_id") % 4 == 0, F.left(whole, F.length(whole) - 1)).when(F.col("event_id") % 4 == 1, F.lit("no json")).otherwise(whole)
    own = e.select("event_id", raw.alias("answer")).select("event_id", P.parse_response(F.col("answer"), 0.8).alias("r"))
    return own.select("event_id", F.round("r.confidence", 6).alias("confidence"), "r.overall_risk", "r.summary", "r.recovered")


def b21(s, d):
    names = rows(s, "event_type string, display string, description string", TYPES)
    own = table(s, d, "events").join(F.broadcast(names), "event_type", "left")
    return own.select("event_id", F.coalesce("display", F.initcap("event_type")).alias("display"), F.coalesce("description", F.lit("")).alias("description"))


def b23(s, d):
    a = anomalies(s, d)
    own = a.groupBy("document_id").agg(F.array_sort(F.collect_set(F.when(F.col("severity") == "high", F.col("indicator")))).alias("high"), F.array_sort(F.collect_set(F.when((F.col("severity") == "medium") & (F.col("category") > 4), F.col("indicator")))).alias("medium"), F.avg("confidence").alias("p"), F.array_sort(F.collect_set("severity")).alias("sev"))
    return own.select("document_id", X.indicator_summary(F.col("high"), F.col("medium")).alias("summary"), P.fallback_explanation(F.col("medium"), F.col("p")).alias("explanation"), P.fallback_level(F.col("sev")).alias("level"))


def g1(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    owned = c.filter("c_mktsegment = 'BUILDING'")
    seen = table(s, d, "lineitem").select("l_orderkey").distinct()
    return o.join(owned, o["o_custkey"] == owned["c_custkey"], "left_semi").join(seen, o["o_orderkey"] == seen["l_orderkey"], "left_semi").select("o_orderkey", "o_custkey")


def g10(s, d):
    config = rows(s, "c_mktsegment string, modifier double, strictness string", [("BUILDING", 3.0, "strict"), ("MACHINERY", 1.5, "normal")])
    own = table(s, d, "customer").join(F.broadcast(config), "c_mktsegment", "left")
    modifier, strict = F.coalesce("modifier", F.lit(1.0)), F.coalesce("strictness", F.lit("default"))
    return own.select("c_custkey", modifier.alias("modifier"), F.concat(F.col("c_mktsegment"), F.lit(": "), strict).alias("expectation"))


def h13(s, d):
    """Anomalies and compounds of each document and day as one list."""
    c = S.compounds(_daily(s, d), rows(s, COMPONENT_SCHEMA, COMPONENTS))
    own = _daily(s, d).select("anomaly_id", "document_id", "severity", "confidence", F.array("indicator").alias("indicators"))
    out = stages.alerts(own.withColumn("confidence_tier", M.tier(F.col("confidence"))), c, "confidence")
    return out.select("anomaly_id", "document_id", "severity", F.round("confidence", 6).alias("confidence"), "confidence_tier", F.array_join("indicators", ",").alias("indicator"), "is_compound")


def h19(s, d):
    """Counts left by each stage, and the final score, for every document."""
    a = anomalies(s, d)
    kept = S.stage_two(F.col("confidence"), F.lit(0.5), F.col("category") + 2.0, F.col("indicator") != "i0")
    own = a.withColumn("s2", kept["kept"]).withColumn("first", F.row_number().over(Window.partitionBy("document_id", "indicator", "category").orderBy("anomaly_id")))
    stages = own.groupBy("document_id").agg(F.count("*").alias("stage1"), F.count_if("s2").alias("stage2"), F.count_if(F.col("s2") & (F.col("first") == 1)).alias("stage3"))
    c = S.compounds(_daily(s, d), rows(s, COMPONENT_SCHEMA, COMPONENTS)).groupBy(F.floor(F.col("document_id") / 100_000).alias("document_id")).agg(F.count("*").alias("stage4"))
    risk = S.document_risk(own.filter("s2")).select("document_id", F.round("risk_score", 6).alias("risk_score"))
    return stages.join(c, "document_id", "left").join(risk, "document_id", "left").select("document_id", "stage1", "stage2", "stage3", F.coalesce("stage4", F.lit(0)).alias("stage4"), F.coalesce("risk_score", F.lit(1.0)).alias("risk_score"))


def h29(s, d):
    """Agreement by class, and in all, with how often the first stage was right."""
    return R.stage_agreement(_routed(s, d)).withColumn("stage1_correct", F.round("stage1_correct", 6))


def i8(s, d):
    a = anomalies(s, d)
    left, right = a.filter("severity = 'high'").select("document_id", "indicator"), a.filter("category < 2").select("document_id", "indicator")
    both = left.intersect(right).withColumn("kind", F.lit("both"))
    return both.unionByName(left.exceptAll(right).distinct().withColumn("kind", F.lit("left"))).unionByName(right.subtract(left).withColumn("kind", F.lit("right")))


_RAW = """
w AS (SELECT event_id, event_type, value / 100 AS c, ['high', 'LOW', 'odd'][event_id % 3 + 1] AS risk, event_id % 4 AS m FROM events),
p AS (SELECT *, CASE WHEN m = 1 THEN 0.5 ELSE c END AS conf, CASE WHEN m = 1 THEN 'medium' WHEN m = 0 AND risk = 'LOW' THEN 'medium' ELSE lower(risk) END AS lv FROM w)"""

PLANS: Plans = {
    "b15_stored_responses": (b15, f"WITH {_RAW} SELECT event_id, round(greatest(0.8, least(1.0, conf)), 6)::DOUBLE AS confidence, CASE WHEN lv IN ('high', 'medium', 'low') THEN lv ELSE 'medium' END AS overall_risk, CASE WHEN m = 1 THEN 'Analysis unavailable' ELSE event_type END AS summary, m < 2 AS recovered FROM p"),
    "b21_display_names": (b21, "SELECT event_id, CASE event_type WHEN 'view' THEN 'Page view' ELSE upper(event_type[1]) || event_type[2:] END AS display, CASE event_type WHEN 'view' THEN 'A page was seen' WHEN 'click' THEN 'Something was chosen' WHEN 'error' THEN 'Something failed' ELSE '' END AS description FROM events"),
    "b23_b24_b25_fallback_texts": (
        b23,
        f"""WITH {ANOMALIES}, g AS (SELECT document_id, list_sort(list(DISTINCT indicator) FILTER (severity = 'high')) AS h, list_sort(list(DISTINCT indicator) FILTER (severity = 'medium' AND category > 4)) AS m, avg(confidence) AS p, count(*) FILTER (severity = 'high') AS nh, count(*) FILTER (severity = 'medium') AS nm FROM a GROUP BY document_id)
SELECT document_id, CASE WHEN coalesce(len(h), 0) + coalesce(len(m), 0) = 0 THEN 'No significant risk indicators' ELSE concat_ws('; ', CASE WHEN len(h) > 0 THEN 'HIGH RISK: ' || array_to_string(h, ', ') END, CASE WHEN len(m) > 0 THEN 'MEDIUM RISK: ' || array_to_string(m, ', ') END) END AS summary,
CASE WHEN len(m) > 0 THEN 'This clause contains: ' || array_to_string(m[1:3], '; ') || '.' ELSE 'This clause is unusual.' END || CASE WHEN p < 0.30 THEN ' It is rare in similar documents.' WHEN p > 0.70 THEN ' It is common in similar documents.' ELSE '' END AS explanation,
CASE WHEN nh > 0 THEN 'high' WHEN nm > 0 THEN 'medium' ELSE 'low' END AS level FROM g""",
    ),
    "g01_g03_owned": (g1, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "g10_dimension_lookup": (g10, "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3.0 WHEN 'MACHINERY' THEN 1.5 ELSE 1.0 END::DOUBLE AS modifier, c_mktsegment || ': ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'strict' WHEN 'MACHINERY' THEN 'normal' ELSE 'default' END AS expectation FROM customer"),
    "h13_i07_compound_alerts": (
        h13,
        f"""WITH {_MATCHED}, al AS (SELECT anomaly_id, document_id, severity, confidence, indicator, false AS is_compound FROM few UNION ALL SELECT NULL, document_id, lower(severity), confidence, pattern, true FROM matched)
SELECT anomaly_id, document_id, severity, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN is_compound OR confidence >= 0.60 THEN 'MODERATE' ELSE 'LOW' END AS confidence_tier, indicator, is_compound FROM al""",
    ),
    "h09_h19_stage_report": (
        h19,
        f"""WITH {_MATCHED}, k AS (SELECT *, indicator <> 'i0' AND (category + 2.0 >= 5 OR 0.7 * confidence + 0.3 * 0.5 >= 0.60) AS s2, row_number() OVER (PARTITION BY document_id, indicator, category ORDER BY anomaly_id) AS f FROM a),
g AS (SELECT document_id, count(*) AS stage1, count(*) FILTER (s2) AS stage2, count(*) FILTER (s2 AND f = 1) AS stage3 FROM k GROUP BY document_id),
c AS (SELECT document_id // 100000 AS document_id, count(*) AS stage4 FROM matched GROUP BY 1),
r AS (SELECT document_id, round(greatest(1.0, least(10.0, least(count(*) / 2, 4.0) + least(0.75 * count(*) FILTER (severity = 'high') + 0.35 * count(*) FILTER (severity = 'medium') + 0.15 * count(*) FILTER (severity = 'low'), 4.0) + least(0.5 * count(DISTINCT category), 2.0)))::DOUBLE, 6) AS risk_score FROM k WHERE s2 GROUP BY document_id)
SELECT document_id, stage1, stage2, stage3, coalesce(stage4, 0) AS stage4, coalesce(risk_score, 1.0) AS risk_score FROM g LEFT JOIN c USING (document_id) LEFT JOIN r USING (document_id)""",
    ),
    "h29_stage_agreement": (h29, f"WITH {_ROUTED} SELECT coalesce(agreement, 'all') AS agreement, count(*) AS n, count(*) FILTER (final_risk = 'high') AS high, count(*) FILTER (final_risk = 'medium') AS medium, count(*) FILTER (final_risk = 'low') AS low, round(count(*) FILTER (agreement <> 'refined') / count(*), 6)::DOUBLE AS stage1_correct FROM routed GROUP BY ROLLUP (agreement)"),
    "i08_i09_i10_set_operators": (i8, f"WITH {ANOMALIES}, l AS (SELECT DISTINCT document_id, indicator FROM a WHERE severity = 'high'), r AS (SELECT DISTINCT document_id, indicator FROM a WHERE category < 2) SELECT *, 'both' AS kind FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l) UNION ALL SELECT DISTINCT *, 'left' FROM (SELECT document_id, indicator FROM a WHERE severity = 'high' EXCEPT ALL SELECT document_id, indicator FROM a WHERE category < 2)"),
}
