"""Scores over events, which stand for anomalies: type for severity, user for document, value for confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import scoring as S
from textloom.plans.common import Plans, rows, table
from textloom.rules import fixed

COMPONENTS = [
    ("lock_in", "i1", True, "HIGH", 2.5),
    ("lock_in", "i2", True, "HIGH", 2.5),
    ("lock_in", "i3", False, "HIGH", 2.5),
    ("lock_in", "i4", False, "HIGH", 2.5),
    ("rights", "i5", True, "CRITICAL", 2.8),
    ("rights", "i6", False, "CRITICAL", 2.8),
    ("costs", "i7", True, "MEDIUM", 1.2),
    ("costs", "i8", True, "MEDIUM", 1.2),
    ("costs", "i9", True, "MEDIUM", 1.2),
]
COMPONENT_SCHEMA = "pattern string, indicator string, required boolean, severity string, multiplier double"
TIER_SCHEMA = "days_min int, days_max int, modifier double, label string"


def anomalies(s, d):
    """events as anomalies."""
    e = table(s, d, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    k = F.from_json("props", "k int")["k"]
    return e.select(F.col("event_id").alias("anomaly_id"), F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("created_at"), severity.alias("severity"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), (F.coalesce(k, F.lit(0)) % 7).alias("category"), F.concat(F.lit("i"), (F.coalesce(k, F.lit(0)) % 10).cast("string")).alias("indicator"))


ANOMALIES = """
a AS (SELECT event_id AS anomaly_id, user_id AS document_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity,
  least(value / 500, 1.0) AS confidence, CAST(json_extract(props, '$.k') AS INT) % 7 AS category, 'i' || (CAST(json_extract(props, '$.k') AS INT) % 10) AS indicator FROM events)"""


def h1(s, d):
    a = anomalies(s, d)
    high, medium = (F.when(F.col("severity") == x, F.col("category")).otherwise(0) for x in ("high", "medium"))
    p = S.pattern_confidence(high, medium)
    own = S.stage_one(p, F.when(F.col("category") > 2, F.col("confidence")), F.when(F.col("anomaly_id") % 2 == 0, F.lit(0.8)))
    return a.select("anomaly_id", F.round(p, 6).alias("pattern_confidence"), F.round(own, 6).alias("stage1_confidence"), S.clause_severity(high, medium, F.col("confidence")).alias("clause_severity"))


def h3(s, d):
    a = anomalies(s, d)
    own = S.industry_score(F.when(F.col("severity") == "high", 8.0).otherwise(5.0), F.col("confidence"), F.col("category") < 2, F.col("indicator") == "i3")
    terms = F.when(F.col("indicator") == "i3", F.array("indicator", "severity"))
    said = S.industry_reasoning(F.concat(F.lit("industry "), "category"), F.when(F.col("severity") == "high", 8.0).otherwise(5.0), F.col("confidence"), F.col("indicator"), F.col("category") < 2, terms)
    return a.select("anomaly_id", own.alias("x"), said.alias("reasoning")).select("anomaly_id", F.col("x.score").alias("score"), F.col("x.adjustments").alias("adjustments"), "reasoning")


def h4(s, d):
    a = anomalies(s, d)
    arr = lambda *x: F.array(*map(F.lit, x))
    own = S.service_decision(F.col("indicator"), arr("i1", "i2-x", "i9"), arr("i3", "pre_i4"), arr("i2_x"), F.col("confidence") > 0.5, F.col("document_id") % 10 != 0)
    out = a.select("anomaly_id", "indicator", "severity", own.alias("x")).select("anomaly_id", "indicator", "severity", "x.*")
    return out.withColumn("reason", S.service_reason(F.col("classification"), F.col("indicator"), F.col("severity"))).drop("indicator", "severity")


def h5(s, d):
    o = table(s, d, "orders")
    own = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate").cast("date")).alias("effective_date"), F.lit(None).cast("date").alias("last_modified"), (F.col("o_orderstatus") != "F").alias("is_change"), (F.col("o_totalprice") / 100000).alias("score"))
    out = S.temporal(own, rows(s, TIER_SCHEMA, list(fixed.DECAY_TIERS)), F.lit("1998-06-01").cast("date"))
    return out.select("o_orderkey", F.col("days").cast("long").alias("days"), "factor", F.round("adjusted", 8).alias("adjusted"), "age", "very_old", "priority", F.col("label").alias("tier"))


def h6(s, d):
    days = table(s, d, "lineitem").select(F.datediff(F.lit("1998-06-01").cast("date"), F.col("l_shipdate").cast("date")).alias("days")).distinct()
    return S.with_tier(days, rows(s, TIER_SCHEMA, list(fixed.DECAY_TIERS))).select(F.col("days").cast("long").alias("days"), "modifier", "label", (F.col("modifier") * 2.0).alias("expected"))


def h8(s, d):
    a = anomalies(s, d)
    own = S.stage_two(F.col("confidence"), F.when(F.col("category") < 3, 0.1).otherwise(0.9), F.col("category") + 2.0, F.col("indicator") != "i0")
    return a.select("anomaly_id", own.alias("x")).select("anomaly_id", F.round("x.stage2_confidence", 6).alias("stage2_confidence"), F.col("x.kept").alias("kept"))


def _daily(s, d):
    """Anomalies of a document and day as those of one document, so that not every one has all indicators."""
    own = anomalies(s, d)
    return own.withColumn("document_id", F.col("document_id") * 100_000 + F.datediff(F.to_date("created_at"), F.lit("2020-01-01").cast("date")))


def g6(s, d):
    own = S.compounds(_daily(s, d), rows(s, COMPONENT_SCHEMA, COMPONENTS))
    return own.withColumn("confidence", F.round("confidence", 6))


def g7(s, d):
    c = rows(s, COMPONENT_SCHEMA, COMPONENTS)
    return S.component_matches(_daily(s, d), S.compounds(_daily(s, d), c), c)


def h11(s, d):
    return S.compound_document_score(S.compounds(_daily(s, d), rows(s, COMPONENT_SCHEMA, COMPONENTS)))


def _scored(s, d):
    a = anomalies(s, d)
    rel = S.relevance(F.col("category").cast("string"), F.col("severity"), ["1", "2"], "high")
    own = S.alert_score(F.col("severity"), F.col("confidence"), rel, F.col("indicator") == "i1", F.col("anomaly_id") % 5 == 0, F.col("indicator").isin("i2", "i3"), F.col("category") == 4)
    tier = F.when(F.col("confidence") >= 0.5, "HIGH").when(F.col("confidence") >= 0.2, "MODERATE").otherwise("LOW")
    return a.withColumn("x", own).select("*", F.round("x.ranking_score", 6).alias("ranking_score"), F.round("x.base", 6).alias("base"), F.col("x.bonus").alias("bonus"), tier.alias("confidence_tier")).drop("x")


def h12(s, d):
    return _scored(s, d).select("anomaly_id", "ranking_score", "base", "bonus")


def _ranked(s, d):
    return S.budget(_scored(s, d), target=5, most=12)


def h14(s, d):
    return _ranked(s, d).select("anomaly_id", "document_id", "confidence_tier", "shown")


def h15(s, d):
    own = S.ranking_summary(_ranked(s, d))
    return own.withColumns({c: F.round(c, 6) for c in ("suppression_rate", "mean_score")})


def h15b(s, d):
    return S.top_categories(_ranked(s, d)).select("document_id", "category", F.col("count").alias("n"), "place")


def h16(s, d):
    a = anomalies(s, d)
    n = lambda x: F.count_if(F.col("severity") == x)
    own = a.groupBy("document_id", F.to_date("created_at").alias("day")).agg(F.round(S.overall_risk(n("high"), n("medium"), n("low"), F.count_if(F.col("indicator") == "i1"), F.avg("confidence")), 6).alias("overall_risk"))
    return own


def h17(s, d):
    """Risk of every customer as a document and month, with those that have no anomaly."""
    month = F.date_format("created_at", "yyyy-MM-dd")
    own = anomalies(s, d).withColumn("document_id", F.concat_ws(" ", F.col("document_id").cast("string"), month))
    docs = own.select("document_id").unionByName(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("document_id"))).distinct()
    out = S.document_risk_report(docs, own)
    return out.withColumns({c: F.round(c, 6) for c in ("by_count", "by_severity", "by_variety", "risk_score")})


def h18(s, d):
    return S.top_concerns(anomalies(s, d)).select("document_id", "place", "anomaly_id", "severity")


def h18b(s, d):
    """The report of each document and day: anomalies by severity and category, the top concerns."""
    return S.document_report(_daily(s, d))


_FEW = f"{ANOMALIES}, few AS (SELECT * REPLACE (document_id * 100000 + date_diff('day', DATE '2020-01-01', CAST(created_at AS DATE)) AS document_id) FROM a), comp AS (SELECT * FROM (VALUES {', '.join(str(c) for c in COMPONENTS)}) t(pattern, indicator, required, severity, multiplier))"
_MATCHED = f"""{_FEW},
hit AS (SELECT DISTINCT document_id, pattern, c.indicator, required, c.severity, multiplier FROM few JOIN comp c USING (indicator)),
m AS (SELECT document_id, pattern, any_value(severity) AS severity, CAST(any_value(multiplier) AS DOUBLE) AS multiplier, coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (required), '') AS required_found, coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (NOT required), '') AS optional_found, count(*) FILTER (NOT required) AS optional
  FROM hit h GROUP BY document_id, pattern HAVING count(*) FILTER (required) = (SELECT count(*) FROM comp c WHERE c.pattern = h.pattern AND required)),
matched AS (SELECT *, round(0.70 + least(0.05 * optional, 0.30), 6)::DOUBLE AS confidence, round(least(CASE severity WHEN 'LOW' THEN 2.0 WHEN 'MEDIUM' THEN 5.0 WHEN 'HIGH' THEN 7.0 ELSE 9.0 END * multiplier + 0.5 * optional, 10.0), 1)::DOUBLE AS combined_score FROM m)"""
_SCORED = f"""{ANOMALIES},
sc AS (SELECT *, CASE severity WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.0 END::DOUBLE * confidence * CASE WHEN category IN (1, 2) THEN 1.5 WHEN severity = 'high' THEN 1.3 ELSE 1.0 END::DOUBLE AS b,
  (CASE WHEN indicator = 'i1' THEN 5.0 ELSE 0 END + CASE WHEN anomaly_id % 5 = 0 THEN 2.0 ELSE 0 END + CASE WHEN indicator IN ('i2', 'i3') THEN 1.5 ELSE 0 END + CASE WHEN category = 4 THEN 3.0 ELSE 0 END)::DOUBLE AS bonus,
  CASE WHEN confidence >= 0.5 THEN 'HIGH' WHEN confidence >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS confidence_tier FROM a),
scored AS (SELECT *, round(b + bonus, 6) AS ranking_score, round(b, 6) AS base FROM sc)"""
#: The budget as queues: overflow of a tier stands before the next tier's own.
_RANKED = f"""{_SCORED},
q0 AS (SELECT *, row_number() OVER (PARTITION BY document_id, confidence_tier ORDER BY ranking_score DESC, anomaly_id) AS r FROM scored),
q1 AS (SELECT *, confidence_tier = 'HIGH' AND r <= 5 AS is_high FROM q0),
q2 AS (SELECT *, 12 - count(*) FILTER (is_high) OVER (PARTITION BY document_id) AS room, CASE WHEN NOT is_high AND confidence_tier <> 'LOW' THEN row_number() OVER (PARTITION BY document_id, NOT is_high AND confidence_tier <> 'LOW' ORDER BY confidence_tier, r) END AS q FROM q1),
q3 AS (SELECT *, q <= room AS is_medium FROM q2),
q4 AS (SELECT *, room - count(*) FILTER (is_medium) OVER (PARTITION BY document_id) AS room2, row_number() OVER (PARTITION BY document_id, is_high OR coalesce(is_medium, false) ORDER BY CASE confidence_tier WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 ELSE 2 END, r) AS l FROM q3),
ranked AS (SELECT *, CASE WHEN is_high THEN 'high' WHEN is_medium THEN 'medium' WHEN l <= room2 THEN 'low' ELSE 'suppressed' END AS shown FROM q4)"""
_TIER = "CASE WHEN {0} BETWEEN 0 AND 30 THEN 3.0 WHEN {0} BETWEEN 31 AND 60 THEN 2.0 WHEN {0} BETWEEN 61 AND 90 THEN 1.5 ELSE 1.0 END::DOUBLE"
_LABEL = "CASE WHEN {0} BETWEEN 0 AND 30 THEN 'Recent change, heightened scrutiny' WHEN {0} BETWEEN 31 AND 60 THEN 'Recent change, elevated scrutiny' WHEN {0} BETWEEN 61 AND 90 THEN 'Recent change, increased scrutiny' WHEN {0} > 90 THEN 'Standard scrutiny' END"

PLANS: Plans = {
    "h01_h02_stage_one": (
        h1,
        f"""WITH {ANOMALIES}, n AS (SELECT *, CASE severity WHEN 'high' THEN category ELSE 0 END AS hi, CASE severity WHEN 'medium' THEN category ELSE 0 END AS md FROM a),
p AS (SELECT *, CASE WHEN hi + md > 0 THEN least(1.0, 0.5 + 0.2 * hi + 0.1 * md) ELSE 0.0 END::DOUBLE AS p FROM n)
SELECT anomaly_id, round(p, 6) AS pattern_confidence, round(0.40 * p + 0.35 * CASE WHEN category > 2 THEN confidence ELSE 0 END + 0.25 * CASE WHEN anomaly_id % 2 = 0 THEN 0.8 ELSE 0 END, 6) AS stage1_confidence,
CASE WHEN hi > 0 THEN 'high' WHEN md > 0 THEN 'medium' WHEN confidence < 0.30 THEN 'low' ELSE 'medium' END AS clause_severity FROM p""",
    ),
    "h03_industry_modifier": (
        h3,
        f"""WITH {ANOMALIES} SELECT anomaly_id, round(least(CASE severity WHEN 'high' THEN 8.0 ELSE 5.0 END * CASE WHEN confidence >= 0.70 THEN 0.5 WHEN confidence < 0.30 THEN 1.3 ELSE 1.0 END * CASE WHEN category < 2 THEN 1.5 ELSE 1.0 END * CASE WHEN indicator = 'i3' THEN 1.5 ELSE 1.0 END, 10.0)::DOUBLE, 2) AS score,
concat_ws(',', CASE WHEN confidence >= 0.70 THEN 'common' END, CASE WHEN confidence < 0.30 THEN 'rare' END, CASE WHEN category < 2 THEN 'strict' END, CASE WHEN indicator = 'i3' THEN 'prohibited' END) AS adjustments,
concat_ws('. ', printf('{fixed.INDUSTRY_REASONS["industry"]}', 'industry ' || category), CASE WHEN confidence >= 0.70 THEN printf('{fixed.INDUSTRY_REASONS["common"]}', 'industry ' || category, CAST(floor(confidence * 100 + 0.5) AS INT)) END,
  CASE WHEN confidence < 0.30 THEN printf('{fixed.INDUSTRY_REASONS["rare"]}', 'industry ' || category, CAST(floor(confidence * 100 + 0.5) AS INT)) END, CASE WHEN category < 2 THEN printf('{fixed.INDUSTRY_REASONS["strict"]}', indicator, 'industry ' || category) END,
  CASE WHEN indicator = 'i3' THEN printf('{fixed.INDUSTRY_REASONS["prohibited"]}', 'industry ' || category, 'i3, ' || severity) END,
  CASE WHEN CASE severity WHEN 'high' THEN 8.0 ELSE 5.0 END * CASE WHEN confidence >= 0.70 THEN 0.5 WHEN confidence < 0.30 THEN 1.3 ELSE 1.0 END * CASE WHEN category < 2 THEN 1.5 ELSE 1.0 END * CASE WHEN indicator = 'i3' THEN 1.5 ELSE 1.0 END > 10 THEN '{fixed.INDUSTRY_REASONS["capped"]}' END) || '.' AS reasoning FROM a""",
    ),
    "h04_service_context": (
        h4,
        f"""WITH {ANOMALIES}, c AS (SELECT anomaly_id, indicator, severity, CASE WHEN document_id % 10 = 0 THEN 'unknown_service' WHEN indicator IN ('i3', 'i4') THEN 'alarming' WHEN indicator = 'i2' AND confidence > 0.5 THEN 'expected_disclosed' WHEN indicator = 'i2' THEN 'expected_unclear' WHEN indicator IN ('i1', 'i9') THEN 'expected' ELSE 'neutral' END AS classification FROM a)
SELECT anomaly_id, classification NOT IN ('expected', 'expected_disclosed') AS keep, CASE classification WHEN 'alarming' THEN 0.1 WHEN 'expected' THEN 0.9 WHEN 'expected_disclosed' THEN 0.9 ELSE 0.5 END::DOUBLE AS context_confidence, classification,
CASE classification {" ".join(f"WHEN '{k}' THEN printf('{v}', indicator, severity)" for k, v in fixed.SERVICE_REASONS.items())} ELSE printf('{fixed.SERVICE_UNKNOWN}', severity) END AS reason FROM c""",
    ),
    "g09_h05_h07_temporal": (
        h5,
        f"""
WITH o AS (SELECT o_orderkey, date_diff('day', CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, DATE '1998-06-01') AS days, o_orderstatus <> 'F' AS ch, o_totalprice / 100000 AS score FROM orders),
f AS (SELECT *, CASE WHEN days IS NULL OR days < 0 OR NOT ch THEN 1.0::DOUBLE ELSE {_TIER.format('days')} END AS factor FROM o)
SELECT o_orderkey, days, factor, round(score * factor, 8) AS adjusted, CASE WHEN days IS NULL THEN 'unknown date' WHEN days < 0 THEN 'future date' WHEN days < 14 THEN days || ' days ago' WHEN days < 60 THEN days // 7 || ' weeks ago' WHEN days < 730 THEN days // 30 || ' months ago' ELSE days // 365 || ' years ago' END AS age,
coalesce(days > 1825, false) AS very_old, CASE WHEN score * factor >= 8 THEN 'CRITICAL' WHEN score * factor >= 6 THEN 'HIGH' WHEN score * factor >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS priority, {_LABEL.format('days')} AS tier FROM f""",
    ),
    "h06_decay_curve": (h6, f"WITH d AS (SELECT DISTINCT date_diff('day', CAST(l_shipdate AS DATE), DATE '1998-06-01') AS days FROM lineitem) SELECT days, {_TIER.format('days')} AS modifier, {_LABEL.format('days')} AS label, 2.0 * {_TIER.format('days')} AS expected FROM d"),
    "h08_stage_two": (h8, f"WITH {ANOMALIES}, c AS (SELECT *, 0.7 * confidence + 0.3 * (1 - CASE WHEN category < 3 THEN 0.1 ELSE 0.9 END) AS s2 FROM a) SELECT anomaly_id, round(s2::DOUBLE, 6) AS stage2_confidence, indicator <> 'i0' AND (category + 2.0 >= 5 OR s2 >= 0.60) AS kept FROM c"),
    "g06_h10_compounds": (g6, f"WITH {_MATCHED} SELECT * FROM matched"),
    "g07_g08_component_matches": (g7, f"WITH {_MATCHED} SELECT few.document_id, pattern, anomaly_id, string_agg(DISTINCT few.indicator, ',' ORDER BY few.indicator) AS shared FROM few JOIN comp c ON c.indicator = few.indicator SEMI JOIN matched m ON m.document_id = few.document_id AND m.pattern = c.pattern GROUP BY ALL"),
    "h11_compound_document": (
        h11,
        f"""WITH {_MATCHED}, s AS (SELECT document_id, least(sum(CASE severity WHEN 'CRITICAL' THEN 4.0 WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 1.5 ELSE 0.5 END), 10.0)::DOUBLE AS compound_score, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS patterns, string_agg(pattern, ',' ORDER BY pattern) AS pattern_list FROM matched GROUP BY document_id)
SELECT *, CASE WHEN compound_score >= 7 OR critical > 0 THEN 'Critical' WHEN compound_score >= 5 OR high >= 2 THEN 'High' WHEN compound_score >= 3 OR high >= 1 THEN 'Medium' WHEN compound_score > 0 THEN 'Low' ELSE 'None' END AS level FROM s""",
    ),
    "h12_h13_alert_score": (h12, f"WITH {_SCORED} SELECT anomaly_id, ranking_score, base, bonus FROM scored"),
    "h14_alert_budget": (h14, f"WITH {_RANKED} SELECT anomaly_id, document_id, confidence_tier, shown FROM ranked"),
    "h15_ranking_summary": (h15, f"WITH {_RANKED} SELECT document_id, count(*) AS total, count(*) FILTER (shown <> 'suppressed') AS shown, round(count(*) FILTER (shown = 'suppressed') / count(*), 6) AS suppression_rate, round(avg(ranking_score), 6) AS mean_score, max(ranking_score) AS top_score FROM ranked GROUP BY document_id"),
    "h15_top_categories": (h15b, f"WITH {_RANKED}, c AS (SELECT document_id, category, count(*) AS n FROM ranked WHERE shown <> 'suppressed' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, category) AS place FROM c) SELECT * FROM p WHERE place <= 5"),
    "h16_overall_risk": (h16, f"WITH {ANOMALIES} SELECT document_id, CAST(created_at AS DATE) AS day, round(CAST(greatest(1.0, least(10.0, least(3 * count(*) FILTER (severity = 'high') + 2 * count(*) FILTER (severity = 'medium') + count(*) FILTER (severity = 'low') + 2.5 * count(*) FILTER (indicator = 'i1'), 30.0) / 3 + (avg(confidence) - 0.5) * 2)) AS DOUBLE), 6) AS overall_risk FROM a GROUP BY ALL"),
    "h17_document_risk": (
        h17,
        f"""WITH {ANOMALIES}, k AS (SELECT document_id || ' ' || strftime(created_at, '%Y-%m-%d') AS document_id, severity, category FROM a),
ds AS (SELECT document_id FROM k UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer),
g AS (SELECT document_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(DISTINCT category) AS categories FROM k GROUP BY document_id),
p AS (SELECT document_id, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(categories, 0) AS categories, round(least(coalesce(n, 0) / 2, 4.0), 6)::DOUBLE AS by_count, round(least(0.75 * coalesce(high, 0) + 0.35 * coalesce(medium, 0) + 0.15 * coalesce(low, 0), 4.0)::DOUBLE, 6) AS by_severity, least(0.5 * coalesce(categories, 0), 2.0)::DOUBLE AS by_variety FROM ds LEFT JOIN g USING (document_id)),
q AS (SELECT *, round(greatest(1.0, least(10.0, by_count + by_severity + by_variety))::DOUBLE, 6) AS risk_score FROM p)
SELECT *, CASE WHEN risk_score >= 7 THEN 'High' WHEN risk_score >= 4 THEN 'Medium' ELSE 'Low' END AS risk_level, CASE WHEN n = 0 THEN 'Low Risk' WHEN risk_score >= 7 THEN 'High Risk' WHEN risk_score >= 4 THEN 'Medium Risk' ELSE 'Low to Medium Risk' END AS risk_label FROM q""",
    ),
    "h18_top_concerns": (h18, f"WITH {ANOMALIES}, w AS (SELECT *, bool_or(severity = 'high') OVER (PARTITION BY document_id) AS has FROM a), r AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, anomaly_id) AS place, anomaly_id, severity FROM w WHERE severity = 'high' OR (NOT has AND severity = 'medium')) SELECT * FROM r WHERE place <= 3"),
    "h18_document_report": (
        h18b,
        f"""WITH {_FEW}, w AS (SELECT *, bool_or(severity = 'high') OVER (PARTITION BY document_id) AS has FROM few),
t AS (SELECT document_id, anomaly_id, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, anomaly_id) AS place FROM w WHERE severity = 'high' OR (NOT has AND severity = 'medium')),
tc AS (SELECT document_id, string_agg(anomaly_id, ',' ORDER BY place) AS top FROM t WHERE place <= 3 GROUP BY document_id),
c AS (SELECT document_id, category, count(*) AS n FROM few GROUP BY ALL), cs AS (SELECT document_id, string_agg(category || ': ' || n, ', ' ORDER BY category) AS by_category FROM c GROUP BY document_id),
g AS (SELECT document_id, count(*) AS total, coalesce(string_agg(anomaly_id, ',' ORDER BY anomaly_id) FILTER (severity = 'high'), '') AS high_ids, coalesce(string_agg(anomaly_id, ',' ORDER BY anomaly_id) FILTER (severity = 'medium'), '') AS medium_ids, count(*) FILTER (severity = 'low') AS low FROM few GROUP BY document_id)
SELECT g.*, by_category, coalesce(top, '') AS top_concerns FROM g JOIN cs USING (document_id) LEFT JOIN tc USING (document_id)""",
    ),
}
