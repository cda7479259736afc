"""Reports, models and constraint checks over events, labels, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import models as M
from textloom.operators import reports as R
from textloom.plans.common import Plans, table
from textloom.plans.scoring_plans import ANOMALIES, anomalies
from textloom.plans.text_plans import COMMON_WORDS
from textloom.rules import fixed


def docs(s, d):
    return table(s, d, "documents")


def feedback(s, d):
    a = anomalies(s, d)
    action = F.element_at(F.array(*map(F.lit, ("helpful", "acted_on", "dismissed", "false_positive", "unknown"))), (F.col("anomaly_id") % 5 + 1).cast("int"))
    return M.labelled_feedback(a.withColumn("user_action", action).withColumn("confidence", F.col("confidence") * 1.05))


def outcomes(s, d):
    """Labels with a confidence made from the text's length."""
    own = table(s, d, "labels").join(docs(s, d), "doc_id")
    return own.select("doc_id", F.col("quality").cast("double").alias("actual"), (F.pmod(F.length("text"), F.lit(101)) / 100.0).alias("predicted"))


def a4(s, d):
    o = table(s, d, "orders")
    rules = {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice").between(1000, 450000), "priority": F.length("o_orderpriority") <= 10}
    bad = o.select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(~p, n) for n, p in rules.items()]))).alias("violation"))
    orphans = o.join(table(s, d, "customer").filter("c_custkey % 7 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", F.lit("customer").alias("violation"))
    return bad.unionByName(orphans)


def a5(s, d):
    e = table(s, d, "events")
    raw = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props"))
    return e.select("event_id", F.coalesce(F.from_json(raw, "k int")["k"], F.lit(-1)).alias("k"))


def a5_open(s, d):
    """Properties of any shape: scalars, arrays and objects by path; a broken row, or one without the path, gives an empty array."""
    e = table(s, d, "events")
    nested = F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", "x"], "at": [{"u": '), F.col("user_id").cast("string"), F.lit("}]}"))
    raw = F.when(F.col("event_id") % 9 == 0, "{broken").when(F.col("event_id") % 9 == 1, F.col("props")).otherwise(nested)
    return X.open_json(e.select("event_id", raw.alias("raw")), "raw", {"k": ("$.p.k", "int"), "first_user": ("$.at[0].u", "long")}, {"tags": "$.tags"}).select(
        "event_id", "valid", "k", "first_user", F.array_join("tags", ",").alias("tags"), F.size("tags").alias("n_tags")
    )


def a9(s, d):
    e = table(s, d, "embeddings").withColumn("namespace", (F.col("vec_id") % 3).cast("string"))
    return e.rollup("namespace").agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("documents")).withColumn("namespace", F.coalesce("namespace", F.lit("total")))


def a11(s, d):
    done = docs(s, d).filter("doc_id % 4 = 0").select("doc_id", F.lit(True).alias("done"))
    own = docs(s, d).join(done, "doc_id", "left")
    status = F.when(F.col("done"), "skipped").when(F.length("text") < 500, "failed").otherwise("success")
    return own.select("doc_id", status.alias("status"), F.when(status == "failed", "text_too_short").alias("reason"), F.length("text").alias("chars"))


def a12(s, d):
    n = a11(s, d)
    ok = F.col("status") == "success"
    chunks = F.ceil(F.col("chars") / 2000)
    return n.agg(F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(ok, chunks)).alias("chunks"), F.round(F.avg(F.when(ok, chunks)), 6).alias("mean_chunks"), F.round(F.sum(F.when(ok, chunks)) / 1000 * 0.02, 6).alias("embedding_cost"))


def f7(s, d):
    return M.reliability(outcomes(s, d), "predicted", "actual").select("bin", "n", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("mean_actual", 6).alias("mean_actual"))


def f10(s, d):
    a = anomalies(s, d).select("anomaly_id", F.when(F.col("anomaly_id") % 3 == 0, 0.0).otherwise(F.col("confidence")).alias("calibrated"), F.when(F.col("anomaly_id") % 2 == 0, F.col("confidence") / 2).alias("second"), F.lit(0.9).alias("first"))
    return M.uncertain(a, 25, "anomaly_id", "calibrated", "second", "first").select("anomaly_id", F.round("uncertainty", 6).alias("uncertainty"))


def f11(s, d):
    return feedback(s, d).select("anomaly_id", "user_action", "was_correct", "is_valid")


def f12(s, d):
    own = M.feedback_statistics(feedback(s, d).filter("is_valid"))
    return own.select("size", "progress", F.round("dismissal_rate", 6).alias("dismissal_rate"), F.round("accuracy", 6).alias("accuracy"))


def f13(s, d):
    return anomalies(s, d).select("anomaly_id", M.should_collect(F.col("confidence"), F.col("anomaly_id")).alias("collect"))


def f14(s, d):
    return M.generations(feedback(s, d).filter("is_valid"), ["created_at", "anomaly_id"], "document_id", 50)


def h21(s, d):
    a = anomalies(s, d).withColumn("section", F.concat(F.lit("Section "), F.col("category").cast("string"))).withColumn("prevalence", F.col("confidence"))
    return R.anomaly_list(a, None, "SECTION 3", 5, 40).select("anomaly_id", "severity", "section")


def h22(s, d):
    return R.severity_counts(anomalies(s, d))


def h23(s, d):
    own = R.with_counts(table(s, d, "customer").select(F.col("c_custkey").alias("document_id")), anomalies(s, d))
    return R.page(own, [F.desc("anomalies"), "document_id"], 10, 50)


def h24(s, d):
    own = R.global_metrics(docs(s, d), anomalies(s, d), feedback(s, d))
    return own.withColumns({c: F.round(c, 6) for c in ("dismissal_rate", "alerts_per_document")})


def h25(s, d):
    return R.top_flags(anomalies(s, d), "indicator").withColumnRenamed("count", "n")


def h26(s, d):
    own = R.daily_metrics(anomalies(s, d).withColumn("seconds", F.col("confidence") * 60))
    return own.withColumns({c: F.round(c, 6) for c in ("alerts_per_document", "p95")})


AS_OF = "2024-01-31"


def h37(s, d):
    own = R.weekly_trend(anomalies(s, d), F.lit(AS_OF).cast("date"), 6)
    return own.withColumn("alerts_per_document", F.round("alerts_per_document", 6))


def h38(s, d):
    return R.trend_direction(R.weekly_trend(anomalies(s, d), F.lit(AS_OF).cast("date"), 6))


def _routed(s, d):
    a = anomalies(s, d)
    first = a.select("anomaly_id", "confidence", F.col("severity").alias("risk"), F.lit(0.001).alias("cost"))
    second = a.filter("anomaly_id % 3 <> 0").select("anomaly_id", F.lit(0.9).alias("confidence"), F.when(F.col("category") > 3, "high").otherwise("low").alias("risk"), F.lit(0.01).alias("cost"))
    return R.route(first, second, "anomaly_id")


def h28(s, d):
    return _routed(s, d).select("anomaly_id", "escalated", "stage", "final_risk", F.round("final_confidence", 6).alias("final_confidence"), F.round("total_cost", 6).alias("total_cost"), "agreement")


def h27(s, d):
    own = R.cost_summary(_routed(s, d))
    return own.withColumns({c: F.round(c, 6) for c in ("total_cost", "average_cost", "escalation_rate", "savings")})


def h31(s, d):
    own = R.compare(anomalies(s, d))
    return own.withColumn("risk_range", F.round("risk_range", 6))


def h32(s, d):
    return R.corpus_statistics(docs(s, d)).withColumn("mean_chars", F.round("mean_chars", 6))


def h33(s, d):
    own = R.category_balance(docs(s, d), "source")
    return own.withColumns({c: F.round(c, 6) for c in ("share", "balance")})


def h34(s, d):
    own = R.corpus_quality(R.category_balance(docs(s, d), "source"), 4.0)
    return own.withColumns({c: F.round(c, 6) for c in ("completeness", "diversity", "quality")})


def h35(s, d):
    return R.validate_documents(docs(s, d), X.count_contained("text", COMMON_WORDS))


def h36(s, d):
    p = table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, None).otherwise(F.col("html")).alias("html"))
    return R.missing_fields(p, "page_id", ["url", "html"])


def h39(s, d):
    t = docs(s, d).select("doc_id", X.canonical_hash("text").alias("hash"), F.length("text").alias("chars"))
    ts = F.date_sub(F.lit(AS_OF).cast("date"), F.pmod(F.col("doc_id"), F.lit(20)).cast("int"))
    results = t.filter("doc_id % 2 = 0").select("hash", "chars", ts.alias("ts"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), F.lit(1).alias("stage"), F.col("doc_id").alias("result"))
    return R.reuse(t, results, F.lit(AS_OF).cast("date")).select("doc_id", "hit", "result")


_FB = f"""{ANOMALIES},
fb AS (SELECT *, ['helpful', 'acted_on', 'dismissed', 'false_positive', 'unknown'][anomaly_id % 5 + 1] AS user_action, confidence * 1.05 AS c2 FROM a),
fl AS (SELECT *, CASE WHEN user_action IN ('helpful', 'acted_on') THEN true WHEN user_action IN ('dismissed', 'false_positive') THEN false END AS was_correct, user_action <> 'unknown' AND c2 BETWEEN 0 AND 1 AS is_valid FROM fb)"""
_OUT = "oc AS (SELECT doc_id, CAST(quality AS DOUBLE) AS actual, (length(text) % 101) / 100.0 AS predicted FROM labels JOIN documents USING (doc_id))"
_REL = f"{_OUT}, rel AS (SELECT CAST(ceil(predicted * 10) AS INT) AS bin, count(*) AS n, avg(predicted) AS mp, avg(actual) AS ma FROM oc WHERE predicted > 0 GROUP BY 1)"
_WEEK = f"""{ANOMALIES}, cal AS (SELECT CAST(w AS INT) AS week, DATE '{AS_OF}' - CAST((6 - w) * 7 + 7 AS INT) AS s, DATE '{AS_OF}' - CAST((6 - w) * 7 AS INT) AS e FROM range(1, 7) t(w)),
wk AS (SELECT week, any_value(s) AS start, any_value(e) AS "end", count(anomaly_id) AS detections, count(DISTINCT document_id) AS documents FROM cal LEFT JOIN a ON CAST(created_at AS DATE) >= s AND CAST(created_at AS DATE) < e GROUP BY week),
wt AS (SELECT *, CASE WHEN documents > 0 THEN detections / documents ELSE 0.0 END AS alerts_per_document FROM wk)"""
_TREND = "CASE WHEN coalesce(abs(({b} - {a}) / nullif({a}, 0) * 100), 0) < 10 THEN 'STABLE' WHEN {b} > {a} THEN 'INCREASING' ELSE 'DECREASING' END"
_ROUTED = f"""{ANOMALIES}, rt AS (SELECT anomaly_id, confidence < 0.55 AS escalated, confidence < 0.55 AND anomaly_id % 3 <> 0 AS u, severity, CASE WHEN category > 3 THEN 'high' ELSE 'low' END AS r2, confidence FROM a),
routed AS (SELECT anomaly_id, escalated, CASE WHEN u THEN 2 ELSE 1 END AS stage, CASE WHEN u THEN r2 ELSE severity END AS final_risk, round(CASE WHEN u THEN 0.9 ELSE confidence END, 6)::DOUBLE AS final_confidence, CASE WHEN u THEN 0.011 ELSE 0.001 END::DOUBLE AS total_cost, CASE WHEN NOT u THEN 'not_checked' WHEN severity = r2 THEN 'confirmed' ELSE 'refined' END AS agreement FROM rt)"""
_A11 = "ix AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN length(text) < 500 THEN 'failed' ELSE 'success' END AS status, length(text) AS chars FROM documents)"
_BAL = "n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), bl AS (SELECT source, n, n / sum(n) OVER () AS share, 1 - abs(n - avg(n) OVER ()) / sum(n) OVER () AS balance FROM n)"
_COMMON = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in COMMON_WORDS)

PLANS: Plans = {
    "a04_constraints": (
        a4,
        """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 450000 THEN 'price' END, CASE WHEN length(o_orderpriority) > 10 THEN 'priority' END], lambda x: x IS NOT NULL)) AS violation FROM orders
UNION ALL SELECT o_orderkey, 'customer' FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey""",
    ),
    "a05_json": (a5, "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS INT), -1) END AS k FROM events"),
    "a09_index_statistics": (a9, "SELECT coalesce(CAST(vec_id % 3 AS VARCHAR), 'total') AS namespace, count(*) AS vectors, count(DISTINCT label) AS documents FROM embeddings GROUP BY ROLLUP (CAST(vec_id % 3 AS VARCHAR))"),
    "a11_incremental_status": (a11, f"WITH {_A11} SELECT doc_id, status, CASE WHEN status = 'failed' THEN 'text_too_short' END AS reason, chars FROM ix"),
    "a12_run_summary": (a12, f"WITH {_A11} SELECT count(*) AS processed, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed, CAST(sum(ceil(chars / 2000)) FILTER (status = 'success') AS BIGINT) AS chunks, round(avg(ceil(chars / 2000)) FILTER (status = 'success'), 6) AS mean_chunks, round(sum(ceil(chars / 2000)) FILTER (status = 'success') / 1000 * 0.02, 6) AS embedding_cost FROM ix"),
    "f07_reliability": (f7, f"WITH {_REL} SELECT bin, n, round(mp, 6)::DOUBLE AS mean_predicted, round(ma, 6) AS mean_actual FROM rel"),
    "f10_uncertainty": (f10, f"WITH {ANOMALIES}, u AS (SELECT anomaly_id, abs(coalesce(nullif(CASE WHEN anomaly_id % 3 = 0 THEN 0.0 ELSE confidence END, 0), nullif(CASE WHEN anomaly_id % 2 = 0 THEN confidence / 2 END, 0), 0.9) - 0.5) AS u FROM a) SELECT anomaly_id, round(u, 6) AS uncertainty FROM u ORDER BY u, anomaly_id LIMIT 25"),
    "f11_feedback": (f11, f"WITH {_FB} SELECT anomaly_id, user_action, was_correct, is_valid FROM fl"),
    "f12_feedback_statistics": (f12, f"WITH {_FB} SELECT count(*) AS size, least(count(*) / 100, 1.0)::DOUBLE AS progress, round(count(*) FILTER (user_action = 'dismissed') / count(*), 6) AS dismissal_rate, round(count(*) FILTER (was_correct) / count(*), 6) AS accuracy FROM fl WHERE is_valid"),
    "f13_sampling_policy": (f13, None),
    "f14_f15_generations": (
        f14,
        f"""WITH {_FB}, g AS (SELECT *, CAST((row_number() OVER (PARTITION BY document_id ORDER BY created_at, anomaly_id) - 1) // 50 AS BIGINT) AS generation FROM fl WHERE is_valid),
s AS (SELECT document_id, generation, count(*) AS n, count(*) FILTER (was_correct) AS correct, count(*) FILTER (user_action = 'dismissed') AS dismissed FROM g GROUP BY ALL)
SELECT *, CASE WHEN n < 50 THEN 'waiting' WHEN correct = 0 OR correct = n THEN 'one_class' WHEN dismissed / n > 0.20 THEN 'refit_with_warning' ELSE 'refit' END AS action FROM s""",
    ),
    "h21_i06_anomaly_list": (h21, f"WITH {ANOMALIES} SELECT anomaly_id, severity, 'Section ' || category AS section FROM a WHERE category = 3 ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence, anomaly_id LIMIT 40 OFFSET 5"),
    "h22_severity_counts": (h22, f"WITH {ANOMALIES} SELECT document_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM a GROUP BY document_id"),
    "g02_h23_document_list": (h23, f"WITH {ANOMALIES} SELECT c_custkey AS document_id, count(anomaly_id) AS anomalies FROM customer LEFT JOIN a ON document_id = c_custkey GROUP BY c_custkey ORDER BY anomalies DESC, document_id LIMIT 50 OFFSET 10"),
    "h24_global_metrics": (h24, f"WITH {_FB}, d AS (SELECT count(*) AS documents FROM documents), n AS (SELECT count(*) AS anomalies, count(*) FILTER (user_action = 'dismissed') / count(*) AS r FROM fl) SELECT documents, anomalies, round(r, 6) AS dismissal_rate, round(anomalies / documents, 6) AS alerts_per_document, CASE WHEN r > 0.40 THEN 'critical' WHEN r > 0.25 THEN 'warning' ELSE 'healthy' END AS health FROM d, n"),
    "h25_common_flags": (h25, f"WITH {ANOMALIES} SELECT indicator, count(*) AS n FROM a GROUP BY indicator ORDER BY n DESC, indicator LIMIT 5"),
    "h26_daily_metrics": (h26, f"WITH {ANOMALIES}, g AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS detections, count(DISTINCT document_id) AS documents, quantile_cont(confidence * 60, 0.95) AS q FROM a GROUP BY 1), h AS (SELECT *, CAST(detections / documents > 5 AS INT) + CAST(q > 30 AS INT) AS alerts FROM g) SELECT day, detections, documents, round(detections / documents, 6) AS alerts_per_document, round(q, 6) AS p95, alerts, CASE WHEN alerts > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM h"),
    "a05_j06_open_json": (
        a5_open,
        """
WITH r AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{broken' WHEN 1 THEN props
  ELSE '{"p": ' || props || ', "tags": ["' || event_type || '", "x"], "at": [{"u": ' || user_id || '}]}' END AS raw FROM events),
j AS (SELECT event_id, json_valid(raw) AS valid, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r)
SELECT event_id, valid, (j->>'$.p.k')::INT AS k, (j->>'$.at[0].u')::BIGINT AS first_user,
  array_to_string(coalesce(from_json(j->'$.tags', '["VARCHAR"]'), []), ',') AS tags, len(coalesce(from_json(j->'$.tags', '["VARCHAR"]'), [])) AS n_tags FROM j""",
    ),
    "h27_cost_summary": (h27, f"WITH {_ROUTED} SELECT count(*) AS analyses, round(sum(total_cost), 6) AS total_cost, round(avg(total_cost), 6) AS average_cost, round(count(*) FILTER (escalated) / count(*), 6) AS escalation_rate, count(*) FILTER (agreement = 'confirmed') AS confirmed, count(*) FILTER (agreement = 'refined') AS refined, round(1 - avg(total_cost) / 0.015, 6) AS savings, avg(total_cost) <= 0.0039 AS meets_target FROM routed"),
    "h28_h30_routing": (h28, f"WITH {_ROUTED} SELECT * FROM routed"),
    "h20_h31_comparison": (
        h31,
        f"""WITH {ANOMALIES}, x AS (SELECT * FROM a), g AS (SELECT document_id, count(*) AS n, CAST(sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) / count(*) * 3.33 AS DOUBLE) AS risk FROM x GROUP BY document_id),
c AS (SELECT category, count(DISTINCT document_id) AS have FROM x GROUP BY category)
SELECT count(*) AS documents, round(max(risk) - min(risk), 6) AS risk_range, max(n) AS most, min(n) AS fewest, first(document_id ORDER BY risk, document_id) AS best, first(document_id ORDER BY risk DESC, document_id) AS worst, (SELECT count(*) FROM c WHERE have < (SELECT count(*) FROM g)) AS uneven_categories, max(risk) - min(risk) > 2 AS risk_differs, max(n) > 2 * min(n) AS counts_differ FROM g""",
    ),
    "h32_corpus_statistics": (h32, "SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, list_sort(list(length(text)))[count(*) // 2 + 1] AS upper_median FROM documents"),
    "h33_i05_category_balance": (h33, f"WITH {_BAL} SELECT source, n, round(share, 6) AS share, round(balance, 6) AS balance FROM bl"),
    "h34_corpus_quality": (h34, f"WITH {_BAL} SELECT round(least(sum(n) / 100, 1.0), 6)::DOUBLE AS completeness, round(avg(balance), 6) AS diversity, count(*) FILTER (n < 15) AS small_categories, 0.8::DOUBLE AS length_score, round(least(sum(n) / 100, 1.0) * 0.4 + avg(balance) * 0.3 + 0.8 * 0.3, 6)::DOUBLE AS quality FROM bl"),
    "h35_corpus_validation": (h35, rf"WITH v AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '\s', '', 'g')) AS solid, {_COMMON} AS c FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN n < 500 THEN 'text_too_short' END, CASE WHEN solid < 300 THEN 'mostly_blank' END) AS issues, concat_ws(',', CASE WHEN c < 5 THEN 'language' END, CASE WHEN n > 100000 THEN 'very_long' END) AS warnings, n >= 500 AND solid >= 300 AS valid FROM v"),
    "h36_metadata_completeness": (h36, "SELECT page_id, concat_ws(',', CASE WHEN page_id % 5 = 0 OR trim(url) = '' THEN 'url' END, CASE WHEN page_id % 7 = 0 OR html IS NULL THEN 'html' END) AS missing FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0"),
    "h37_weekly_trend": (h37, f'WITH {_WEEK} SELECT week, CAST(start AS DATE) AS start, CAST("end" AS DATE) AS "end", detections, documents, round(alerts_per_document, 6) AS alerts_per_document FROM wt'),
    "h38_trend_direction": (
        h38,
        f"""WITH {_WEEK}, m AS (SELECT count(*) AS weeks, avg(alerts_per_document) FILTER (week <= 3) AS a1, avg(alerts_per_document) FILTER (week > 3) AS a2, avg(detections) FILTER (week <= 3) AS d1, avg(detections) FILTER (week > 3) AS d2 FROM wt),
t AS (SELECT weeks, {_TREND.format(a='a1', b='a2')} AS alerts_trend, {_TREND.format(a='d1', b='d2')} AS detections_trend FROM m)
SELECT *, CASE WHEN alerts_trend = 'INCREASING' THEN 'DEGRADING' WHEN alerts_trend = 'DECREASING' AND detections_trend = 'STABLE' THEN 'IMPROVING' ELSE 'STABLE' END AS overall_trend,
CASE WHEN alerts_trend = 'INCREASING' THEN '{" ".join(fixed.TREND_ADVICE["DEGRADING"])} {fixed.INCREASE_ADVICE}' WHEN alerts_trend = 'DECREASING' AND detections_trend = 'STABLE' THEN '{" ".join(fixed.TREND_ADVICE["IMPROVING"])}' ELSE '{fixed.TREND_ADVICE["STABLE"][0]}' END AS recommendations FROM t""",
    ),
    "h39_result_reuse": (
        h39,
        rf"""WITH t AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash, length(text) AS chars FROM documents),
r AS (SELECT hash, max(struct_pack(ts := DATE '{AS_OF}' - CAST(doc_id % 20 AS INT), result := doc_id)).result AS result FROM t WHERE doc_id % 2 = 0 AND chars >= 1000 AND doc_id % 20 < CASE WHEN (doc_id % 10) / 10.0 > 0.85 THEN 14 ELSE 7 END GROUP BY hash)
SELECT doc_id, result IS NOT NULL AS hit, result FROM t LEFT JOIN r USING (hash)""",
    ),
}
