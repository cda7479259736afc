"""Reports with totals, histories, findings and validation; corpus folders, index runs and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import models as M
from textloom.operators import reports as R
from textloom.plans.common import Plans, rows, table
from textloom.plans.model_plans import _ISO
from textloom.plans.report_plans import _COMMON, _FB, _ROUTED, AS_OF, _routed, feedback, outcomes
from textloom.plans.scoring_plans import ANOMALIES, anomalies
from textloom.plans.text_plans import COMMON_WORDS
from textloom.session import shared_dir
from textloom.sources import corpus as C


def docs(s, d):
    """Documents with pages of 1,800 characters and an extraction method."""
    own = table(s, d, "documents")
    method = F.when(F.col("doc_id") % 7 == 0, "ocr").when(F.col("doc_id") % 3 == 0, "layout").otherwise("plain")
    return own.withColumn("pages", F.ceil(F.length("text") / 1800)).withColumn("method", method)


_DOCS = "dp AS (SELECT *, CAST(ceil(length(text) / 1800) AS BIGINT) AS pages, CASE WHEN doc_id % 7 = 0 THEN 'ocr' WHEN doc_id % 3 = 0 THEN 'layout' ELSE 'plain' END AS method FROM documents)"


def a1(s, d):
    """Texts written as files of folders, read as a corpus and joined with its metadata."""
    folder = shared_dir(s, "corpus-files")
    own = table(s, d, "pages").select("page_id", F.encode(C.html_text("html"), "UTF-8").alias("data"), (F.col("page_id") % 3).alias("c"))
    _write_files(own, folder)
    meta = table(s, d, "pages").filter("page_id % 4 <> 0").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".txt")).alias("filename"), F.concat(F.lit("company "), (F.col("page_id") % 9).cast("string")).alias("company"),
        F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string")).alias("category"), F.col("url").alias("source_url"),
    )
    found = C.with_metadata(C.read_corpus(s, folder, ["c0", "c2"]), meta)
    return found.select("file_name", F.md5("text").alias("text_md5"), "company", "category", "source_url")


def _write_files(rows_, folder: str) -> None:
    """A file ``c<category>/p<id>.txt`` for each row, in the shared folder."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        for batch in batches:
            for page, data, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                store, path = fs.FileSystem.from_uri(f"{folder}/c{c}/p{page}.txt")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows_.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def a9(s, d):
    own = table(s, d, "embeddings").withColumn("namespace", F.col("vec_id") % 3)
    return C.index_statistics(own, "namespace", "label").withColumns({c: F.round(c, 6) for c in ("average_vectors", "coverage")})


def _run(s, d, force=False):
    done = table(s, d, "documents").filter("doc_id % 4 = 0").select("doc_id")
    return C.index_status(table(s, d, "documents"), done, "doc_id", force=force)


def a11(s, d):
    return _run(s, d).withColumn("forced", F.lit(False)).unionByName(_run(s, d, True).withColumn("forced", F.lit(True)))


def a12(s, d):
    own = _run(s, d).withColumns({"chunks": F.ceil(F.col("chars") / 2000), "seconds": F.col("chars") / 1000.0})
    out = C.run_summary(own, "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_chunks", "seconds", "mean_seconds", "embedding_cost")})


def a13(s, d):
    """A calibration saved, loaded and applied."""
    path = shared_dir(s, "model")
    C.save_model({"knots": M.calibration_knots(outcomes(s, d), "predicted", "actual")}, path)
    knots = C.load_model(s, path, ["knots"])["knots"]
    return M.calibrate(outcomes(s, d), knots, "predicted").select("doc_id", F.round("calibrated_confidence", 6).alias("calibrated_confidence"))


def b4(s, d):
    return table(s, d, "pages").select("page_id", X.file_name_plain(F.concat("url", F.lit("/ é x?.pdf"))).alias("file_name"))


def b9(s, d):
    """Metadata, the default row where extraction failed."""
    own = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("kind"), (F.col("o_orderkey") % 5 == 0).alias("failed"))
    return X.default_metadata(own, "failed", {"kind": "Terms of Service"})


def b14(s, d):
    return table(s, d, "documents").select("doc_id", X.file_size(F.length("text").cast("double") * F.length("text")).alias("size"), X.percentage(F.col("doc_id") % 8 / 8.0).alias("share"))


def b19(s, d):
    own = anomalies(s, d).groupBy("document_id", "category").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return own.withColumn("level", X.count_level(F.col("high"), F.col("medium")))


def h21(s, d):
    a = anomalies(s, d).withColumn("prevalence", F.col("confidence")).filter("category = 3")
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return R.page_with_total(a, [rank, "prevalence", "anomaly_id"], 5, 40).select("anomaly_id", "severity", "total")


def _listed(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("document_id"), F.date_sub(F.lit(AS_OF).cast("date"), F.pmod("c_custkey", F.lit(50)).cast("int")).alias("created"))
    return R.with_counts(own, anomalies(s, d))


def h23(s, d):
    return R.page_with_total(_listed(s, d), [F.desc("created"), "document_id"], 10, 50).select("document_id", "anomalies", "total")


def h23b(s, d):
    return R.dashboard(_listed(s, d))


def g2(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("document_id"))
    return R.with_statistics(own, anomalies(s, d))


def h25(s, d):
    own = R.anomaly_statistics(anomalies(s, d).withColumn("prevalence", F.col("confidence")), "indicator")
    return own.withColumn("average_prevalence", F.round("average_prevalence", 6))


def h26(s, d):
    own = R.daily_report(anomalies(s, d).withColumn("seconds", F.col("confidence") * 60), feedback(s, d).filter("is_valid"))
    return own.withColumns({c: F.round(c, 6) for c in ("p95", "alerts_per_document", "helpful_rate", "dismissal_rate", "false_positive_rate")})


def _logs(s, d):
    return _routed(s, d).join(anomalies(s, d).select("anomaly_id", "document_id", "created_at", (F.col("confidence") * 10).alias("seconds")), "anomaly_id")


def h27(s, d):
    own = R.cost_report(_logs(s, d), [F.desc("created_at"), F.desc("anomaly_id")], 500)
    return own.withColumns({c: F.round(c, 6) for c in ("total_cost", "average_cost", "escalation_rate", "average_time", "total_savings", "percent_savings", "cost_vs_target", "escalation_vs_target")})


def h27b(s, d):
    return R.analysis_history(_logs(s, d), "document_id", "created_at", "anomaly_id").select("document_id", "anomaly_id", "place", "cost_efficiency")


def _results(s, d):
    """Results of a document with its conversations' turns as clauses."""
    kinds, levels = (F.array(*map(F.lit, x)) for x in (("ANOMALY", "NORMAL", "FLAGGED", "UNUSUAL", "SAFE"), ("high", "medium", "low")))
    pick = lambda a, n, k: F.element_at(a, (n % k + 1).cast("int"))
    turn = F.col("turn")
    clause = F.struct(
        turn.alias("turn"), pick(kinds, turn + F.col("conv_id"), 5).alias("classification"), F.when(turn % 2 == 0, F.col("role")).alias("section"), turn.cast("string").alias("clause_id"),
        F.when(turn % 4 != 0, pick(levels, turn, 3)).alias("risk_level"), F.left("text", F.lit(200)).alias("reason"), F.lit(None).cast("string").alias("legal_reasoning"), F.when(turn % 3 == 0, F.col("role")).alias("risk_category"),
    )
    return table(s, d, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(clause)).alias("clauses"))


def h30(s, d):
    own = R.findings(_results(s, d), most=100)
    return own.select("document_id", "section", "clause_number", F.md5("clause_text").alias("text_md5"), F.length("explanation").alias("said"), "severity", "risk_category", "prevalence")


def h30b(s, d):
    return R.analysis_logs(_results(s, d), top=3)


def h31(s, d):
    own = anomalies(s, d)
    scored = own.groupBy("document_id").agg(F.round(F.avg(F.when(F.col("severity") == "high", 9.0).when(F.col("severity") == "medium", 5.0).otherwise(1.0)), 1).alias("risk_score")).withColumn("name", F.concat(F.lit("doc "), F.col("document_id").cast("string")))
    return R.comparison(scored, own.filter("category <> document_id % 7"))


def h32(s, d):
    return R.corpus_by_method(docs(s, d), "method", "pages").withColumns({c: F.round(c, 6) for c in ("mean_pages", "mean_chars")})


def h34(s, d):
    own = R.quality_report(docs(s, d), "source", "pages")
    return own.withColumns({c: F.round(c, 6) for c in ("completeness", "diversity", "mean_pages", "quality")})


def h35(s, d):
    own = R.validate_corpus(docs(s, d), X.count_contained("text", COMMON_WORDS), "pages", "method")
    return own.withColumn("chars", F.col("chars").cast("long"))


def h35b(s, d):
    return R.validation_totals(h35(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_pages", "mean_chars")})


def h39(s, d):
    """Reuse of stored results, those of some documents having been dropped."""
    t = table(s, d, "documents").select("doc_id", X.canonical_hash("text").alias("hash"), F.length("text").alias("chars"))
    ts = F.date_sub(F.lit(AS_OF).cast("date"), F.pmod("doc_id", F.lit(20)).cast("int"))
    results = t.filter("doc_id % 2 = 0").select("hash", "chars", ts.alias("ts"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), F.lit(1).alias("stage"), F.col("doc_id").alias("result"), "doc_id")
    kept = R.invalidate(results, t.filter("doc_id % 6 = 0"), "doc_id").drop("doc_id")
    own = R.reuse_statistics(R.reuse(t, kept, F.lit(AS_OF).cast("date")))
    return own.withColumns({c: F.round(c, 6) for c in ("hit_rate", "saved_cost")})


def b22(s, d):
    """Long vague texts that no indicator word has flagged."""
    return table(s, d, "documents").select("doc_id", X.vague_only("text", F.contains("text", F.lit("und")), ("with", "for the", "that")).alias("vague"))


_X = "coalesce(html, '')"
for _tag in C.BLOCKS:
    _X = f"regexp_replace({_X}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_X = f"regexp_replace({_X}, '(?s)<[^>]+>', '', 'g')"
for _name, _value in C.ENTITIES:
    _X = "replace({}, '{}', '{}')".format(_X, _name, _value.replace("'", "''"))
_TEXT = f"array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_X}, chr(10)), lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda x: x <> ''), chr(10))"
_A11 = "SELECT doc_id, CASE WHEN {f}doc_id % 4 = 0 THEN 'skipped' WHEN length(text) < 500 THEN 'failed' ELSE 'success' END AS status, length(text) AS chars FROM documents"
_REASON = "CASE status WHEN 'skipped' THEN 'already_indexed' WHEN 'failed' THEN 'text_too_short' END AS reason"
_LOGS = f"{_ROUTED}, lo AS (SELECT routed.*, document_id, created_at, confidence * 10 AS seconds FROM routed JOIN a USING (anomaly_id))"
_RES = """
cl AS (SELECT conv_id AS document_id, turn, ['ANOMALY', 'NORMAL', 'FLAGGED', 'UNUSUAL', 'SAFE'][(turn + conv_id) % 5 + 1] AS classification, CASE WHEN turn % 2 = 0 THEN role END AS section, CASE WHEN turn % 4 <> 0 THEN ['high', 'medium', 'low'][turn % 3 + 1] END AS risk_level,
  left(text, 200) AS reason, CASE WHEN turn % 3 = 0 THEN role END AS risk_category FROM conversations)"""
_VALID = rf"""{_DOCS}, v AS (SELECT doc_id, pages, length(text) AS n, length(regexp_replace(text, '\s', '', 'g')) AS solid, {_COMMON} AS c, method FROM dp),
vd AS (SELECT doc_id, concat_ws(',', CASE WHEN pages < 2 THEN 'too_few_pages' END, CASE WHEN n < 500 THEN 'text_too_short' END, CASE WHEN solid < 300 THEN 'mostly_blank' END) AS issues, concat_ws(',', CASE WHEN c < 5 THEN 'language' END, CASE WHEN method = 'ocr' THEN 'fallback_method' END, CASE WHEN n > 100000 THEN 'very_long' END) AS warnings, pages >= 2 AND n >= 500 AND solid >= 300 AS valid, pages, n AS chars FROM v)"""
_R6 = "round({0}, 6)::DOUBLE AS {1}"

PLANS: Plans = {
    "a01_a02_corpus_files": (
        a1,
        f"""SELECT 'p' || page_id || '.txt' AS file_name, md5({_TEXT}) AS text_md5, CASE WHEN page_id % 4 <> 0 THEN 'company ' || (page_id % 9) ELSE 'p' || page_id END AS company, CASE WHEN page_id % 4 <> 0 THEN 'c' || (page_id % 3) ELSE 'unknown' END AS category, CASE WHEN page_id % 4 <> 0 THEN coalesce(url, '') ELSE '' END AS source_url FROM pages WHERE page_id % 3 <> 1""",
    ),
    "a09_index_coverage": (a9, "WITH g AS (SELECT coalesce(CAST(vec_id % 3 AS VARCHAR), 'total') AS namespace, count(*) AS vectors, count(DISTINCT label) AS documents FROM embeddings GROUP BY ROLLUP (CAST(vec_id % 3 AS VARCHAR))) SELECT *, round(vectors / documents, 6)::DOUBLE AS average_vectors, round(vectors / (documents * 50), 6)::DOUBLE AS coverage FROM g"),
    "a11_index_status": (a11, f"SELECT *, {_REASON}, false AS forced FROM ({_A11.format(f='')}) UNION ALL SELECT *, {_REASON}, true FROM ({_A11.format(f='false AND ')})"),
    "a12_index_run": (
        a12,
        f"""WITH r AS ({_A11.format(f='')}), e AS (SELECT string_agg(doc_id || ': text_too_short', '; ' ORDER BY doc_id) AS errors FROM (SELECT doc_id FROM r WHERE status = 'failed' ORDER BY doc_id LIMIT 5))
SELECT count(*) AS processed, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(coalesce(sum(ceil(chars / 2000)) FILTER (status = 'success'), 0) AS BIGINT) AS chunks,
round(avg(ceil(chars / 2000)) FILTER (status = 'success'), 6)::DOUBLE AS mean_chunks, CAST(sum(chars) FILTER (status = 'success') AS BIGINT) AS chars, round(sum(chars / 1000.0), 6)::DOUBLE AS seconds, round(avg(chars / 1000.0) FILTER (status = 'success'), 6)::DOUBLE AS mean_seconds,
round(sum(ceil(chars / 2000)) FILTER (status = 'success') / 1000 * 0.02, 6)::DOUBLE AS embedding_cost, (SELECT coalesce(errors, '') FROM e) AS errors FROM r""",
    ),
    "a13_stored_model": (a13, f"WITH {_ISO} SELECT doc_id, round(yhat, 6)::DOUBLE AS calibrated_confidence FROM oc JOIN iso ON predicted = x"),
    "b04_plain_file_name": (b4, r"WITH n AS (SELECT page_id, trim(regexp_replace(list_last(string_split(url || '/ é x?.pdf', '/')), '[^\p{L}\p{N}._\- ]', '', 'g')) AS f FROM pages) SELECT page_id, CASE WHEN length(f) > 0 THEN f ELSE 'document.pdf' END AS file_name FROM n"),
    "b09_default_metadata": (b9, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Terms of Service' WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS kind, o_orderkey % 5 = 0 AS extraction_failed FROM orders"),
    "b14_sizes": (
        b14,
        "WITH n AS (SELECT doc_id, CAST(length(text) AS DOUBLE) * length(text) AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' WHEN n >= 1073741824 THEN CAST(floor(n / 1073741824 + 0.5) AS BIGINT) || ' GB' WHEN n >= 1048576 THEN CAST(floor(n / 1048576 + 0.5) AS BIGINT) || ' MB' WHEN n >= 1024 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE CAST(n AS BIGINT) || ' Bytes' END AS size, printf('%.1f', doc_id % 8 / 8 * 100) || '%' AS share FROM n",
    ),
    "b19_count_levels": (b19, f"WITH {ANOMALIES}, g AS (SELECT document_id, category, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM a GROUP BY ALL) SELECT *, CASE WHEN high > 0 THEN 'High' WHEN medium > 2 THEN 'Medium' ELSE 'Low' END AS level FROM g"),
    "b22_vague_only": (b22, "SELECT doc_id, length(text) > 500 AND (contains(lower(text), 'with') OR contains(lower(text), 'for the') OR contains(lower(text), 'that')) AND NOT contains(text, 'und') AS vague FROM documents"),
    "h21_list_with_total": (h21, f"WITH {ANOMALIES} SELECT anomaly_id, severity, (SELECT count(*) FROM a WHERE category = 3) AS total FROM a WHERE category = 3 ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence, anomaly_id LIMIT 40 OFFSET 5"),
    "h23_newest_documents": (h23, f"WITH {ANOMALIES} SELECT c_custkey AS document_id, count(anomaly_id) AS anomalies, (SELECT count(*) FROM customer) AS total FROM customer LEFT JOIN a ON document_id = c_custkey GROUP BY c_custkey ORDER BY c_custkey % 50, c_custkey LIMIT 50 OFFSET 10"),
    "h23_dashboard": (h23b, f"WITH {ANOMALIES}, n AS (SELECT c_custkey, count(anomaly_id) AS n FROM customer LEFT JOIN a ON document_id = c_custkey GROUP BY c_custkey) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS anomalies, count(*) FILTER (n > 5) AS documents_over FROM n"),
    "g02_documents_with_anomalies": (g2, f"WITH {ANOMALIES} SELECT c_custkey AS document_id, count(anomaly_id) AS anomaly_count, count(*) FILTER (severity = 'high') AS high_risk_count, coalesce(string_agg(DISTINCT CAST(category AS VARCHAR), ',' ORDER BY CAST(category AS VARCHAR)), '') AS categories FROM customer LEFT JOIN a ON document_id = c_custkey GROUP BY c_custkey"),
    "h25_anomaly_statistics": (
        h25,
        f"""WITH {ANOMALIES}, f AS (SELECT indicator, count(*) AS n FROM a GROUP BY indicator ORDER BY n DESC, indicator LIMIT 5)
SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, round(avg(confidence), 6)::DOUBLE AS average_prevalence, (SELECT string_agg(indicator || ' ' || n, ', ' ORDER BY n DESC, indicator) FROM f) AS common_flags FROM a""",
    ),
    "h26_daily_report": (
        h26,
        f"""WITH {_FB}, g AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS detections, count(DISTINCT document_id) AS documents, quantile_cont(confidence * 60, 0.95) AS p95 FROM a GROUP BY 1),
w AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS feedback, count(*) FILTER (user_action = 'helpful') AS helpful, count(*) FILTER (user_action = 'acted_on') AS acted_on, count(*) FILTER (user_action = 'dismissed') AS dismissed, count(*) FILTER (user_action = 'false_positive') AS false_positive FROM fl WHERE is_valid GROUP BY 1),
j AS (SELECT g.*, coalesce(feedback, 0) AS feedback, coalesce(helpful, 0) AS helpful, coalesce(acted_on, 0) AS acted_on, coalesce(dismissed, 0) AS dismissed, coalesce(false_positive, 0) AS false_positive FROM g LEFT JOIN w USING (day)),
r AS (SELECT *, detections / documents AS apd, (helpful + acted_on) / greatest(feedback, 1) AS hr, dismissed / greatest(feedback, 1) AS dr, false_positive / greatest(feedback, 1) AS fr FROM j),
s AS (SELECT *, concat_ws(', ', CASE WHEN fr > 0.05 THEN 'HIGH false_positive_rate' END, CASE WHEN dr > 0.20 THEN 'MEDIUM dismissal_rate' END, CASE WHEN apd > 5 THEN 'MEDIUM alerts_per_document' END, CASE WHEN p95 > 30 THEN 'LOW p95' END) AS alerts FROM r)
SELECT day, detections, documents, round(p95, 6)::DOUBLE AS p95, feedback, helpful, acted_on, dismissed, false_positive, round(apd, 6)::DOUBLE AS alerts_per_document, round(hr, 6)::DOUBLE AS helpful_rate, round(dr, 6)::DOUBLE AS dismissal_rate, round(fr, 6)::DOUBLE AS false_positive_rate, alerts, CASE WHEN alerts = '' THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM s""",
    ),
    "h27_cost_report": (
        h27,
        f"""WITH {_LOGS}, x AS (SELECT * FROM lo ORDER BY created_at DESC, anomaly_id DESC LIMIT 500), g AS (SELECT count(*) AS analyses, sum(total_cost) AS tc, avg(total_cost) AS ac, count(*) FILTER (escalated) / count(*) * 100 AS er, count(*) FILTER (stage = 1) AS stage1_only, count(*) FILTER (stage = 2) AS stage2_escalated, avg(seconds) AS t FROM x)
SELECT analyses, {_R6.format('tc', 'total_cost')}, {_R6.format('ac', 'average_cost')}, {_R6.format('er', 'escalation_rate')}, stage1_only, stage2_escalated, {_R6.format('t', 'average_time')}, {_R6.format('analyses * 0.015 - tc', 'total_savings')}, {_R6.format('(analyses * 0.015 - tc) / (analyses * 0.015) * 100', 'percent_savings')}, {_R6.format('(ac - 0.0039) / 0.0039 * 100', 'cost_vs_target')}, {_R6.format('(er - 24.0) / 24.0 * 100', 'escalation_vs_target')} FROM g""",
    ),
    "h27_analysis_history": (h27b, f"WITH {_LOGS} SELECT document_id, anomaly_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, anomaly_id DESC) AS place, round((0.015 - total_cost) / 0.015 * 100, 1)::DOUBLE AS cost_efficiency FROM lo"),
    "h30_findings": (
        h30,
        f"""WITH {_RES} SELECT document_id, coalesce(section, 'Unknown') AS section, CAST(turn AS VARCHAR) AS clause_number, md5(left(coalesce(reason, ''), 100)) AS text_md5, length(coalesce(reason, '')) AS said, coalesce(risk_level, 'medium') AS severity, coalesce(risk_category, 'other') AS risk_category, 0.0::DOUBLE AS prevalence FROM cl WHERE classification IN ('ANOMALY', 'FLAGGED', 'PROBLEMATIC', 'UNUSUAL')""",
    ),
    "h30_analysis_logs": (
        h30b,
        f"""WITH {_RES}, t AS (SELECT document_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS top_ids FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn) AS p FROM cl WHERE risk_level = 'high') WHERE p <= 3 GROUP BY document_id)
SELECT document_id, count(*) AS anomaly_count, count(*) FILTER (risk_level = 'high') AS high_risk_count, count(*) FILTER (risk_level = 'medium') AS medium_risk_count, count(*) FILTER (risk_level = 'low') AS low_risk_count, coalesce(any_value(top_ids), '') AS top_ids FROM cl LEFT JOIN t USING (document_id) GROUP BY document_id""",
    ),
    "h31_comparison_report": (
        h31,
        f"""WITH {ANOMALIES}, sr AS (SELECT document_id, round(avg(CASE severity WHEN 'high' THEN 9.0 WHEN 'medium' THEN 5.0 ELSE 1.0 END), 1) AS risk_score FROM a GROUP BY document_id),
x AS (SELECT * FROM a WHERE category <> document_id % 7), g AS (SELECT document_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high, string_agg(DISTINCT CAST(category AS VARCHAR), ',' ORDER BY CAST(category AS VARCHAR)) AS categories FROM x GROUP BY document_id),
m AS (SELECT document_id, 'doc ' || document_id AS name, risk_score, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(categories, '') AS categories FROM sr LEFT JOIN g USING (document_id)),
c AS (SELECT category, count(DISTINCT document_id) AS have FROM x GROUP BY category), w AS (SELECT count(*) AS d, min(risk_score) AS lo, max(risk_score) AS hi, min(n) AS fewest, max(n) AS most FROM m),
f AS (SELECT 'risk_score' AS kind, printf('Significant difference in risk levels: %.1f to %.1f', lo, hi) AS description FROM w WHERE hi - lo > 2 UNION ALL SELECT 'anomaly_count', printf('Large difference in concerning clauses: %d to %d', fewest, most) FROM w WHERE most > fewest * 2
  UNION ALL SELECT 'category ' || category, printf('Only %d of %d documents have %s concerns', have, d, CAST(category AS VARCHAR)) FROM c, w WHERE have < d),
b AS (SELECT first(m ORDER BY risk_score, document_id) AS best, first(m ORDER BY risk_score DESC, document_id) AS worst FROM m)
SELECT 'document' AS kind, printf('%s: %.1f, %d anomalies, %d high, %s', name, risk_score, n, high, categories) AS description FROM m UNION ALL SELECT * FROM f
UNION ALL SELECT 'recommendation', printf('Best: %s with risk score %.1f/10. Most concerning: %s with risk score %.1f/10 and %d high-risk clauses. %d variations found.', best.name, best.risk_score, worst.name, worst.risk_score, worst.high, (SELECT count(*) FROM f)) FROM b""",
    ),
    "h32_corpus_by_method": (h32, f"WITH {_DOCS} SELECT coalesce(method, 'all') AS method, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS total_pages, round(avg(pages), 6)::DOUBLE AS mean_pages, min(pages) AS min_pages, max(pages) AS max_pages, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 6)::DOUBLE AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM dp GROUP BY ROLLUP (method)"),
    "h34_quality_report": (
        h34,
        f"""WITH {_DOCS}, n AS (SELECT source, count(*) AS n FROM dp GROUP BY source), bl AS (SELECT source, n, 1 - abs(n - avg(n) OVER ()) / sum(n) OVER () AS balance FROM n), p AS (SELECT avg(pages) AS mp FROM dp),
q AS (SELECT least(sum(n) / 100, 1.0) AS c, avg(balance) AS d, coalesce(string_agg(source || ' needs ' || (15 - n), ', ' ORDER BY source || ' needs ' || (15 - n)) FILTER (n < 15), '') AS recommendations FROM bl), l AS (SELECT *, CASE WHEN mp >= 5 THEN 1.0 WHEN mp >= 3 THEN 0.8 ELSE 0.5 END AS ls FROM q, p)
SELECT round(c, 6)::DOUBLE AS completeness, round(d, 6)::DOUBLE AS diversity, recommendations, round(mp, 6)::DOUBLE AS mean_pages, ls::DOUBLE AS length_score, round(c * 0.4 + d * 0.3 + ls * 0.3, 6)::DOUBLE AS quality FROM l""",
    ),
    "h35_validated_documents": (h35, f"WITH {_VALID} SELECT * FROM vd"),
    "h35_validation_totals": (h35b, f"WITH {_VALID} SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (warnings <> '') AS with_warnings, round(avg(pages) FILTER (valid), 6)::DOUBLE AS mean_pages, CAST(sum(chars) FILTER (valid) AS BIGINT) AS total_chars, round(avg(chars) FILTER (valid), 6)::DOUBLE AS mean_chars, min(chars) FILTER (valid) AS min_chars, max(chars) FILTER (valid) AS max_chars FROM vd"),
    "h39_reuse_statistics": (
        h39,
        rf"""WITH t AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash, length(text) AS chars FROM documents),
r AS (SELECT DISTINCT hash FROM t WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0 AND chars >= 1000 AND doc_id % 20 < CASE WHEN (doc_id % 10) / 10.0 > 0.85 THEN 14 ELSE 7 END)
SELECT count(*) AS requests, count(r.hash) AS hits, round(count(r.hash) / count(*) * 100, 6)::DOUBLE AS hit_rate, round(count(r.hash) * 0.0039, 6)::DOUBLE AS saved_cost FROM t LEFT JOIN r USING (hash)""",
    ),
}
