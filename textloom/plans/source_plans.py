"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import matching as M
from textloom.operators import scoring
from textloom.operators import structure as S
from textloom.plans.common import Plans, rows, table
from textloom.plans.scoring_plans import ANOMALIES, anomalies
from textloom.plans.structure_plans import _CLAUSES, DOTS, HEADS, PARTS, RULE_SCHEMA, RULES, _found_sql
from textloom.session import shared_dir
from textloom.sources import corpus as C
from textloom.sources import versions
from textloom.streaming import jobs as J
from textloom.streaming import state


def a1(s, d):
    """documents written as folders of text files by language, and read again."""
    folder = shared_dir(s, "corpus")
    docs = table(s, d, "documents").select("doc_id", "lang", "text")
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value"), "lang").write.partitionBy("lang").text(folder)
    own = s.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    rows = own.select(F.from_json("value", "doc_id long, text string").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]+)/[^/]+$", 1).alias("category"))
    return rows.select("r.doc_id", "category", F.md5("r.text").alias("text_md5")).filter("category IN ('de', 'fr', 'en')")


def a10(s, d):
    """Anomalies by severity, written as a JSON report and read again."""
    folder = shared_dir(s, "report")
    C.write_report(anomalies(s, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents")), folder)
    return s.read.schema("severity string, n long, documents long").json(folder)


def a3(s, d):
    return C.pages_text(table(s, d, "pages"))


def _vectors(s, d):
    own = S.chunks(table(s, d, "documents").select("doc_id", "text"))
    return C.chunk_vectors(own, "doc_id", (F.col("doc_id") % 2).cast("string"))


def a6(s, d):
    old = _vectors(s, d)
    new = old.filter("doc_id % 5 = 0").withColumn("text", F.lit("rewritten"))
    folder = shared_dir(s, "vectors")
    C.write_vectors(C.upsert(old, new, "chunk_key"), folder)
    return s.read.parquet(folder).select("chunk_key", "doc_id", F.md5("text").alias("text_md5"), F.col("namespace").cast("string").alias("namespace"))


def a7(s, d):
    gone = table(s, d, "documents").filter("doc_id % 3 = 1").select("doc_id")
    return C.delete_documents(_vectors(s, d), gone, "doc_id").select("chunk_key")


def a8(s, d):
    a = anomalies(s, d).select("anomaly_id", "document_id", "severity")
    new = a.filter("document_id % 4 = 0 AND anomaly_id % 2 = 0").withColumn("severity", F.lit("high"))
    return C.replace_rows(a, new, "document_id").groupBy("document_id").agg(F.count("*").alias("anomalies"), F.count_if(F.col("severity") == "high").alias("high"))


def a7_store(s, d):
    """Documents with their chunks and anomalies on disk: anomalies of some replaced, some documents deleted from all tables; rows of the last version by document."""
    store = shared_dir(s, "versions")
    own = anomalies(s, d).select("anomaly_id", F.col("document_id").alias("doc_id"), "severity")
    docs = table(s, d, "documents").select("doc_id", "lang")
    versions.create(s, store, {"documents": docs, "chunks": _vectors(s, d), "anomalies": own}, "doc_id")
    versions.replace(s, store, {"anomalies": own.filter("doc_id % 4 = 0 AND anomaly_id % 2 = 0").withColumn("severity", F.lit("new"))})
    versions.delete(s, store, docs.filter("doc_id % 3 = 1").select("doc_id"))
    parts = [versions.read(s, store, name).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name)) for name in ("documents", "chunks")]
    last = versions.read(s, store, "anomalies").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "new").alias("replaced"))
    return last.withColumn("table", F.lit("anomalies")).unionByName(parts[0].unionByName(parts[1]), allowMissingColumns=True)


def a15(s, d):
    base = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("note"))
    extracted = base.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("x")).alias("kind"))
    return C.merge_metadata(base, extracted, "o_orderkey", ["kind"])


def _days(s, d, parts=((0, 10), (10, 20), (20, 40))):
    """The events as files that come one after another, by day of the month; returns their folder."""
    folder = shared_dir(s, "event-files")
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts") - 1
    for number, (a, b) in enumerate(parts):
        # files are taken by the time of their writing
        events.filter((day >= a) & (day < b)).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    return f"{folder}/events"


def _stream(s, d, **parts):
    path = _days(s, d, **parts)
    schema = s.read.parquet(path).schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def k1(s, d):
    """Refits by a stream of three files: of every hundred valid feedbacks in the order of their coming."""
    folder = shared_dir(s, "recalibrated")
    actions = F.array(*map(F.lit, ("helpful", "acted_on", "dismissed", "false_positive", "unknown")))
    stream = _stream(s, d).select(F.element_at(actions, (F.col("event_id") % 5 + 1).cast("int")).alias("user_action"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), F.col("ts").alias("feedback_date"), F.col("event_id").alias("feedback_id"))
    J.recalibrate(stream, folder)
    own = s.read.parquet(f"{folder}/models").groupBy("batch").agg(F.count("*").alias("generations"), F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("dismissed").alias("dismissed"), F.count_if(F.col("action") == "refit_with_warning").alias("warned"))
    return own.select("generations", "n", "correct", "dismissed", "warned", F.col("batch").cast("long").alias("batch"))


def k2(s, d):
    stream = _stream(s, d).select("user_id", F.when(F.col("event_type") == "view", "dismissed").otherwise("helpful").alias("user_action"), (F.col("event_type") != "view").alias("was_correct"))
    own = J.to_table(J.running_feedback(stream, "user_id"), "update", "feedback")
    return own.groupBy("user_id").agg(F.max_by(F.struct("size", F.round("dismissal_rate", 6).alias("dismissal_rate"), F.round("accuracy", 6).alias("accuracy")), "size").alias("r")).select("user_id", "r.*")


def k3(s, d):
    """All days, in complete mode."""
    own = J.to_table(J.daily_detections(J.read_stream(s, f"{d}/events.parquet", "ts"), "ts"), "complete", "daily")
    return own.select(F.col("day").cast("date").alias("day"), "detections")


def k3b(s, d):
    """Days in append mode over files of which one comes too late: its days are behind the watermark and dropped. The last days stay open."""
    own = J.to_table(J.daily_detections(_stream(s, d, parts=((0, 10), (15, 25), (25, 28), (10, 15), (28, 40))), "ts"), "append", "daily-closed")
    return own.select(F.col("day").cast("date").alias("day"), "detections")


def k4(s, d):
    own = J.to_table(J.weekly_detections(J.read_stream(s, f"{d}/events.parquet", "ts"), "ts"), "complete", "weekly")
    return own.select(F.col("start").cast("date").alias("start"), "detections")


def k4b(s, d):
    """Sliding weeks in append mode: those that the watermark has passed."""
    own = J.to_table(J.weekly_detections(_stream(s, d), "ts"), "append", "weekly-closed")
    return own.select(F.col("start").cast("date").alias("start"), "detections")


def k5(s, d):
    """Documents as they arrive, cut into clauses, matched with rules and given a severity; texts under 200 characters fail."""
    folder = shared_dir(s, "arrived")

    def analyse(own):
        found = S.clauses(S.sections(own.select("doc_id", "text"), HEADS), PARTS, DOTS)
        hits = M.indicators(found, rows(s, RULE_SCHEMA, RULES), ("doc_id", "section_no", "clause_no"), "clause_text", service="music")
        each = hits.groupBy("doc_id", "section_no", "clause_no").agg(F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("severity") == "medium").alias("m"))
        level = scoring.clause_severity(F.col("h"), F.col("m"), F.lit(1.0))
        return each.withColumn("severity", level).groupBy("doc_id").agg(F.count("*").alias("anomalies"), F.count_if(F.col("severity") == "high").alias("high"))

    J.analyse_arrivals(J.read_stream(s, f"{d}/documents.parquet"), analyse, folder, least=200)
    status = s.read.parquet(f"{folder}/status").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "status"))), lambda x: x["status"]), ",").alias("status"))
    return status.join(s.read.parquet(f"{folder}/results").select("doc_id", "anomalies", "high"), "doc_id", "left")


def k6(s, d):
    """Contents seen for the first time within their time to live, over files of ten days each."""
    own = J.to_table(J.first_seen(_stream(s, d), "ts", "props", "7 days"), "append", "seen")
    return own.select(F.to_date("ts").alias("day"), "props").groupBy("props").agg(F.count("*").alias("times"))


def k6b(s, d):
    """Results of contents that come again within 14 days of an error's, or 7 of another's, over three files."""
    days = F.when(F.col("event_type") == "error", 14).otherwise(7)
    rows = _stream(s, d).select("event_id", "ts", "props", "value", days.alias("days"))
    return state.reuse_results(rows, shared_dir(s, "reused"), "event_id", "ts", "props", "value", "days")


_ENT = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_X = "coalesce(html, '')"
for _tag in C.BLOCKS:
    _X = f"regexp_replace({_X}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_X = f"regexp_replace({_X}, '(?s)<[^>]+>', '', 'g')"
_CHUNK = r"""
d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 51) + 1, 450)) AS a FROM d WHERE len(w) > 500),
u AS (SELECT doc_id, 0 AS k, text AS chunk FROM d WHERE len(w) <= 500 UNION ALL SELECT doc_id, a // 450, array_to_string(w[a + 1:a + 500], ' ') FROM st),
v AS (SELECT doc_id || '_chunk_' || k AS chunk_key, doc_id, left(chunk, 1000) AS text, CAST(doc_id % 2 AS VARCHAR) AS namespace FROM u)"""
_EVENT_DAY = "SELECT CAST(ts AS DATE) AS day, count(*) AS detections FROM events GROUP BY 1"

PLANS: Plans = {
    "a10_report": (a10, f"WITH {ANOMALIES} SELECT severity, count(*) AS n, count(DISTINCT document_id) AS documents FROM a GROUP BY severity"),
    "a01_a02_corpus_folder": (a1, "SELECT doc_id, lang AS category, md5(text) AS text_md5 FROM documents WHERE lang IN ('de', 'fr', 'en')"),
    "a03_page_text": (a3, f"SELECT * FROM (SELECT page_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_ENT.format(x=_X)}, chr(10)), lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda x: x <> ''), chr(10)) AS text FROM pages) WHERE length(text) >= 500"),
    "a06_vector_upsert": (a6, f"WITH {_CHUNK} SELECT chunk_key, doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN 'rewritten' ELSE text END) AS text_md5, namespace FROM v"),
    "a07_g04_delete": (a7, f"WITH {_CHUNK} SELECT chunk_key FROM v WHERE doc_id % 3 <> 1"),
    "a08_replace": (a8, f"WITH {ANOMALIES}, r AS (SELECT document_id, anomaly_id, severity FROM a WHERE document_id NOT IN (SELECT document_id FROM a WHERE document_id % 4 = 0 AND anomaly_id % 2 = 0) UNION ALL SELECT document_id, anomaly_id, 'high' FROM a WHERE document_id % 4 = 0 AND anomaly_id % 2 = 0) SELECT document_id, count(*) AS anomalies, count(*) FILTER (severity = 'high') AS high FROM r GROUP BY document_id"),
    "a07_a08_versioned_tables": (
        a7_store,
        f"""WITH {_CHUNK}, {ANOMALIES}, gone AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 1), e AS (SELECT document_id AS doc_id, anomaly_id, document_id % 4 = 0 AND anomaly_id % 2 = 0 AS new FROM a),
l AS (SELECT * FROM e WHERE new OR doc_id NOT IN (SELECT doc_id FROM e WHERE new))
SELECT 'documents' AS "table", doc_id, count(*) AS n, NULL AS replaced FROM documents WHERE doc_id NOT IN (FROM gone) GROUP BY doc_id
UNION ALL SELECT 'chunks', doc_id, count(*), NULL FROM v WHERE doc_id NOT IN (FROM gone) GROUP BY doc_id
UNION ALL SELECT 'anomalies', doc_id, count(*), count(*) FILTER (new) FROM l WHERE doc_id NOT IN (FROM gone) GROUP BY doc_id""",
    ),
    "a15_metadata_merge": (a15, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'x' END ELSE o_orderstatus END AS kind, o_orderpriority AS note FROM orders"),
    "k01_recalibration_stream": (
        k1,
        """WITH e AS (SELECT event_id, ts, CASE WHEN dayofmonth(ts) <= 10 THEN 0 WHEN dayofmonth(ts) <= 20 THEN 1 ELSE 2 END AS batch, event_id % 5 AS act FROM events WHERE event_id % 5 < 4 AND least(value / 500, 1.0) BETWEEN 0 AND 1),
p AS (SELECT *, (row_number() OVER (ORDER BY batch, ts, event_id) - 1) // 100 AS g FROM e),
f AS (SELECT g, max(batch) AS batch, count(*) AS n, count(*) FILTER (act < 2) AS correct, count(*) FILTER (act = 2) AS dismissed FROM p GROUP BY g HAVING count(*) = 100)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS generations, CAST(sum(n) AS BIGINT) AS n, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(dismissed) AS BIGINT) AS dismissed, count(*) FILTER (dismissed > 20 AND correct BETWEEN 1 AND 99) AS warned FROM f GROUP BY batch""",
    ),
    "k02_feedback_state": (k2, "SELECT user_id, count(*) AS size, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS dismissal_rate, round(count(*) FILTER (event_type <> 'view') / count(*), 6) AS accuracy FROM events GROUP BY user_id"),
    "k03_daily_stream": (k3, _EVENT_DAY),
    "k04_weekly_stream": (k4, "SELECT CAST(s AS DATE) AS start, count(*) AS detections FROM (SELECT unnest(range(CAST(ts AS DATE) - INTERVAL 6 DAY, CAST(ts AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s FROM events) GROUP BY 1"),
    "k03_closed_days": (
        k3b,
        """WITH b AS (SELECT CAST(ts AS DATE) AS day, dayofmonth(ts) - 1 AS k, ts FROM events), p AS (SELECT *, CASE WHEN k < 10 THEN 0 WHEN k BETWEEN 15 AND 24 THEN 1 WHEN k BETWEEN 25 AND 27 THEN 2 WHEN k BETWEEN 10 AND 14 THEN 3 ELSE 4 END AS batch FROM b),
w AS (SELECT batch, max(ts) OVER (ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - INTERVAL 1 DAY AS mark FROM (SELECT batch, max(ts) AS ts FROM p GROUP BY batch)),
l AS (SELECT p.*, (SELECT mark FROM w WHERE w.batch = p.batch - 2) AS before FROM p)
SELECT day, count(*) AS detections FROM l WHERE (before IS NULL OR day + INTERVAL 1 DAY > before) AND day + INTERVAL 1 DAY <= (SELECT max(mark) FROM w) GROUP BY day""",
    ),
    "k04_closed_weeks": (
        k4b,
        "SELECT CAST(s AS DATE) AS start, count(*) AS detections FROM (SELECT unnest(range(CAST(ts AS DATE) - INTERVAL 6 DAY, CAST(ts AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s FROM events) WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1",
    ),
    "k05_arrivals_stream": (
        k5,
        f"""WITH {_CLAUSES}, ca AS (SELECT * FROM clause WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) >= 200)), {_found_sql('ca', 'doc_id, section_no, clause_no', 'clause_text')},
e AS (SELECT doc_id, section_no, clause_no, bool_or(severity = 'high') AS h FROM found GROUP BY ALL), g AS (SELECT doc_id, count(*) AS anomalies, count(*) FILTER (h) AS high FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) >= 200 THEN 'processing,completed' ELSE 'processing,failed' END AS status, anomalies, high FROM (SELECT doc_id, text FROM documents) LEFT JOIN g USING (doc_id)""",
    ),
    "k06_first_seen_stream": (k6, None),
    "k06_h39_stored_results": (
        k6b,
        """WITH RECURSIVE e AS (SELECT event_id, ts, props, value, CASE WHEN event_type = 'error' THEN 14 ELSE 7 END AS days FROM events WHERE props IS NOT NULL AND ts IS NOT NULL),
m AS (
SELECT props, min({'ts': ts, 'event_id': event_id, 'value': value, 'days': days}) AS r FROM e GROUP BY props
UNION ALL
SELECT m.props, min({'ts': e.ts, 'event_id': e.event_id, 'value': e.value, 'days': e.days}) FROM m JOIN e ON e.props = m.props AND e.ts >= m.r.ts + to_days(m.r.days) GROUP BY m.props),
c AS (SELECT props, r.ts AS ts, r.event_id AS source, r.value AS value FROM m)
SELECT e.event_id, e.event_id <> c.source AS hit, c.source, c.value FROM e ASOF JOIN c ON e.props = c.props AND e.ts >= c.ts""",
    ),
}
