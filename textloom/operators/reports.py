"""Lists, corpus statistics, comparison, cost and monitoring reports. Dates and "now" are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.rules import fixed


def page(rows: DataFrame, order: list, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of a totally ordered list."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def anomaly_list(rows: DataFrame, severity: str | None = None, section: str | None = None, skip: int = 0, limit: int = 20, item: str = "anomaly_id") -> DataFrame:
    """Filtered, by severity and then prevalence."""
    out = rows
    if severity:
        out = out.filter(F.col("severity") == severity)
    if section:
        out = out.filter(F.col("section").ilike(f"%{section}%"))
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return page(out, [rank, "prevalence", item], skip, limit)


def severity_counts(rows: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def with_counts(documents: DataFrame, anomalies: DataFrame, key: str = "document_id") -> DataFrame:
    """Every document with the number of its anomalies, 0 if none; anomalies are summed before the join."""
    counts = anomalies.groupBy(key).agg(F.count("*").alias("anomalies"))
    return documents.join(counts, key, "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))


def global_metrics(documents: DataFrame, anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: documents, anomalies, alerts for a document, dismissal rate and health."""
    d, a = documents.agg(F.count("*").alias("documents")), anomalies.agg(F.count("*").alias("anomalies"))
    f = feedback.agg((F.count_if(F.col("user_action") == "dismissed") / F.greatest(F.count("*"), F.lit(1))).alias("dismissal_rate"))
    out = d.join(F.broadcast(a)).join(F.broadcast(f))
    rate = F.col("dismissal_rate")
    return out.withColumn("alerts_per_document", F.col("anomalies") / F.greatest(F.col("documents"), F.lit(1))).withColumn("health", F.when(rate > 0.40, "critical").when(rate > 0.25, "warning").otherwise("healthy"))


def top_flags(rows: DataFrame, flag: str, n: int = 5) -> DataFrame:
    """The most frequent flags."""
    return rows.groupBy(flag).count().orderBy(F.desc("count"), flag).limit(n)


def daily_metrics(rows: DataFrame, ts: str = "created_at", document: str = "document_id", seconds: str = "seconds", most_alerts: float = 5.0, most_p95: float = 30.0) -> DataFrame:
    """Per day: detections, documents, their ratio, 95th percentile of the time taken, and status."""
    own = rows.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("detections"), F.count_distinct(document).alias("documents"), F.percentile(seconds, 0.95).alias("p95"))
    out = own.select(F.col("w.start").cast("date").alias("day"), "detections", "documents", (F.col("detections") / F.greatest(F.col("documents"), F.lit(1))).alias("alerts_per_document"), "p95")
    bad = (F.col("alerts_per_document") > most_alerts).cast("int") + (F.col("p95") > most_p95).cast("int")
    return out.withColumn("alerts", bad).withColumn("status", F.when(bad > 0, "DEGRADED").otherwise("HEALTHY"))


def weekly_trend(rows: DataFrame, as_of: Column, weeks: int = 8, ts: str = "created_at", document: str = "document_id", inclusive: bool = False) -> DataFrame:
    """The last ``weeks`` weeks before ``as_of``, oldest first, empty ones too. ``inclusive`` counts boundary days in both weeks."""
    spark = rows.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(weeks - 1), F.lit(0), F.lit(-1))).alias("back")).select((weeks - F.col("back")).alias("week"), F.date_sub(as_of, F.col("back") * 7 + 7).alias("start"), F.date_sub(as_of, F.col("back") * 7).alias("end"))
    day = F.col(ts).cast("date")
    inside = (F.col("_d") >= F.col("start")) & ((F.col("_d") <= F.col("end")) if inclusive else (F.col("_d") < F.col("end")))
    counted = rows.select(day.alias("_d"), F.col(document).alias("_doc")).join(F.broadcast(calendar), inside)  # a row for each week
    own = counted.groupBy("week").agg(F.count("*").alias("detections"), F.count_distinct("_doc").alias("documents"))
    out = calendar.join(own, "week", "left").fillna(0, ["detections", "documents"])
    return out.withColumn("alerts_per_document", F.when(F.col("documents") > 0, F.col("detections") / F.col("documents")).otherwise(0.0))


def trend_direction(weekly: DataFrame) -> DataFrame:
    """First half of the weeks against the second, for alerts and detections, and overall; one row."""
    numbered = weekly.withColumn("n", F.count("*").over(Window.partitionBy()))
    first = F.col("week") <= F.floor(F.col("n") / 2)

    def direction(c: str) -> Column:
        a, b = F.avg(F.when(first, F.col(c))), F.avg(F.when(~first, F.col(c)))
        change = F.when(a > 0, (b - a) / F.when(a > 0, a) * 100).otherwise(0.0)
        return F.when(F.abs(change) < 10, "STABLE").when(change > 0, "INCREASING").otherwise("DECREASING")

    out = numbered.agg(F.count("*").alias("weeks"), direction("alerts_per_document").alias("alerts_trend"), direction("detections").alias("detections_trend"))
    overall = F.when(F.col("weeks") < 2, "INSUFFICIENT_DATA").when(F.col("alerts_trend") == "INCREASING", "DEGRADING").when((F.col("alerts_trend") == "DECREASING") & (F.col("detections_trend") == "STABLE"), "IMPROVING").otherwise("STABLE")
    out = out.withColumn("overall_trend", overall)
    # what isn't known well enough is advised as what is stable
    said = F.array(*map(F.lit, fixed.TREND_ADVICE["STABLE"]))
    for name, texts in fixed.TREND_ADVICE.items():
        said = F.when(F.col("overall_trend") == name, F.array(*map(F.lit, texts))).otherwise(said)
    more = F.when(F.col("alerts_trend") == "INCREASING", F.array(F.lit(fixed.INCREASE_ADVICE))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("recommendations", F.array_join(F.concat(said, more), " "))


def route(stage1: DataFrame, stage2: DataFrame, key: str, threshold: float = 0.55) -> DataFrame:
    """Results below the threshold take the second stage's where there is one; costs add up."""
    both = stage1.join(stage2.select(key, F.col("confidence").alias("_c2"), F.col("risk").alias("_r2"), F.col("cost").alias("_k2")), key, "left")
    low = F.col("confidence") < threshold
    use = low & F.col("_c2").isNotNull()
    agree = F.when(~use, "not_checked").when(F.col("risk") == F.col("_r2"), "confirmed").otherwise("refined")
    return both.select(key, low.alias("escalated"), F.when(use, 2).otherwise(1).alias("stage"), F.when(use, F.col("_r2")).otherwise(F.col("risk")).alias("final_risk"), F.when(use, F.col("_c2")).otherwise(F.col("confidence")).alias("final_confidence"), (F.col("cost") + F.when(use, F.col("_k2")).otherwise(0.0)).alias("total_cost"), agree.alias("agreement"))


def stage_agreement(routed: DataFrame) -> DataFrame:
    """Results by how the stages agree, and ``all``: their number, final risks, and the share in which the first stage was right (or not checked)."""
    level = lambda x: F.count_if(F.col("final_risk") == x).alias(x)
    right = (F.count_if(F.col("agreement") != "refined") / F.count("*")).alias("stage1_correct")
    out = routed.rollup("agreement").agg(F.count("*").alias("n"), level("high"), level("medium"), level("low"), right)
    return out.withColumn("agreement", F.coalesce("agreement", F.lit("all")))


def cost_summary(routed: DataFrame, single_cost: float = 0.015, target: float = 0.0039) -> DataFrame:
    """Totals of a routed batch against running everything once at ``single_cost``; one row."""
    n = F.greatest(F.count("*"), F.lit(1))
    out = routed.agg(F.count("*").alias("analyses"), F.sum("total_cost").alias("total_cost"), (F.sum("total_cost") / n).alias("average_cost"), (F.count_if("escalated") / n).alias("escalation_rate"), F.count_if(F.col("agreement") == "confirmed").alias("confirmed"), F.count_if(F.col("agreement") == "refined").alias("refined"))
    return out.withColumn("savings", F.lit(1.0) - F.col("average_cost") / single_cost).withColumn("meets_target", F.col("average_cost") <= target)


def compare(anomalies: DataFrame, key: str = "document_id", category: str = "category") -> DataFrame:
    """One row: range of risk, largest and smallest counts, best and worst document, categories that not all have."""
    own = anomalies.groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)) / F.count("*") * 3.33).alias("risk"))
    ranked = own.agg(F.count("*").alias("documents"), (F.max("risk") - F.min("risk")).alias("risk_range"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.min(F.struct("risk", key))[key].alias("best"), F.max(F.struct(F.col("risk").alias("risk"), (-F.col(key)).alias("k")))["k"].alias("_w"))
    spread = anomalies.select(key, category).distinct().groupBy(category).agg(F.count("*").alias("have"))
    partial = spread.join(F.broadcast(ranked.select("documents"))).agg(F.count_if(F.col("have") < F.col("documents")).alias("uneven_categories"))
    return ranked.join(F.broadcast(partial)).select("documents", "risk_range", "most", "fewest", "best", (-F.col("_w")).alias("worst"), "uneven_categories", (F.col("risk_range") > 2).alias("risk_differs"), (F.col("most") > 2 * F.col("fewest")).alias("counts_differ"))


def corpus_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents, characters and their mean, least, greatest and upper median; one row. The median is a rank, not a list."""
    own = docs.select(F.col(key), F.length(text).alias("chars"))
    exact = own.agg(F.count("*").alias("documents"), F.sum("chars").alias("total_chars"), F.avg("chars").alias("mean_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.count("chars").alias("_n"))
    counts = own.filter("chars IS NOT NULL").groupBy("chars").count()
    upto = counts.withColumn("_upto", F.sum("count").over(Window.orderBy("chars")))  # a row for each distinct length
    median = upto.join(F.broadcast(exact.select("_n"))).filter(F.col("_upto") > F.floor(F.col("_n") / 2)).agg(F.min("chars").alias("upper_median"))
    return exact.join(F.broadcast(median)).drop("_n")


def category_balance(docs: DataFrame, category: str) -> DataFrame:
    """Documents of each category, their share, and how near that is to an equal one."""
    own = docs.groupBy(category).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    total, expected = F.sum("n").over(every), F.avg("n").over(every)
    return own.withColumn("share", F.col("n") / total).withColumn("balance", 1 - F.abs(F.col("n") - expected) / total)


def corpus_quality(balance: DataFrame, mean_pages: float, target: int = 100, least: int = 15) -> DataFrame:
    """Completeness, diversity and length scores, weighed 0.4, 0.3 and 0.3; number of categories below ``least``."""
    length = 1.0 if mean_pages >= 5 else 0.8 if mean_pages >= 3 else 0.5
    out = balance.agg(F.least(F.sum("n") / target, F.lit(1.0)).alias("completeness"), F.avg("balance").alias("diversity"), F.count_if(F.col("n") < least).alias("small_categories"))
    return out.withColumn("length_score", F.lit(length)).withColumn("quality", F.col("completeness") * 0.4 + F.col("diversity") * 0.3 + F.col("length_score") * 0.3)


def validate_documents(docs: DataFrame, common: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Issues and warnings of each document, and whether it is valid."""
    n, solid = F.length(text), F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]", ""))
    issues = F.array_compact(F.array(F.when(n < 500, "text_too_short"), F.when(solid < 300, "mostly_blank")))
    warnings = F.array_compact(F.array(F.when(common < 5, "language"), F.when(n > 100_000, "very_long")))
    return docs.select(key, F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"), (F.size(issues) == 0).alias("valid"))


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Required fields that are null or blank in each row that has any."""
    own = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in fields]))
    return rows.select(key, F.array_join(own, ",").alias("missing")).filter("missing <> ''")


def reuse(requests: DataFrame, results: DataFrame, as_of: Column, hash_column: str = "hash") -> DataFrame:
    """Requests with the newest result of the same content that is still fresh: 14 days if sure or of stage 2, else 7. Texts under 1000 characters are never kept."""
    days = F.when((F.col("confidence") > 0.85) | (F.col("stage") == 2), 14).otherwise(7)
    fresh = results.filter(F.col("chars") >= 1000).filter(F.date_add(F.col("ts").cast("date"), days) > as_of)
    last = fresh.groupBy(hash_column).agg(F.max(F.struct("ts", "result")).alias("r"))
    return requests.join(last, hash_column, "left").withColumn("hit", F.col("r").isNotNull()).withColumn("result", F.col("r.result")).drop("r")


# --- lists with totals, and the remaining reports
def page_with_total(rows: DataFrame, order: list, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of a totally ordered list, each row with the ``total`` of the whole list; the total is one row, joined."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, skip, limit).join(F.broadcast(total))


def page_after(rows: DataFrame, order: list[tuple[str, bool]], last: dict | None = None, limit: int = 20) -> DataFrame:
    """The ``limit`` rows that follow ``last``, in the order of ``order`` (column, descending); the first page without ``last``.

    ``last`` holds the order columns of the page before's last row. Rows before it are filtered by these, where an
    offset would sort and drop them: each task sends ``limit`` rows, however deep the page.
    The columns identify a row and aren't null.
    """
    if last is not None:
        beyond = F.lit(False)
        for name, descending in reversed(order):
            ahead = F.col(name) < F.lit(last[name]) if descending else F.col(name) > F.lit(last[name])
            beyond = ahead | ((F.col(name) == F.lit(last[name])) & beyond)
        rows = rows.filter(beyond)
    return rows.orderBy(*(F.col(name).desc() if descending else F.col(name).asc() for name, descending in order)).limit(limit)


def dashboard(documents: DataFrame, count: str = "anomalies", many: int = 5) -> DataFrame:
    """One row: documents, their anomalies, and those with more than ``many``."""
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(count), F.lit(0)).alias("anomalies"), F.count_if(F.col(count) > many).alias("documents_over"))


def with_statistics(documents: DataFrame, anomalies: DataFrame, key: str = "document_id", category: str = "category") -> DataFrame:
    """Every document with the number of its anomalies, its high ones, and their categories; 0 and empty if none. Sums come before the join."""
    own = anomalies.groupBy(key).agg(
        F.count("*").alias("anomaly_count"), F.count_if(F.col("severity") == "high").alias("high_risk_count"), F.array_join(F.array_sort(F.collect_set(F.col(category).cast("string"))), ",").alias("categories")
    )
    return documents.join(own, key, "left").fillna(0, ["anomaly_count", "high_risk_count"]).fillna("", ["categories"])


def anomaly_statistics(rows: DataFrame, flag: str, n: int = 5) -> DataFrame:
    """One row: total, severities, mean prevalence, and the ``n`` most frequent flags."""
    total = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.avg("prevalence").alias("average_prevalence"))
    flags = rows.groupBy(flag).count().orderBy(F.desc("count"), flag).limit(n)
    listed = flags.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), F.col(flag).alias("f")))).alias("l"))
    named = F.array_join(F.transform("l", lambda x: F.concat(x["f"].cast("string"), F.lit(" "), (-x["m"]).cast("string"))), ", ")
    return total.join(F.broadcast(listed)).withColumn("common_flags", named).drop("l")


#: Metric, how bad it is to exceed it, and from where on.
THRESHOLDS = (("false_positive_rate", "HIGH", 0.05), ("dismissal_rate", "MEDIUM", 0.20), ("alerts_per_document", "MEDIUM", 5.0), ("p95", "LOW", 30.0))


def daily_report(rows: DataFrame, feedback: DataFrame, ts: str = "created_at", document: str = "document_id", seconds: str = "seconds", thresholds: tuple = THRESHOLDS, accuracy: int | None = None) -> DataFrame:
    """``daily_metrics`` with each day's feedback: actions, rates, the alerts by name, and status.

    ``accuracy`` makes the percentile approximate (``percentile_approx``), so that a day's values are not all kept.
    """
    day = F.to_date(ts).alias("day")
    p95 = F.percentile(seconds, 0.95) if accuracy is None else F.percentile_approx(seconds, 0.95, accuracy)
    own = rows.groupBy(day).agg(F.count("*").alias("detections"), F.count_distinct(document).alias("documents"), p95.alias("p95"))
    is_a = lambda a: F.count_if(F.col("user_action") == a)
    said = feedback.groupBy(day).agg(F.count("*").alias("feedback"), *[is_a(a).alias(a) for a in ("helpful", "acted_on", "dismissed", "false_positive")])
    out = own.join(said, "day", "left").fillna(0, ["feedback", "helpful", "acted_on", "dismissed", "false_positive"])
    n = F.greatest(F.col("feedback"), F.lit(1))
    out = out.withColumns({
        "alerts_per_document": F.col("detections") / F.greatest(F.col("documents"), F.lit(1)),
        "helpful_rate": (F.col("helpful") + F.col("acted_on")) / n,
        "dismissal_rate": F.col("dismissed") / n,
        "false_positive_rate": F.col("false_positive") / n,
    })
    alerts = F.array_compact(F.array(*[F.when(F.col(m) > limit, F.lit(f"{level} {m}")) for m, level, limit in thresholds]))
    return out.withColumn("alerts", F.array_join(alerts, ", ")).withColumn("status", F.when(F.size(alerts) > 0, "DEGRADED").otherwise("HEALTHY"))


def cost_report(logs: DataFrame, order: list, last: int = 1000, single_cost: float = 0.015, target: float = 0.0039, target_escalation: float = 24.0) -> DataFrame:
    """One row over the ``last`` logs: costs, escalation, savings, stages, time, and all that against the targets in percent."""
    own = logs.orderBy(*order).limit(last)
    n = F.greatest(F.count("*"), F.lit(1))
    out = own.agg(
        F.count("*").alias("analyses"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        (F.coalesce(F.sum("total_cost"), F.lit(0.0)) / n).alias("average_cost"),
        (F.count_if("escalated") / n * 100).alias("escalation_rate"),
        F.count_if(F.col("stage") == 1).alias("stage1_only"),
        F.count_if(F.col("stage") == 2).alias("stage2_escalated"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("average_time"),
    )
    single = F.col("analyses") * single_cost
    out = out.withColumn("total_savings", single - F.col("total_cost")).withColumn("percent_savings", F.when(single > 0, F.col("total_savings") / single * 100).otherwise(0.0))
    return out.withColumn("cost_vs_target", (F.col("average_cost") - target) / target * 100).withColumn("escalation_vs_target", (F.col("escalation_rate") - target_escalation) / target_escalation * 100)


def analysis_history(logs: DataFrame, key: str, ts: str, item: str, single_cost: float = 0.015) -> DataFrame:
    """Each document's analyses, newest first (``place``), with what each saved against ``single_cost`` in percent, one place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(item)))
    saved = F.when(F.col("total_cost") == 0, 0.0).otherwise(F.round((single_cost - F.col("total_cost")) / single_cost * 100, 1))
    return logs.withColumn("place", place).withColumn("cost_efficiency", saved)


def findings(results: DataFrame, key: str = "document_id", clauses: str = "clauses", kept: tuple[str, ...] = fixed.PROBLEMS, most: int = 5000) -> DataFrame:
    """Rows to store from results whose ``clauses`` (an array of structs) are of a problem class; fields that are missing get defaults.

    A clause has ``classification``, ``section``, ``clause_id``, ``risk_level``, ``reason``, ``legal_reasoning``, ``risk_category``.
    """
    own = results.select(key, F.posexplode(clauses).alias("place", "c")).filter(F.col("c.classification").isin(*kept))
    said = F.coalesce("c.legal_reasoning", "c.reason", F.lit(""))
    return own.select(
        key,
        "place",
        F.coalesce("c.section", F.lit("Unknown")).alias("section"),
        F.coalesce("c.clause_id", F.lit("")).alias("clause_number"),
        F.left(said, F.lit(most)).alias("clause_text"),
        F.coalesce("c.risk_level", F.lit("medium")).alias("severity"),
        said.alias("explanation"),
        F.coalesce("c.risk_category", F.lit("other")).alias("risk_category"),
        F.lit(0.0).alias("prevalence"),
    )


def analysis_logs(results: DataFrame, key: str = "document_id", clauses: str = "clauses", top: int = 10) -> DataFrame:
    """For each result its number of clauses, of each level, and the ids of the first ``top`` high ones."""
    level = lambda s: F.size(F.filter(clauses, lambda c: c["risk_level"] == s))
    first = F.slice(F.transform(F.filter(clauses, lambda c: c["risk_level"] == "high"), lambda c: c["clause_id"]), 1, top)
    return results.select(key, F.size(clauses).alias("anomaly_count"), level("high").alias("high_risk_count"), level("medium").alias("medium_risk_count"), level("low").alias("low_risk_count"), F.array_join(first, ",").alias("top_ids"))


def comparison(documents: DataFrame, anomalies: DataFrame, key: str = "document_id", name: str = "name", category: str = "category") -> DataFrame:
    """What documents (``key``, ``name``, ``risk_score``) differ in: ``kind`` and ``description`` rows, and a ``recommendation`` row.

    A range of risk above 2, a greatest count over twice the least, and every category that
    only some have. Summaries are rows of their own: ``document`` with name, score and counts.
    """
    summary = with_statistics(documents, anomalies, key, category)
    shown = summary.select(F.lit("document").alias("kind"), F.format_string("%s: %.1f, %d anomalies, %d high, %s", F.col("name"), F.col("risk_score"), F.col("anomaly_count"), F.col("high_risk_count"), F.col("categories")).alias("description"))
    best = F.min_by(F.struct(name, "risk_score", "high_risk_count"), F.struct("risk_score", key))
    worst = F.max_by(F.struct(name, "risk_score", "high_risk_count"), F.struct(F.col("risk_score"), F.negative(key)))
    whole = summary.agg(
        F.count("*").alias("n"), F.min("risk_score").alias("low"), F.max("risk_score").alias("high"), F.min("anomaly_count").alias("fewest"), F.max("anomaly_count").alias("most"), best.alias("best"), worst.alias("worst")
    )
    have = anomalies.join(documents.select(key), key, "left_semi").select(key, F.col(category).cast("string").alias("c")).distinct().groupBy("c").agg(F.count("*").alias("have"))
    uneven = have.join(F.broadcast(whole.select("n"))).filter("have < n")
    apart = whole.filter("high - low > 2").select(F.lit("risk_score").alias("kind"), F.format_string("Significant difference in risk levels: %.1f to %.1f", "low", "high").alias("description"))
    counts = whole.filter("most > fewest * 2").select(F.lit("anomaly_count").alias("kind"), F.format_string("Large difference in concerning clauses: %d to %d", "fewest", "most").alias("description"))
    some = uneven.select(F.concat(F.lit("category "), F.col("c")).alias("kind"), F.format_string("Only %d of %d documents have %s concerns", "have", "n", "c").alias("description"))
    found = apart.unionByName(counts).unionByName(some)
    number = found.agg(F.count("*").alias("d"))
    text = F.format_string("Best: %s with risk score %.1f/10. Most concerning: %s with risk score %.1f/10 and %d high-risk clauses. %d variations found.", F.col(f"best.{name}"), F.col("best.risk_score"), F.col(f"worst.{name}"), F.col("worst.risk_score"), F.col("worst.high_risk_count"), F.col("d"))
    advice = whole.join(F.broadcast(number)).select(F.lit("recommendation").alias("kind"), text.alias("description"))
    return shown.unionByName(found).unionByName(advice)


def corpus_by_method(docs: DataFrame, method: str, pages: str, text: str = "text") -> DataFrame:
    """Documents, pages and characters of each extraction method and of all (``all``): totals, mean, least, greatest."""
    own = docs.select(F.col(method).cast("string").alias("method"), F.col(pages).alias("p"), F.length(text).alias("c"))
    out = own.rollup("method").agg(
        F.count("*").alias("documents"), F.sum("p").alias("total_pages"), F.avg("p").alias("mean_pages"), F.min("p").alias("min_pages"), F.max("p").alias("max_pages"), F.sum("c").alias("total_chars"), F.avg("c").alias("mean_chars"), F.min("c").alias("min_chars"), F.max("c").alias("max_chars")
    )
    return out.withColumn("method", F.coalesce("method", F.lit("all")))


def quality_report(docs: DataFrame, category: str, pages: str, target: int = 100, least: int = 15) -> DataFrame:
    """``corpus_quality`` with the mean number of pages taken from the documents, and the categories to add to."""
    own = category_balance(docs, category)
    mean = docs.agg(F.avg(pages).alias("mean_pages"))
    small = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") < least, F.concat(F.col(category), F.lit(" needs "), (least - F.col("n")).cast("string"))))), ", ")
    out = own.agg(F.least(F.sum("n") / target, F.lit(1.0)).alias("completeness"), F.avg("balance").alias("diversity"), small.alias("recommendations")).join(F.broadcast(mean))
    length = F.when(F.col("mean_pages") >= 5, 1.0).when(F.col("mean_pages") >= 3, 0.8).otherwise(0.5)
    return out.withColumn("length_score", length).withColumn("quality", F.col("completeness") * 0.4 + F.col("diversity") * 0.3 + F.col("length_score") * 0.3)


def validate_corpus(docs: DataFrame, common: Column, pages: str, method: str, key: str = "doc_id", text: str = "text", fallback: tuple[str, ...] = ("ocr",)) -> DataFrame:
    """``key``, ``issues``, ``warnings``, ``valid``, ``pages``, ``chars``: also too few pages, and a method of last resort."""
    n, solid = F.coalesce(F.length(text), F.lit(0)), F.coalesce(F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]", "")), F.lit(0))
    issues = F.array_compact(F.array(F.when(F.col(pages) < 2, "too_few_pages"), F.when(n < 500, "text_too_short"), F.when(solid < 300, "mostly_blank")))
    warnings = F.array_compact(F.array(F.when(common < 5, "language"), F.when(F.col(method).isin(*fallback), "fallback_method"), F.when(n > 100_000, "very_long")))
    return docs.select(key, F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"), (F.size(issues) == 0).alias("valid"), F.col(pages).alias("pages"), n.alias("chars"))


def validation_totals(validated: DataFrame) -> DataFrame:
    """One row: documents, valid ones, those with warnings, and pages and characters of the valid ones only."""
    v = F.col("valid")
    only = lambda c: F.when(v, F.col(c))
    return validated.agg(
        F.count("*").alias("total"), F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"), F.count_if(F.col("warnings") != "").alias("with_warnings"),
        F.avg(only("pages")).alias("mean_pages"), F.sum(only("chars")).alias("total_chars"), F.avg(only("chars")).alias("mean_chars"), F.min(only("chars")).alias("min_chars"), F.max(only("chars")).alias("max_chars"),
    )


def reuse_statistics(requests: DataFrame, cost: float = 0.0039) -> DataFrame:
    """One row over requests with ``hit``: hits, hit rate in percent and the cost saved."""
    n = F.greatest(F.count("*"), F.lit(1))
    return requests.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), (F.count_if("hit") / n * 100).alias("hit_rate"), (F.count_if("hit") * cost).alias("saved_cost"))


def invalidate(results: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Stored results without those of the given documents."""
    return results.join(documents.select(key).distinct(), key, "left_anti")
