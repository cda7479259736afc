"""Evidence combined into scores: methods, context, time, compounds, alerts and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import lookup, risk_level
from textloom.operators.matching import fuzzy_member, rule_table
from textloom.rules import fixed
from textloom.session import cut


# --- detection and severity
def pattern_confidence(high: Column, medium: Column) -> Column:
    return F.when((high + medium) > 0, F.least(F.lit(1.0), 0.5 + 0.2 * high + 0.1 * medium)).otherwise(0.0)


def stage_one(pattern: Column, semantic: Column, statistical: Column, weights: tuple[float, float, float] = fixed.METHOD_WEIGHTS) -> Column:
    """Weighted confidence of the three methods; a missing one counts 0."""
    parts = [F.coalesce(c, F.lit(0.0)) * w for c, w in zip((pattern, semantic, statistical), weights)]
    return parts[0] + parts[1] + parts[2]


def clause_severity(high: Column, medium: Column, prevalence: Column) -> Column:
    return F.when(high > 0, "high").when(medium > 0, "medium").when(prevalence < 0.30, "low").otherwise("medium")


# --- context
def industry_score(base: Column, prevalence: Column, strict: Column, prohibited: Column) -> Column:
    """Base by prevalence, strict category and prohibited term; 10 at most, two places. With the adjustments made."""
    rate = F.when(prevalence >= 0.70, 0.5).when(prevalence < 0.30, 1.3).otherwise(1.0)
    score = F.least(base * rate * F.when(strict, 1.5).otherwise(1.0) * F.when(prohibited, 1.5).otherwise(1.0), F.lit(10.0))
    notes = F.array_compact(F.array(F.when(prevalence >= 0.70, "common"), F.when(prevalence < 0.30, "rare"), F.when(strict, "strict"), F.when(prohibited, "prohibited")))
    return F.struct(F.round(score, 2).alias("score"), F.array_join(notes, ",").alias("adjustments"))


def industry_reasoning(industry: Column, base: Column, prevalence: Column, category: Column, strict: Column, prohibited: Column) -> Column:
    """What ``industry_score`` did, in words. ``prohibited``: the terms found, null or empty for none. Prevalence is told in whole percent, halves up.

    Nulls: an unknown prevalence gives no sentence; an unknown ``industry`` is called so.
    """
    say, name = fixed.INDUSTRY_REASONS, F.coalesce(industry, F.lit("Unknown industry"))
    percent = F.floor(prevalence * 100 + 0.5)
    any_term = F.size(F.coalesce(prohibited, F.array().cast("array<string>"))) > 0
    raw = base * F.when(prevalence >= 0.70, 0.5).when(prevalence < 0.30, 1.3).otherwise(1.0) * F.when(strict, 1.5).otherwise(1.0) * F.when(any_term, 1.5).otherwise(1.0)
    parts = F.array(
        F.format_string(say["industry"], name),
        F.when(prevalence >= 0.70, F.format_string(say["common"], name, percent)).when(prevalence < 0.30, F.format_string(say["rare"], name, percent)),
        F.when(strict, F.format_string(say["strict"], category, name)),
        F.when(any_term, F.format_string(say["prohibited"], name, F.array_join(F.slice(prohibited, 1, 3), ", "))),
        F.when(raw > 10, F.lit(say["capped"])),
    )
    return F.concat(F.array_join(F.array_compact(parts), ". "), F.lit("."))


def service_reason(classification: Column, category: Column, service: Column) -> Column:
    """Why ``service_decision`` kept or dropped an indicator; a null category or service reads ``unknown``."""
    what, where = F.coalesce(category, F.lit("unknown")), F.coalesce(service, F.lit("unknown"))
    out = F.format_string(fixed.SERVICE_UNKNOWN, where)
    for name, text in fixed.SERVICE_REASONS.items():
        out = F.when(classification == name, F.format_string(text, what, where)).otherwise(out)
    return out


def service_decision(category: Column, expected: Column, alarming: Column, disclosure: Column, clear: Column, known: Column) -> Column:
    """Keep or drop an indicator for its service: alarming, expected with or without disclosure, expected, or neutral."""
    is_alarming, is_expected, needs = (fuzzy_member(category, c) for c in (alarming, expected, disclosure))

    def verdict(keep: bool, confidence: float, name: str) -> Column:
        return F.struct(F.lit(keep).alias("keep"), F.lit(confidence).alias("context_confidence"), F.lit(name).alias("classification"))

    return (
        F.when(~known, verdict(True, 0.5, "unknown_service"))
        .when(is_alarming, verdict(True, 0.1, "alarming"))
        .when(is_expected & needs & clear, verdict(False, 0.9, "expected_disclosed"))
        .when(is_expected & needs, verdict(True, 0.5, "expected_unclear"))
        .when(is_expected, verdict(False, 0.9, "expected"))
        .otherwise(verdict(True, 0.5, "neutral"))
    )


def with_tier(rows: DataFrame, tiers: DataFrame, days: str = "days") -> DataFrame:
    """Range join with ``tiers`` (``days_min``, ``days_max`` or null, ``modifier``, ``label``); 1 where none holds the days."""
    fits = (F.col(days) >= F.col("days_min")) & (F.col("days_max").isNull() | (F.col(days) <= F.col("days_max")))
    return rows.join(rule_table(tiers), fits, "left").withColumn("modifier", F.coalesce("modifier", F.lit(1.0)))


def in_ranges(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, most_bins: int = 10_000) -> DataFrame:
    """``rows`` joined with all ``ranges`` whose ``low`` .. ``high`` (null: no end) hold ``value``; rows in none are left out.

    Both tables may be large: ranges are cut into bins of ``width`` and joined by equality on the bin, then
    tested exactly, so no row meets all ranges. A range of more than ``most_bins`` bins, or without an end, is met
    by its start instead, in order: such ones are few, a rule table, and sent to all tasks.
    Null values and null lows are in no range; a pair comes once.
    """
    at = F.floor(F.col(value) / width)
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    wide = F.col(high).isNull() | (last - first >= most_bins)
    known = ranges.filter(F.col(low).isNotNull())
    short = known.filter(~wide & (F.col(high) >= F.col(low))).withColumn("_bin", F.explode(F.sequence(first, last)))
    inside = (F.col(value) >= F.col(low)) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    met = rows.filter(F.col(value).isNotNull()).withColumn("_bin", at).join(short, "_bin").filter(inside).drop("_bin")
    return met.unionByName(rows.join(rule_table(known.filter(wide)), inside).select(met.columns))


def range_totals(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, key: str, item: str) -> DataFrame:
    """For each ``key`` of ``ranges``: number, least and greatest ``item`` of the ``rows`` whose ``value`` lies in ``low`` .. ``high`` (null: no end).

    The totals of the join that ``in_ranges`` makes, without its pairs, so for wide and open
    ranges too. Distinct values and ends of ranges are put in order together; runs of 1, 2, 4
    and more neighbours are summed, and each range is put together from two runs of each
    length at most. So work grows with both tables, times the logarithm of distinct values.
    Null values and lows are in no range, ranges without a row are left out.
    """
    value_of = lambda column: F.col(column).cast("double") + F.lit(0.0)  # noqa: E731  (-0.0 is 0.0)
    spans = ranges.filter(F.col(low).isNotNull()).select(F.col(key).alias("_key"), value_of(low).alias("_low"), value_of(high).alias("_high")).filter("_high IS NULL OR _high >= _low")
    points = rows.filter(F.col(value).isNotNull()).groupBy(value_of(value).alias("_v")).agg(F.count("*").alias("_n"), F.min(item).alias("_first"), F.max(item).alias("_last"))
    # an end comes before or after the values that equal it
    ends = spans.select(F.explode(F.array(F.struct(F.col("_low").alias("_v"), F.lit(0).alias("_side")), F.struct(F.col("_high").alias("_v"), F.lit(2).alias("_side")))).alias("e")).select("e.*").filter("_v IS NOT NULL").distinct()
    placed = points.withColumn("_side", F.lit(1)).unionByName(ends, allowMissingColumns=True).orderBy("_v", "_side").withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))
    sizes = placed.groupBy("_part").count().collect()  # one row a partition
    before, total = [], 0
    for part, size in sorted(map(tuple, sizes)):
        before.append((part, total))
        total += size
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    ordered = placed.join(starts, "_part").withColumn("_at", F.col("_at") + F.col("_before"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(total.bit_length()))).alias("_level")
    sums = [F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    runs = ordered.filter("_side = 1").select("_at", "_n", "_first", "_last", levels).groupBy("_level", F.expr("shiftright(_at, _level)").alias("_run")).agg(*sums)
    begin, end = (ordered.filter(f"_side = {side}").select(F.col("_v").alias(name), F.col("_at").alias(at)) for side, name, at in ((0, "_low", "_l"), (2, "_high", "_r")))
    met = spans.join(begin, "_low").join(end, "_high", "left").withColumn("_r", F.coalesce("_r", F.lit(total)))
    # of length 2 ** level: a run that begins at an odd place on the left, one that ends at an odd place on the right
    cover = met.select("_key", levels, "_l", "_r").select("_key", "_level", F.expr("shiftright(_l + shiftleft(1L, _level) - 1, _level)").alias("_a"), F.expr("shiftright(_r, _level)").alias("_b")).filter("_a < _b")
    used = cover.select("_key", "_level", F.explode(F.array_compact(F.array(F.expr("CASE WHEN _a % 2 = 1 THEN _a END"), F.expr("CASE WHEN _b % 2 = 1 THEN _b - 1 END")))).alias("_run"))
    found = used.join(runs, ["_level", "_run"]).groupBy("_key").agg(*sums)
    return found.select(F.col("_key").alias(key), F.col("_n").alias("rows"), F.col("_first").alias("first"), F.col("_last").alias("last"))


def temporal(rows: DataFrame, tiers: DataFrame, as_of: Column, score: str = "score", modified: str = "last_modified", effective: str = "effective_date", change: str = "is_change") -> DataFrame:
    """Scores of recent changes raised by the tier of their age; future dates and what is no change stay."""
    day = F.coalesce(modified, effective)
    own = rows.withColumn("days", F.datediff(as_of, day))
    tiered = with_tier(own, tiers)
    factor = F.when(F.col("days").isNull() | (F.col("days") < 0) | ~F.col(change), 1.0).otherwise(F.col("modifier"))
    n = F.col("days")
    unit = lambda k, name: F.concat((n / k).cast("int").cast("string"), F.lit(f" {name} ago"))
    age = F.when(n.isNull(), "unknown date").when(n < 0, "future date").when(n < 14, unit(1, "days")).when(n < 60, unit(7, "weeks")).when(n < 730, unit(30, "months")).otherwise(unit(365, "years"))
    out = tiered.withColumn("factor", factor).withColumn("adjusted", F.col(score) * F.col("factor")).withColumn("age", age).withColumn("very_old", F.coalesce(n > 1825, F.lit(False)))
    priority = F.when(F.col("adjusted") >= 8, "CRITICAL").when(F.col("adjusted") >= 6, "HIGH").when(F.col("adjusted") >= 4, "MEDIUM").otherwise("LOW")
    return out.withColumn("priority", priority).drop("days_min", "days_max", "modifier")


def stage_two(confidence: Column, context: Column, score: Column, keep: Column) -> Column:
    """Composite confidence, and whether an anomaly goes on."""
    own = 0.7 * confidence + 0.3 * (1 - context)
    return F.struct(own.alias("stage2_confidence"), (keep & ((score >= 5) | (own >= 0.60))).alias("kept"))


# --- compounds
def compounds(found: DataFrame, components: DataFrame, key: str = "document_id") -> DataFrame:
    """Patterns of which a document has every required indicator.

    ``found``: ``key``, ``indicator``; ``components``: ``pattern``, ``indicator``, ``required``, ``severity``, ``multiplier``.
    """
    need = components.groupBy("pattern").agg(F.count_if("required").alias("_need"), F.first("severity").alias("severity"), F.first("multiplier").alias("multiplier"))
    hit = found.select(key, "indicator").distinct().join(rule_table(components.select("pattern", "indicator", "required")), "indicator")
    own = hit.groupBy(key, "pattern").agg(
        F.count_if("required").alias("_have"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("required"), F.col("indicator")))), ",").alias("required_found"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("required"), F.col("indicator")))), ",").alias("optional_found"),
        F.count_if(~F.col("required")).alias("optional"),
    )
    full = own.join(rule_table(need), "pattern").filter("_have = _need")
    confidence = 0.70 + F.least(0.05 * F.col("optional"), F.lit(0.30))
    score = F.round(F.least(lookup("severity", fixed.COMPOUND_BASE, 5.0) * F.col("multiplier") + 0.5 * F.col("optional"), F.lit(10.0)), 1)
    return full.withColumn("confidence", confidence).withColumn("combined_score", score).drop("_have", "_need")


def match_details(matches: DataFrame, rows: DataFrame, item: str = "anomaly_id", severity: str = "severity", text: str = "clause_text", most: int = 150) -> DataFrame:
    """``matches`` of ``component_matches`` with the severity and the first ``most`` characters of each item's text (null: empty)."""
    own = rows.select(item, F.col(severity).alias("severity"), F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(most)), F.lit("...")).alias("text"))
    return matches.join(own, item)


def component_matches(found: DataFrame, matched: DataFrame, components: DataFrame, key: str = "document_id", item: str = "anomaly_id") -> DataFrame:
    """Anomalies that hold a component of a matched pattern, with the indicators they share."""
    return (
        found.join(rule_table(components.select("pattern", "indicator")), "indicator")
        .join(matched.select(key, "pattern"), [key, "pattern"], "left_semi")
        .groupBy(key, "pattern", item)
        .agg(F.array_join(F.array_sort(F.collect_set("indicator")), ",").alias("shared"))
    )


def compound_document_score(matched: DataFrame, key: str = "document_id") -> DataFrame:
    """Points of a document's compounds, 10 at most, their level and number."""
    score = F.least(F.sum(lookup("severity", fixed.COMPOUND_POINTS, 0.5)), F.lit(10.0))
    n = lambda s: F.count_if(F.col("severity") == s)
    own = matched.groupBy(key).agg(score.alias("compound_score"), n("CRITICAL").alias("critical"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.count("*").alias("patterns"), F.array_join(F.array_sort(F.collect_list("pattern")), ",").alias("pattern_list"))
    total = F.col("compound_score")
    level = F.when((total >= 7) | (F.col("critical") > 0), "Critical").when((total >= 5) | (F.col("high") >= 2), "High").when((total >= 3) | (F.col("high") >= 1), "Medium").when(total > 0, "Low").otherwise("None")
    return own.withColumn("level", level)


# --- alerts
def alert_score(severity: Column, confidence: Column, relevance: Column, compound: Column, change: Column, industry: Column, regulatory: Column) -> Column:
    """Severity by confidence by relevance, plus bonuses."""
    bonus = sum(F.when(c, fixed.BONUSES[n]).otherwise(0.0) for n, c in (("compound", compound), ("change", change), ("industry", industry), ("regulatory", regulatory)))
    base = lookup(F.lower(severity), fixed.SEVERITY_WEIGHT, 2.0) * F.coalesce(confidence, F.lit(0.5)) * relevance
    return F.struct((base + bonus).alias("ranking_score"), base.alias("base"), bonus.alias("bonus"))


def relevance(category: Column, severity: Column, priority: list[str], concern: str = "medium") -> Column:
    own = F.when(category.isin(*priority), 1.5) if priority else F.when(F.lit(False), 1.5)
    if concern == "high":
        own = own.when(severity.isin("high", "critical"), 1.3)
    if concern == "low":
        own = own.when(severity == "low", 0.7)
    return own.otherwise(1.0)


def budget(alerts: DataFrame, key: str = "document_id", item: str = "anomaly_id", target: int = 50, most: int = 100, show_all: bool = False) -> DataFrame:
    """``shown``: high, medium, low or suppressed, for alerts with a ``confidence_tier`` and a ``ranking_score``.

    The first ``target`` HIGH alerts are shown as high; what is over goes before MODERATE,
    and what is over there before LOW, until ``most`` are shown.
    """
    tier = F.col("confidence_tier")
    order = [F.desc("ranking_score"), F.col(item)]
    own = alerts.withColumn("_r", F.row_number().over(Window.partitionBy(key, "confidence_tier").orderBy(*order)))
    counts = alerts.groupBy(key).agg(F.count_if(tier == "HIGH").alias("_h"), F.count_if(tier == "MODERATE").alias("_m"), F.count_if(~tier.isin("HIGH", "MODERATE")).alias("_l"))
    rows = own.join(counts, key)
    if show_all:
        return rows.withColumn("shown", F.when(tier == "HIGH", "high").when(tier == "MODERATE", "medium").otherwise("low")).drop("_r", "_h", "_m", "_l")
    over = F.greatest(F.col("_h") - target, F.lit(0))
    first = most - F.least(F.col("_h"), F.lit(target))
    queue = over + F.col("_m")
    second = first - F.least(queue, first)
    place = F.when(tier == "HIGH", F.col("_r") - target).otherwise(over + F.col("_r"))
    low = F.when(tier.isin("HIGH", "MODERATE"), place - first).otherwise(F.greatest(queue - first, F.lit(0)) + F.col("_r"))
    shown = (
        F.when((tier == "HIGH") & (F.col("_r") <= target), "high")
        .when(tier.isin("HIGH", "MODERATE") & (place <= first), "medium")
        .when((low >= 1) & (low <= second), "low")
        .otherwise("suppressed")
    )
    return rows.withColumn("shown", shown).drop("_r", "_h", "_m", "_l")


def ranking_summary(ranked: DataFrame, key: str = "document_id", category: str = "category") -> DataFrame:
    """Totals, suppression rate, mean and best score of each document's alerts."""
    return ranked.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("shown") != "suppressed").alias("shown"),
        (F.count_if(F.col("shown") == "suppressed") / F.count("*")).alias("suppression_rate"),
        F.avg("ranking_score").alias("mean_score"),
        F.max("ranking_score").alias("top_score"),
    )


def top_categories(ranked: DataFrame, key: str = "document_id", category: str = "category", n: int = 5) -> DataFrame:
    counts = ranked.filter("shown <> 'suppressed'").groupBy(key, category).count()
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), category))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


# --- documents
def overall_risk(high: Column, medium: Column, low: Column, compound: Column, mean_confidence: Column) -> Column:
    score = F.least(3 * high + 2 * medium + low + 2.5 * compound, F.lit(30.0)) / 3 + (mean_confidence - 0.5) * 2
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), score))


def document_risk(anomalies: DataFrame, key: str = "document_id", severity: str = "severity", category: str = "category") -> DataFrame:
    """Score from 1 to 10 of number, severity and variety of a document's anomalies, with its parts."""
    s = F.col(severity)
    own = anomalies.groupBy(key).agg(F.count("*").alias("n"), F.count_if(s == "high").alias("high"), F.count_if(s == "medium").alias("medium"), F.count_if(s == "low").alias("low"), F.count_distinct(category).alias("categories"))
    parts = own.withColumn("by_count", F.least(F.col("n") / 2, F.lit(4.0))).withColumn("by_severity", F.least(0.75 * F.col("high") + 0.35 * F.col("medium") + 0.15 * F.col("low"), F.lit(4.0))).withColumn("by_variety", F.least(0.5 * F.col("categories"), F.lit(2.0)))
    return parts.withColumn("risk_score", F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("by_count") + F.col("by_severity") + F.col("by_variety"))))


def document_risk_report(documents: DataFrame, anomalies: DataFrame, key: str = "document_id") -> DataFrame:
    """``document_risk`` of every document, those without anomalies at 1, with ``risk_level`` and ``risk_label``."""
    own = documents.select(key).join(document_risk(anomalies, key), key, "left")
    counts = ["n", "high", "medium", "low", "categories", "by_count", "by_severity", "by_variety"]
    out = own.fillna(0, counts).fillna(1.0, ["risk_score"])
    score = F.col("risk_score")
    label = F.when(F.col("n") == 0, "Low Risk").when(score >= 7, "High Risk").when(score >= 4, "Medium Risk").otherwise("Low to Medium Risk")
    return out.withColumn("risk_level", risk_level(score)).withColumn("risk_label", label)


def document_report(anomalies: DataFrame, key: str = "document_id", item: str = "anomaly_id", category: str = "category") -> DataFrame:
    """Per document: ids of high and medium anomalies, the number of low ones, anomalies by category, and the top three concerns."""
    listed = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col(item)))).cast("array<string>"), ",")
    own = anomalies.groupBy(key).agg(F.count("*").alias("total"), listed("high").alias("high_ids"), listed("medium").alias("medium_ids"), F.count_if(F.col("severity") == "low").alias("low"))
    counts = anomalies.groupBy(key, category).agg(F.count("*").alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct(category, "n"))), lambda x: F.concat(x[category].cast("string"), F.lit(": "), x["n"].cast("string")))
    split = counts.groupBy(key).agg(F.array_join(named, ", ").alias("by_category"))
    top = top_concerns(anomalies, key, item).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item].cast("string")), ",").alias("top_concerns"))
    return own.join(split, key).join(top, key, "left").withColumn("top_concerns", F.coalesce("top_concerns", F.lit("")))


def top_concerns(anomalies: DataFrame, key: str = "document_id", item: str = "anomaly_id", n: int = 3) -> DataFrame:
    """The first concerns of each document: its high ones, or else its medium ones."""
    has_high = F.max((F.col("severity") == "high").cast("int")).over(Window.partitionBy(key))
    pool = anomalies.withColumn("_h", has_high).filter("severity = 'high' OR (_h = 0 AND severity = 'medium')")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), item))
    return pool.withColumn("place", place).filter(F.col("place") <= n).drop("_h")
