"""Rule tables matched against texts. Rules are small tables given as arguments; texts are never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.rules import fixed

#: Rule tables are joined by broadcast up to this many rows.
MAX_RULES = 10_000


def cleaned(text: str) -> Column:
    """Lower-cased, every character but letters, digits, ``_`` and white space a space."""
    return F.regexp_replace(F.lower(text), "(?U)[^\\w\\s]", " ")


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules`` for a broadcast; more than ``MAX_RULES`` is an error."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return F.broadcast(rules)


def near_words(span: int = 20) -> Column:
    """All keyword words occur and the tokens equal to any of them lie within ``span``."""
    places = F.filter(F.transform("_tokens", lambda t, i: F.when(F.array_contains("_kw", t), i)), lambda i: i.isNotNull())
    # through an array of one, so that the places are found once
    width = F.get(F.transform(F.array(places), lambda p: F.array_max(p) - F.array_min(p)), F.lit(0))
    return F.forall("_kw", lambda w: F.contains("_clean", w)) & (width < span)


def indicators(texts: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", span: int = 20, service: str = "general") -> DataFrame:
    """One row for each text and indicator of which a keyword fires.

    ``rules``: ``indicator``, ``keyword``, ``severity``, ``description``, ``relevant_for``. A word or phrase
    fires as part of the cleaned text; a phrase also when its words stand close together.
    A context rule carries whether it applies to the service.
    """
    prepared = texts.select(*keys, cleaned(text).alias("_clean")).withColumn("_tokens", F.filter(F.split("_clean", "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != ""))
    table = rule_table(rules.withColumn("_kw", F.split(F.lower("keyword"), " +")))
    fires = F.contains("_clean", F.lower("keyword")) | ((F.size("_kw") > 1) & F.coalesce(near_words(span), F.lit(False)))
    return indicator_rows(prepared.join(table, fires), keys, service)


def indicator_rows(hit: DataFrame, keys: tuple[str, ...], service: str) -> DataFrame:
    """A row for each text and indicator from one for each text and rule that fires."""
    applies = (F.col("severity") != "context") | F.col("relevant_for").isin(service, "general") | (F.lit(service) == "general")
    return hit.groupBy(*keys, "indicator").agg(
        F.first("severity").alias("severity"),
        F.first("description").alias("description"),
        F.count_distinct("keyword").alias("keywords"),
        F.bool_or(F.coalesce(applies, F.lit(True))).alias("applies"),
    )


def severity_distribution(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Indicators by severity and in all."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "context")]
    return found.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def indicator_score(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """3 for a high, 1.5 for a medium and 0.5 for an applicable context indicator, 10 at most."""
    points = F.when(F.col("severity") == "high", 3.0).when(F.col("severity") == "medium", 1.5).when(F.col("applies"), 0.5).otherwise(0.0)
    return found.groupBy(*keys).agg(F.least(F.sum(points), F.lit(10.0)).alias("indicator_score"))


def document_types(docs: DataFrame, rules: DataFrame, heads: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None, head: int = 500) -> DataFrame:
    """The type of each document: ``rules`` are ``type_no``, ``type``, ``part`` (title, content, section), ``keyword``, ``weight``.

    A title keyword counts in the ``title`` column, or without one (or where it is empty) in
    the first ``head`` characters, a content keyword anywhere, a
    section keyword where a heading holds all or 60 percent of its words. Ties go to the first type.
    """
    words = heads.groupBy(key).agg(F.collect_set(F.split("heading", "[ \\t]+")).alias("_heads"))
    front = F.left(F.col(text), F.lit(head)) if title is None else F.coalesce(F.nullif(F.col(title), F.lit("")), F.left(F.col(text), F.lit(head)))
    rows = docs.select(key, F.lower(text).alias("_t"), F.lower(front).alias("_front")).join(words, key, "left")
    need = F.array_distinct(F.split("keyword", " +"))
    close = F.exists(F.coalesce("_heads", F.array().cast("array<array<string>>")), lambda h: F.size(F.array_intersect(need, h)) / F.size(need) >= 0.6)
    hit = F.when(F.col("part") == "title", F.contains("_front", F.col("keyword"))).when(F.col("part") == "content", F.contains("_t", F.col("keyword"))).otherwise(close)
    scores = rows.join(rule_table(rules), hit).groupBy(key, "type_no", "type").agg(F.sum("weight").alias("score"), F.slice(F.array_sort(F.collect_set(F.concat_ws(": ", "part", "keyword"))), 1, 10).alias("matched"))
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "type_no")))
    sure = F.least(F.col("score") / 15.0, F.lit(1.0))
    best = ranked.groupBy(key).agg(
        F.max(F.when(F.col("place") == 1, F.col("type"))).alias("document_type"),
        F.max(F.when(F.col("place") == 1, sure)).alias("confidence"),
        F.max(F.when(F.col("place") == 1, F.array_join("matched", ","))).alias("matched"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").between(2, 4), F.struct("place", "type")))), lambda x: x["type"]), ",").alias("secondary"),
    )
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("document_type", F.lit("other")).alias("document_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("secondary", F.lit("")).alias("secondary"))


def required_terms(docs: DataFrame, terms: DataFrame, on: str, key: str = "doc_id", text: str = "text", advice: str = fixed.MISSING_ADVICE) -> DataFrame:
    """Required terms (``on``, ``term``; ``_`` stands for a space) found and missing, the share found (1 where none is required), and ``advice`` on each missing one."""
    own = docs.select(key, on, F.lower(text).alias("_t")).join(rule_table(terms), on, "left")
    has = F.contains("_t", F.replace(F.lower("term"), F.lit("_"), F.lit(" ")))
    advised = F.format_string(advice, F.replace("term", F.lit("_"), F.lit(" ")), F.col(on))
    agg = own.groupBy(key, on).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(has, F.col("term")))), ",").alias("found"),
        F.array_join(F.array_sort(F.collect_list(F.when(~has, F.col("term")))), ",").alias("missing"),
        F.coalesce(F.avg(has.cast("double")), F.lit(1.0)).alias("compliance"),
        F.array_join(F.array_sort(F.collect_list(F.when(~has, advised))), "; ").alias("recommendations"),
    )
    return agg.withColumn("compliant", F.col("missing") == "")


def prohibited_terms(docs: DataFrame, terms: dict[str, list[str]], on: str, text: str = "text", most: int = 3) -> DataFrame:
    """The first prohibited terms of a row's group that its text contains, in ``prohibited``."""
    own = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    hits = F.filter(F.coalesce(F.try_element_at(own, F.col(on)), F.array().cast("array<string>")), lambda t: F.contains(F.lower(text), F.lower(t)))
    return docs.withColumn("prohibited", F.slice(hits, 1, most))


def fuzzy_member(value: Column, values: Column) -> Column:
    """Equal, or one part of the other, with ``-`` and ``_`` alike."""
    same = lambda x: F.replace(F.lower(x), F.lit("-"), F.lit("_"))
    return F.exists(values, lambda x: F.contains(same(x), same(value)) | F.contains(same(value), same(x)))
