"""Sections, clauses and chunks of documents.

A document's lines stay together in one row: patterns are tried and segments cut with
array functions, so that nothing is shuffled and order needs no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import normalize_newlines
from textloom.operators.matching import rule_table
from textloom.rules import fixed

SPACE = "[ \\t\\n\\r\\f\\x0B]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def _with_hits(rows: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """``rows`` with ``_hits``: for each pattern the numbers (from 0) of the ``_lines`` that begin with it.

    Lines are stripped once, and those that no pattern fits, most of them, are left out in one pass.
    """
    any_of = "|".join(f"(?:{p})" for p in patterns)
    numbered = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), strip(x).alias("x")))
    out = rows.withColumn("_some", F.filter(numbered, lambda r: r["x"].rlike(any_of)))

    def matching(pattern: str) -> Column:
        return F.transform(F.filter("_some", lambda r: r["x"].rlike(pattern)), lambda r: r["i"])

    return out.withColumn("_hits", F.array(*map(matching, patterns))).drop("_some")


def _segments(lines: Column, starts: Column, pattern: Column, fields) -> Column:
    """One struct for each start: its text runs to the next start."""

    def one(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        body = strip(F.array_join(F.slice(lines, at + 1, end - at), "\n"))
        return fields(strip(F.get(lines, at)), pattern, body, k)

    return F.transform(starts, one)


def _group(line: Column, pattern: Column, n: int) -> Column:
    return F.call_function("regexp_extract", line, pattern, F.lit(n))


def pattern_hits(docs: DataFrame, patterns: Sequence[str] = fixed.SECTION_PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that begin with each pattern, and the pattern chosen (from 1): the first with three or the last."""
    rows = _with_hits(docs.select(key, F.split(normalize_newlines(text), "\n", -1).alias("_lines")), patterns)
    chosen = F.array_position(F.transform("_hits", lambda h: F.size(h) >= 3), F.lit(True)).cast("int")
    return rows.select(key, "_lines", "_hits", F.when(chosen > 0, chosen).otherwise(len(patterns)).alias("chosen"))


def sections(docs: DataFrame, patterns: Sequence[str] = fixed.SECTION_PATTERNS, key: str = "doc_id", text: str = "text", long_text: int = 5000, paragraph: int = 50, most: int | None = 50) -> DataFrame:
    """``key``, ``section_no``, ``section_number``, ``section_title``, ``content``, ``method``.

    Fewer than two headers in a long text give its paragraphs (the first ``most``, all if that is None), none in a
    short one a single section. What stands before the first header is left out.
    """
    found = pattern_hits(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)), patterns, key, text)
    names = F.array(*map(F.lit, patterns))
    rows = found.select(key, "_lines", F.element_at("_hits", F.col("chosen")).alias("_starts"), F.element_at(names, F.col("chosen")).alias("_pattern"), F.array_join("_lines", "\n").alias("_text"))

    def fields(line: Column, pattern: Column, body: Column, k: Column) -> Column:
        return F.struct(_group(line, pattern, 1).alias("section_number"), strip(_group(line, pattern, 2)).alias("section_title"), body.alias("content"), F.lit("pattern").alias("method"))

    parts = F.filter(F.transform(F.split("_text", f"\n{SPACE}*\n", -1), strip), lambda x: F.length(x) >= paragraph)
    parts = parts if most is None else F.slice(parts, 1, most)
    title = lambda x: F.when(F.length(x) > 50, F.concat(F.regexp_replace(F.left(x, F.lit(50)), "\n", " "), F.lit("..."))).otherwise(x)
    paragraphs = F.transform(parts, lambda x, k: F.struct((k + 1).cast("string").alias("section_number"), title(x).alias("section_title"), x.alias("content"), F.lit("paragraph").alias("method")))
    single = F.array(F.struct(F.lit("1").alias("section_number"), F.lit("Terms and Conditions").alias("section_title"), F.col("_text").alias("content"), F.lit("single_section").alias("method")))
    n = F.size("_starts")
    chosen = F.when((n < 2) & (F.length("_text") > long_text), paragraphs).when(n == 0, single).otherwise(_segments(F.col("_lines"), F.col("_starts"), F.col("_pattern"), fields))
    return rows.select(key, F.posexplode(chosen).alias("_k", "_s")).select(key, (F.col("_k") + 1).alias("section_no"), "_s.*")


def clauses(found: DataFrame, patterns: Sequence[str] = fixed.CLAUSE_PATTERNS, bullets: Sequence[str] = fixed.BULLET_PATTERNS, keys: Sequence[str] = ("doc_id", "section_no"), text: str = "content") -> DataFrame:
    """The clauses of each section: by the first numbering with two, then bullets by number, else all as one."""
    both = [*patterns, *bullets]
    rows = _with_hits(found.withColumn("_lines", F.split(text, "\n", -1)), both)
    rows = rows.withColumn("_p", F.array_position(F.transform("_hits", lambda h: F.size(h) >= 2), F.lit(True)).cast("int"))
    rows = rows.withColumn("_starts", F.when(F.col("_p") > 0, F.element_at("_hits", F.greatest(F.col("_p"), F.lit(1))))).withColumn("_pattern", F.element_at(F.array(*map(F.lit, both)), F.greatest(F.col("_p"), F.lit(1))))

    def fields(line: Column, pattern: Column, body: Column, k: Column) -> Column:
        own = F.when(F.col("_p") <= len(patterns), _group(line, pattern, 1)).otherwise((k + 1).cast("string"))
        return F.struct(own.alias("clause_id"), body.alias("clause_text"))

    whole = F.array(F.struct(F.lit("1").alias("clause_id"), F.col(text).alias("clause_text")))
    cut = F.when(F.col("_p") > 0, _segments(F.col("_lines"), F.col("_starts"), F.col("_pattern"), fields)).otherwise(whole)
    kept = [c for c in found.columns if c != text]
    return rows.select(*kept, F.posexplode(cut).alias("_k", "_c")).select(*kept, (F.col("_k") + 1).alias("clause_no"), "_c.*")


def structure_statistics(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: sections, clauses, characters, lines, and clauses for a section (mean, least, most, sections with several)."""
    each = found.groupBy(key, "section_no").count()
    own = each.groupBy(key).agg(F.count("*").alias("sections"), F.sum("count").alias("clauses"), F.avg("count").alias("mean_clauses"), F.min("count").alias("min_clauses"), F.max("count").alias("max_clauses"), F.count_if(F.col("count") > 1).alias("multi_clause_sections"))
    size = docs.select(key, F.length(text).alias("chars"), F.size(F.split(text, "\n", -1)).alias("lines"))
    return size.join(own, key, "left").fillna(0)


def pattern_report(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", most: int = 10, groups: int = 2) -> DataFrame:
    """The first ``most`` lines of each document that each pattern (``pattern_no``, ``pattern``; a rule table) matches, with its first ``groups`` groups."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    hit = lines.join(rule_table(patterns), F.expr("line rlike pattern"))
    place = F.row_number().over(Window.partitionBy(key, "pattern_no").orderBy("line_no"))
    return hit.withColumn("place", place).filter(F.col("place") <= most).select(key, "pattern_no", "place", (F.col("line_no") + 1).alias("line_no"), "line", *[_group(F.col("line"), F.col("pattern"), k).alias(f"group_{k}") for k in range(1, groups + 1)])


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that look like headings, lower-cased, with their numbers: capitals, numbered, or capitalised behind a blank line."""
    rows = docs.select(key, F.transform(F.split(text, "\n", -1), strip).alias("_lines"))
    line, before = lambda i: F.get("_lines", i), lambda i: F.get("_lines", i - 1)

    def heading(i: Column) -> Column:
        x = line(i)
        short = F.length(x) < 100
        capitals = (F.upper(x) == x) & (F.lower(x) != x) & short
        numbered = x.rlike("^([0-9]+\\.|[0-9]+\\)|[A-Za-z0-9_]+\\.|[IVX]+\\.)[ \\t]+[A-Z]")
        titled = (i > 0) & (before(i) == "") & x.rlike("^[A-Z]") & short
        return (x != "") & (capitals | numbered | F.coalesce(titled, F.lit(False)))

    at = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), heading)
    return rows.select(key, "_lines", F.explode(at).alias("_i")).select(key, (F.col("_i") + 1).alias("line_no"), F.lower(F.get("_lines", F.col("_i"))).alias("heading"))


def chunks(rows: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words that overlap; a text of no more is one chunk. Adds ``chunk_index``, ``chunk``."""
    own = rows.withColumn("_w", F.filter(F.split(text, f"{SPACE}+"), lambda x: x != ""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - overlap - 1), F.lit(size - overlap))
    cut = F.when(F.size("_w") <= size, F.array(F.col(text))).otherwise(F.transform(starts, lambda a: F.array_join(F.slice("_w", a + 1, size), " ")))
    return own.select(*rows.columns, F.posexplode(cut).alias("chunk_index", "chunk"))


def report_clauses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clauses by blank lines, or by lines where there are none; numbered from 1."""
    parts = lambda p: F.filter(F.transform(F.split(text, p, -1), strip), lambda x: x != "")
    wide = parts(f"\n{SPACE}*\n")
    chosen = F.when(F.size(wide) > 1, wide).otherwise(parts("\n"))
    return docs.select(key, F.posexplode(chosen).alias("_k", "clause_text")).select(key, (F.col("_k") + 1).alias("clause_no"), "clause_text")


def nested(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clause rows as sections with an array of clauses each, in order."""
    return found.groupBy(key, "section_no", "section_title").agg(F.array_sort(F.collect_list(F.struct("clause_no", "clause_id", "clause_text"))).alias("clauses"))


def flattened(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each clause of nested sections; one without a number gets ``section.ordinal``."""
    out = rows.select(key, "section_no", "section_title", F.posexplode_outer("clauses").alias("_k", "_c"))
    number = F.coalesce("_c.clause_id", F.concat_ws(".", F.col("section_no").cast("string"), (F.col("_k") + 1).cast("string")))
    return out.select(key, "section_no", "section_title", F.col("_c.clause_no").alias("clause_no"), number.alias("clause_number"), F.col("_c.clause_text").alias("clause_text"))
