"""Cleaning, gates, displays and wording features over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.plans.common import Plans, table
from textloom.rules import fixed

COMMON_WORDS = ("the", "and", "of", "to", "in", "is", "for", "with", "that", "this")
PHRASES = ("of the", "in the", "for this")
WS = r"[ \t\n\r\f\x0B]+"


def _sum_contains(words) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


#: Letters beyond ASCII belong to words: RE2 needs to be told.
LETTERS = r"regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g')"


def _sum_matches(words, column=LETTERS) -> str:
    return " + ".join("len(regexp_extract_all(%s, '\\b%s\\b'))" % (column, w.replace("'", "''")) for w in words)


def docs(s, d):
    return table(s, d, "documents")


def b1(s, d):
    return docs(s, d).select("doc_id", X.normalize_newlines("text").alias("normalized"))


def b2(s, d):
    return table(s, d, "pages").select("page_id", X.sanitize("html", 2000).alias("clean"))


def b3(s, d):
    return docs(s, d).select("doc_id", X.clean_value("text", 80).alias("value"))


def b4(s, d):
    return table(s, d, "pages").select("page_id", X.file_name("url", 30).alias("file_name"))


def b5(s, d):
    return docs(s, d).select("doc_id", X.canonical_hash("text").alias("canonical_sha256"), F.md5("text").alias("raw_md5"))


def b7(s, d):
    return docs(s, d).select("doc_id", X.preview("text", 500).alias("p500"), X.preview("text", 150, always=True).alias("p150"), X.preview("text", 1000, "").alias("p1000"))


def b8(s, d):
    o = table(s, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" null ")).when(F.col("o_orderkey") % 5 == 1, F.lit("1998-02-31")).when(F.col("o_orderkey") % 5 == 2, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    own = o.select("o_orderkey", raw.alias("raw"))
    return own.select("o_orderkey", X.blank_to_null("raw").alias("cleaned"), X.iso_date("raw").alias("effective_date"), F.coalesce(X.blank_to_null("raw"), F.lit("Terms of Service")).alias("document_type"))


def b10(s, d):
    e = table(s, d, "events")
    return e.select("event_id", X.allowed(F.upper("event_type"), ("view", "click", "signup"), "general").alias("label"))


def b11(s, d):
    t = docs(s, d)
    n = X.count_contained("text", COMMON_WORDS)
    return t.select("doc_id", X.any_contained("text", PHRASES).alias("is_terms"), n.alias("common_words"), (n < 5).alias("flagged_language"))


def b14(s, d):
    e = table(s, d, "events")
    v = F.least(F.col("value") / 500, F.lit(1.0))
    pct = F.round(v * 100).cast("int").cast("string")
    return e.select("event_id", F.concat(pct, F.lit("%")).alias("prevalence_display"), F.concat(F.lit("Found in "), pct, F.lit("% of similar documents")).alias("comparison"), F.concat(F.lit("Section "), F.col("user_id").cast("string"), F.lit(": "), F.col("event_type"), F.lit(" - Clause "), F.col("event_id").cast("string")).alias("context"))


def b16(s, d):
    t = docs(s, d)
    n = X.tokens_estimate("text")
    return t.select("doc_id", F.round(n, 4).alias("tokens"), X.cost(n, F.lit(500.0), 0.15, 0.60).alias("cost"))


def b17(s, d):
    n = F.length(F.trim("text"))
    return docs(s, d).select("doc_id", *[(n >= k).alias(f"at_least_{k}") for k in (3, 10, 20, 100, 500)])


def b18(s, d):
    lines = F.split("text", "\n")
    return docs(s, d).select(
        "doc_id",
        F.size(lines).cast("long").alias("lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("non_empty"),
        F.size(F.filter(lines, lambda x: x.rlike("^[0-9]+"))).cast("long").alias("numbered"),
        F.size(F.filter(lines, lambda x: x.rlike("^[0-9]+\\.[0-9]+"))).cast("long").alias("subsections"),
        F.size(F.filter(lines, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 5))).cast("long").alias("all_caps"),
    )


def b19(s, d):
    e = table(s, d, "events")
    score = F.col("value") / 50
    sev = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return e.select("event_id", X.risk_level(score).alias("risk_level"), X.lookup(X.risk_level(score), {"Low": 2.0, "Medium": 5.5, "High": 8.5}).alias("level_score"), X.lookup(sev, fixed.SEVERITY_BASE, 5.0).alias("base_score"), X.lookup(sev, {"high": 3, "medium": 2, "low": 1}).alias("severity_rank"))


def b22(s, d):
    vague = X.any_contained("text", ("with", "for the", "that"))
    return docs(s, d).select("doc_id", ((F.length("text") > 500) & vague).alias("vague"))


def d6(s, d):
    t = docs(s, d)
    return t.select(
        "doc_id",
        X.count_patterns("text", X.word_pattern(fixed.MODAL_VERBS)).alias("modal"),
        X.count_patterns("text", X.word_pattern(("no", "not", "on", "an"))).alias("negation"),
        X.count_patterns("text", X.word_pattern(("if", "as", "in case"))).alias("conditional"),
        F.round(X.density("text", X.word_pattern(("the", "is", "der"))), 6).alias("jargon_density"),
    )


def d8(s, d):
    own = X.readability(docs(s, d).select("doc_id", "text"))
    return own.select("doc_id", "sentences", "words", "syllables", F.round("flesch", 6).alias("flesch"))


def d13(s, d):
    t = docs(s, d)
    flesch = X.flesch("text")
    position = F.pmod(F.col("doc_id"), F.lit(10)) / 10.0
    return t.select("doc_id", X.clear_language("text", X.word_pattern(("und", "the"))).alias("clear"), X.specific_details("text").alias("specific"), X.disclosure_quality("text", flesch, position).alias("disclosed"))


_WORDS = "regexp_extract_all(text, '[a-zA-Z]+')"
_SENT = r"greatest(len(list_filter(string_split_regex(text, '[.!?]+[ \t\n\r\f\x0B]+|\n+'), lambda x: trim(x) <> '')), 1)"
_SYL = "list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - CAST(ends_with(lower(x), 'e') AS INT), 1) END))"
_FLESCH = "CASE WHEN len(w) > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * (len(w) / sentences) - 84.6 * (syl / len(w)))) ELSE 0.0 END"
_READ = f"SELECT *, coalesce({_SYL}, 0) AS syl FROM (SELECT doc_id, text, {_WORDS} AS w, {_SENT} AS sentences FROM documents)"
_N = f"len(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> ''))"

PLANS: Plans = {
    "b01_normalize_newlines": (b1, r"SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS normalized FROM documents"),
    "b02_sanitize": (b2, rf"SELECT page_id, trim(regexp_replace(regexp_replace(substr(html, 1, 2000), '<[^>]+>', '', 'g'), '{WS}', ' ', 'g')) AS clean FROM pages"),
    "b03_clean_value": (b3, r"SELECT doc_id, trim(left(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f-\x{9f}]', '', 'g'), 80)) AS value FROM documents"),
    "b04_file_name": (
        b4,
        r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_last(string_split_regex(url, '[/\\]')), ' ', '_', 'g'), '[^A-Za-z0-9._-]', '', 'g'), '\.{2,}', '.', 'g'), '^\.+', '') AS safe FROM pages),
b AS (SELECT *, regexp_extract(safe, '(\.[A-Za-z0-9]+)$', 1) AS ext FROM a),
c AS (SELECT page_id, CASE WHEN length(safe) > 30 THEN left(safe, 30 - length(ext)) || ext ELSE safe END AS cut FROM b)
SELECT page_id, CASE WHEN length(cut) > 0 THEN cut ELSE 'document' END AS file_name FROM c""",
    ),
    "b05_b06_hashes": (b5, rf"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))) AS canonical_sha256, md5(text) AS raw_md5 FROM documents"),
    "b07_previews": (b7, "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS p500, left(text, 150) || '...' AS p150, left(text, 1000) AS p1000 FROM documents"),
    "b08_b09_metadata": (
        b8,
        """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' null ' WHEN 1 THEN '1998-02-31' WHEN 2 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders),
c AS (SELECT o_orderkey, CASE WHEN trim(raw) = '' OR lower(trim(raw)) = 'null' THEN NULL ELSE trim(raw) END AS cleaned FROM r)
SELECT o_orderkey, cleaned, CASE WHEN length(cleaned) = 10 THEN TRY_CAST(cleaned AS DATE) END AS effective_date, coalesce(cleaned, 'Terms of Service') AS document_type FROM c""",
    ),
    "b10_label_whitelist": (b10, "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN event_type ELSE 'general' END AS label FROM events"),
    "b11_b12_wording_checks": (b11, f"SELECT doc_id, ({_sum_contains(PHRASES)}) > 0 AS is_terms, {_sum_contains(COMMON_WORDS)} AS common_words, ({_sum_contains(COMMON_WORDS)}) < 5 AS flagged_language FROM documents"),
    "b13_b14_displays": (b14, "SELECT event_id, CAST(round(least(value / 500, 1.0) * 100) AS INT) || '%' AS prevalence_display, 'Found in ' || CAST(round(least(value / 500, 1.0) * 100) AS INT) || '% of similar documents' AS comparison, 'Section ' || user_id || ': ' || event_type || ' - Clause ' || event_id AS context FROM events"),
    "b16_token_cost": (b16, f"SELECT doc_id, round(CAST({_N} * 1.3 AS DOUBLE), 4) AS tokens, round(CAST({_N} * 1.3 AS DOUBLE) / 1e6 * 0.15 + 500.0 / 1e6 * 0.60, 6) AS cost FROM documents"),
    "b17_length_gates": (b17, "SELECT doc_id, " + ", ".join(f"length(trim(text)) >= {k} AS at_least_{k}" for k in (3, 10, 20, 100, 500)) + " FROM documents"),
    "b18_layout_profile": (
        b18,
        r"""
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: trim(x) <> '')) AS non_empty, len(list_filter(l, lambda x: regexp_matches(x, '^[0-9]+'))) AS numbered,
  len(list_filter(l, lambda x: regexp_matches(x, '^[0-9]+\.[0-9]+'))) AS subsections, len(list_filter(l, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 5)) AS all_caps
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    ),
    "b19_b20_banding": (
        b19,
        """
WITH e AS (SELECT event_id, value / 50 AS score, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS sev FROM events)
SELECT event_id, CASE WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END AS risk_level, CAST(CASE WHEN score >= 7 THEN 8.5 WHEN score >= 4 THEN 5.5 ELSE 2.0 END AS DOUBLE) AS level_score,
  CAST(CASE sev WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.0 ELSE 3.0 END AS DOUBLE) AS base_score, CASE sev WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank FROM e""",
    ),
    "b22_vague_language": (b22, "SELECT doc_id, length(text) > 500 AND (contains(lower(text), 'with') OR contains(lower(text), 'for the') OR contains(lower(text), 'that')) AS vague FROM documents"),
    "d06_d07_pattern_counts": (d6, f"SELECT doc_id, CAST({_sum_matches(fixed.MODAL_VERBS)} AS BIGINT) AS modal, CAST({_sum_matches(('no', 'not', 'on', 'an'))} AS BIGINT) AS negation, CAST({_sum_matches(('if', 'as', 'in case'))} AS BIGINT) AS conditional, CASE WHEN len({_WORDS}) > 0 THEN round(({_sum_matches(('the', 'is', 'der'))}) / len({_WORDS}) * 100.0, 6) ELSE 0.0 END AS jargon_density FROM documents"),
    "d08_d10_readability": (d8, f"SELECT doc_id, sentences, len(w) AS words, CAST(syl AS BIGINT) AS syllables, round({_FLESCH}, 6) AS flesch FROM ({_READ})"),
    "d13_d15_disclosure": (
        d13,
        f"""
WITH r AS ({_READ}), f AS (SELECT doc_id, lower(text) AS t, {_FLESCH} AS flesch, ({_sum_matches(('und', 'the'))}) / greatest({_N}, 1) * 100 < 2.0 AS clear, ({_sum_matches(fixed.UNCLEAR)}) / greatest({_N}, 1) * 100 < 2.0 AS plain FROM r),
g AS (SELECT *, (regexp_matches(t, '\\b[0-9]+\\b') OR regexp_matches(t, '[0-9]+%') OR regexp_matches(t, '\\$[0-9]+') OR regexp_matches(t, '\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\b')) AND ({' + '.join(f"CAST(regexp_matches(t, '\\b{w}\\b') AS INT)" for w in fixed.VAGUE)}) < 3 AS specific FROM f)
SELECT doc_id, clear, specific, CAST(flesch >= 60 OR plain AS INT) + CAST((doc_id % 10) / 10.0 <= 0.30 AS INT) + CAST(specific AS INT) >= 2 AS disclosed FROM g""",
    ),
}
