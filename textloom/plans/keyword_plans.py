"""A large rule pack: all words and word pairs of the benchmark's items, matched against the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import keywords as K
from textloom.operators import matching as M
from textloom.plans.common import Plans, table

TOKENS = "[ \\t\\n\\r\\f\\x0B]+"


def pack(s, d):
    """``indicator``, ``keyword``, ``severity``, ``description``, ``relevant_for``: a rule for each distinct word and pair of neighbouring words."""
    own = table(s, d, "benchmark").select(F.filter(F.split(M.cleaned("text"), TOKENS), lambda w: w != "").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    single = own.select(F.explode("w").alias("keyword")).distinct().withColumn("severity", F.lit("context"))
    double = own.select(F.explode(pairs).alias("keyword")).distinct().withColumn("severity", F.lit("high"))
    rules = single.unionByName(double)
    kind = F.when(F.col("severity") == "high", "pair_").otherwise("word_")
    return rules.select(
        F.concat(kind, F.left("keyword", F.lit(1))).alias("indicator"),
        "keyword",
        "severity",
        F.lit("of an item").alias("description"),
        F.lit("travel").alias("relevant_for"),
    )


def many(s, d):
    found = K.many_indicators(table(s, d, "documents"), pack(s, d), service="music")
    return found.select("doc_id", "indicator", "severity", "keywords", "applies")


PLANS: Plans = {
    "d01_g05_many_keywords": (
        many,
        r"""
WITH own AS (
  SELECT list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '') AS w FROM benchmark),
rules AS MATERIALIZED (
  SELECT DISTINCT 'word_' || left(k, 1) AS indicator, k AS keyword, 'context' AS severity, [k] AS kw FROM (SELECT unnest(w) AS k FROM own)
  UNION ALL SELECT DISTINCT 'pair_' || left(k, 1), k, 'high', string_split(k, ' ')
  FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM own)),
prep AS MATERIALIZED (
  SELECT doc_id, clean, list_filter(string_split_regex(clean, '\s+'), lambda x: x <> '') AS tokens
  FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g') AS clean FROM documents)),
sure AS MATERIALIZED (SELECT doc_id, keyword, contains(clean, keyword) AS hit, kw FROM prep, rules
  WHERE CASE WHEN len(kw) = 1 THEN contains(clean, keyword) ELSE contains(clean, kw[1]) AND contains(clean, kw[2]) END),
near AS (
  SELECT s.doc_id, s.keyword FROM sure s JOIN prep p USING (doc_id) WHERE NOT hit
  AND list_max(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = kw[1] OR tokens[i] = kw[2]))
    - list_min(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = kw[1] OR tokens[i] = kw[2])) < 20),
hits AS (SELECT doc_id, keyword FROM sure WHERE hit UNION ALL SELECT doc_id, keyword FROM near)
SELECT doc_id, indicator, any_value(severity) AS severity, count(DISTINCT keyword) AS keywords, bool_or(severity <> 'context') AS applies
FROM hits JOIN rules USING (keyword) GROUP BY doc_id, indicator
""",
    ),
}
