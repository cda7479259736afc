"""Sections, clauses, chunks, headings, and rules matched against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import risk_level
from textloom.operators import matching as M
from textloom.operators import structure as S
from textloom.plans.common import Plans, rows, table
from textloom.rules import fixed

#: Lines of the given documents carry no numbers: sections and clauses begin at words that lines do begin with.
HEADS = ("^(The) (.+)", "^(In|On|De|En|Die|La) ([^\\n]+)", "^([A-Z][a-z]) (.+)")
PARTS = ("^(Er[a-z]*) (.+)", "^([A-Z][a-z]+) (.+)")
DOTS = ("^[A-Z][a-z]*\\. (.+)",)
#: indicator, keyword, severity, description, relevant_for
RULES = [
    ("and_of", "of the", "high", "joined", None),
    ("and_of", "thonblesh", "high", "joined", None),
    ("near", "and that", "medium", "close words", None),
    ("german", "und", "medium", "german", None),
    ("french", "elle", "context", "french", "general"),
    ("spanish", "para las", "context", "spanish", "travel"),
]
RULE_SCHEMA = "indicator string, keyword string, severity string, description string, relevant_for string"
TYPES = [
    (1, "english", "title", "the", 3.0),
    (1, "english", "content", "and", 1.0),
    (1, "english", "section", "the is", 2.0),
    (2, "german", "title", "der", 3.0),
    (2, "german", "content", "und", 1.0),
    (3, "romance", "content", "de", 1.5),
    (3, "romance", "content", "que", 2.5),
]
TERMS = [("en", "of_the"), ("en", "in_the"), ("de", "und"), ("de", "in_der"), ("fr", "de")]


def docs(s, d):
    return table(s, d, "documents")


def c1(s, d):
    own = S.pattern_hits(docs(s, d), HEADS)
    return own.select("doc_id", *[F.size(F.get("_hits", F.lit(k))).cast("long").alias(f"hits_{k + 1}") for k in range(len(HEADS))], F.col("chosen").cast("long").alias("chosen"))


def c2(s, d):
    return S.sections(docs(s, d), HEADS)


def c5(s, d):
    return S.clauses(S.sections(docs(s, d), HEADS), PARTS, DOTS).select("doc_id", "section_no", "clause_no", "clause_id", "clause_text")


def c6(s, d):
    own = S.structure_statistics(docs(s, d), S.clauses(S.sections(docs(s, d), HEADS), PARTS, DOTS))
    return own.withColumn("mean_clauses", F.round("mean_clauses", 6)).withColumns({c: F.col(c).cast("long") for c in ("chars", "lines")})


def c7(s, d):
    return S.pattern_report(docs(s, d), rows(s, "pattern_no int, pattern string", list(enumerate(HEADS, 1))), most=3)


def c8(s, d):
    return S.headings(docs(s, d))


def c9(s, d):
    own = S.chunks(docs(s, d).select("doc_id", "text"))
    return own.select("doc_id", "chunk_index", F.size(F.split("chunk", "[ \\t\\n\\r\\f\\x0B]+")).alias("words"), F.md5("chunk").alias("chunk_md5"))


def c10(s, d):
    return S.report_clauses(docs(s, d)).select("doc_id", "clause_no", F.md5("clause_text").alias("clause_md5"))


def c11(s, d):
    found = S.clauses(S.sections(docs(s, d), HEADS), PARTS, DOTS)
    own = S.nested(found.withColumn("clause_id", F.when(F.col("clause_no") % 2 == 1, F.col("clause_id"))))
    return S.flattened(own).select("doc_id", "section_no", "clause_no", "clause_number")


def _found(s, d):
    return M.indicators(docs(s, d), rows(s, RULE_SCHEMA, RULES), service="music")


def d1(s, d):
    return _found(s, d).drop("description")


def d3(s, d):
    f = _found(s, d)
    return M.severity_distribution(f).join(M.indicator_score(f), "doc_id")


def d5(s, d):
    own = M.document_types(docs(s, d), rows(s, "type_no int, type string, part string, keyword string, weight double", TYPES), S.headings(docs(s, d)))
    return own.withColumn("confidence", F.round("confidence", 6))


def d16(s, d):
    return M.required_terms(docs(s, d), rows(s, "lang string, term string", TERMS), "lang").withColumn("compliance", F.round("compliance", 6))


def d17(s, d):
    own = M.prohibited_terms(docs(s, d), {"en": ["Of the", "zz", "and", "in", "is"], "fr": ["DE", "la"]}, "lang")
    member = M.fuzzy_member(F.col("source"), F.array(*map(F.lit, ("src-1", "x_src3", "src20"))))
    return own.select("doc_id", F.array_join("prohibited", ",").alias("prohibited"), member.alias("expected"))


def flagship(s, d):
    """The ten riskiest documents: sections, clauses, indicators, scores."""
    found = S.clauses(S.sections(docs(s, d), HEADS), PARTS, DOTS)
    hits = M.indicators(found, rows(s, RULE_SCHEMA, RULES), ("doc_id", "section_no", "clause_no"), "clause_text", service="music")
    total = hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count_distinct("indicator").alias("categories"))
    score = F.least(F.col("n") / 2, F.lit(4.0)) + F.least(0.75 * F.col("high") + 0.35 * F.col("medium") + 0.15 * (F.col("n") - F.col("high") - F.col("medium")), F.lit(4.0)) + F.least(0.5 * F.col("categories"), F.lit(2.0))
    scored = total.withColumn("risk_score", F.round(F.greatest(F.lit(1.0), F.least(score, F.lit(10.0))), 6))
    return scored.withColumn("risk_level", risk_level("risk_score")).orderBy(F.desc("risk_score"), F.desc("n"), "doc_id").limit(10)


_NORM = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"


def _hits_sql(patterns) -> str:
    return "[" + ", ".join(f"list_filter(range(1, len(lines) + 1), lambda i: regexp_matches({_STRIP % 'lines[i]'}, '{p}'))" for p in patterns) + "]"


def _case(patterns, line, group) -> str:
    return "CASE p " + " ".join(f"WHEN {k} THEN regexp_extract({line}, '{p}', {group})" for k, p in enumerate(patterns, 1)) + " END"


_C1 = f"""
l AS (SELECT doc_id, {_NORM} AS t, string_split({_NORM}, chr(10)) AS lines FROM documents),
h AS (SELECT *, {_hits_sql(HEADS)} AS hits FROM l),
c AS (SELECT *, CASE {' '.join(f'WHEN len(hits[{k}]) >= 3 THEN {k}' for k in range(1, len(HEADS) + 1))} ELSE {len(HEADS)} END AS p FROM h)"""
_SECTIONS = rf"""{_C1},
s AS (SELECT *, hits[p] AS starts FROM c),
sec AS (
  SELECT doc_id, k AS section_no, {_case(HEADS, "head", 1)} AS section_number, {_STRIP % _case(HEADS, "head", 2)} AS section_title, {_STRIP % "body"} AS content, 'pattern' AS method FROM (
    SELECT *, {_STRIP % "lines[st]"} AS head, array_to_string(lines[st:coalesce(starts[k + 1] - 1, len(lines))], chr(10)) AS body FROM (
      SELECT *, unnest(starts) AS st, unnest(range(1, len(starts) + 1)) AS k FROM s WHERE NOT (len(starts) < 2 AND length(t) > 5000)))
  UNION ALL
  SELECT doc_id, k, CAST(k AS VARCHAR), CASE WHEN length(x) > 50 THEN replace(left(x, 50), chr(10), ' ') || '...' ELSE x END, x, 'paragraph' FROM (
    SELECT doc_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS k FROM (
      SELECT doc_id, list_slice(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {_STRIP % "x"}), lambda x: length(x) >= 50), 1, 50) AS ps FROM s WHERE len(starts) < 2 AND length(t) > 5000))
  UNION ALL
  SELECT doc_id, 1, '1', 'Terms and Conditions', t, 'single_section' FROM s WHERE len(starts) = 0 AND length(t) <= 5000)"""
_BOTH = (*PARTS, *DOTS)
_CLAUSES = rf"""{_SECTIONS},
cl AS (SELECT doc_id, section_no, section_title, content, string_split(content, chr(10)) AS lines FROM sec),
ch AS (SELECT *, {_hits_sql(_BOTH)} AS hits FROM cl),
cp AS (SELECT *, CASE {' '.join(f'WHEN len(hits[{k}]) >= 2 THEN {k}' for k in range(1, len(_BOTH) + 1))} ELSE 0 END AS p FROM ch),
clause AS (
  SELECT doc_id, section_no, k AS clause_no, CASE WHEN p <= {len(PARTS)} THEN {_case(PARTS, "head", 1)} ELSE CAST(k AS VARCHAR) END AS clause_id, {_STRIP % "body"} AS clause_text FROM (
    SELECT *, {_STRIP % "lines[st]"} AS head, array_to_string(lines[st:coalesce(starts[k + 1] - 1, len(lines))], chr(10)) AS body FROM (
      SELECT *, unnest(starts) AS st, unnest(range(1, len(starts) + 1)) AS k FROM (SELECT *, hits[p] AS starts FROM cp WHERE p > 0)))
  UNION ALL SELECT doc_id, section_no, 1, '1', content FROM cp WHERE p = 0)"""
_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in RULES)


def _found_sql(source: str, keys: str, text: str) -> str:
    return rf"""
rules AS (SELECT *, string_split(keyword, ' ') AS kw FROM (VALUES {_RULES}) t({RULE_SCHEMA.replace(' string', '')})),
prep AS (SELECT {keys}, clean, list_filter(string_split_regex(clean, '\s+'), lambda x: x <> '') AS tokens FROM (SELECT {keys}, regexp_replace(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g') AS clean FROM {source})),
hit AS (
  SELECT {keys}, indicator, keyword, severity, relevant_for FROM prep, rules WHERE contains(clean, keyword) OR
    (len(kw) > 1 AND len(list_filter(kw, lambda w: NOT contains(clean, w))) = 0 AND
     list_max(list_filter(range(1, len(tokens) + 1), lambda i: list_contains(kw, tokens[i]))) - list_min(list_filter(range(1, len(tokens) + 1), lambda i: list_contains(kw, tokens[i]))) < 20)),
found AS (SELECT {keys}, indicator, any_value(severity) AS severity, count(DISTINCT keyword) AS keywords, bool_or(severity <> 'context' OR relevant_for IN ('music', 'general')) AS applies FROM hit GROUP BY {keys}, indicator)"""


_HEADING = r"""
hl AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents),
hd AS (SELECT doc_id, i AS line_no, lower(x) AS heading FROM (SELECT doc_id, l, i, l[i] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM hl))
  WHERE x <> '' AND ((upper(x) = x AND lower(x) <> x AND length(x) < 100) OR regexp_matches(x, '^([0-9]+\.|[0-9]+\)|[A-Za-z0-9_]+\.|[IVX]+\.)[ \t]+[A-Z]') OR (i > 1 AND l[i - 1] = '' AND regexp_matches(x, '^[A-Z]') AND length(x) < 100)))"""
_TYPES = ", ".join(str(t).replace('"', "'") for t in TYPES)

PLANS: Plans = {
    "c01_header_patterns": (c1, f"WITH {_C1} SELECT doc_id, {', '.join(f'CAST(len(hits[{k}]) AS BIGINT) AS hits_{k}' for k in range(1, len(HEADS) + 1))}, CAST(p AS BIGINT) AS chosen FROM c"),
    "c02_c03_c04_sections": (c2, f"WITH {_SECTIONS} SELECT * FROM sec"),
    "c05_clauses": (c5, f"WITH {_CLAUSES} SELECT * FROM clause"),
    "c06_structure_statistics": (
        c6,
        f"""WITH {_CLAUSES}, e AS (SELECT doc_id, section_no, count(*) AS n FROM clause GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS sections, sum(n) AS clauses, round(avg(n), 6) AS mean_clauses, min(n) AS min_clauses, max(n) AS max_clauses, count(*) FILTER (n > 1) AS multi_clause_sections FROM e GROUP BY doc_id)
SELECT d.doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, CAST(coalesce(sections, 0) AS BIGINT) AS sections, CAST(coalesce(clauses, 0) AS BIGINT) AS clauses, coalesce(mean_clauses, 0) AS mean_clauses, CAST(coalesce(min_clauses, 0) AS BIGINT) AS min_clauses, CAST(coalesce(max_clauses, 0) AS BIGINT) AS max_clauses, CAST(coalesce(multi_clause_sections, 0) AS BIGINT) AS multi_clause_sections
FROM documents d LEFT JOIN g USING (doc_id)""",
    ),
    "c07_pattern_report": (
        c7,
        f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
p AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}')" for k, p in enumerate(HEADS, 1))}) t(pattern_no, pattern)),
h AS (SELECT doc_id, pattern_no, row_number() OVER (PARTITION BY doc_id, pattern_no ORDER BY line_no) AS place, line_no, line, {_case(HEADS, "line", 1).replace("CASE p", "CASE pattern_no")} AS group_1, {_case(HEADS, "line", 2).replace("CASE p", "CASE pattern_no")} AS group_2 FROM l, p WHERE regexp_matches(line, pattern))
SELECT * FROM h WHERE place <= 3""",
    ),
    "c08_headings": (c8, f"WITH {_HEADING} SELECT * FROM hd"),
    "c09_chunks": (
        c9,
        r"""
WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 51) + 1, 450)) AS a FROM d WHERE len(w) > 500),
u AS (SELECT doc_id, 0 AS chunk_index, text AS chunk FROM d WHERE len(w) <= 500 UNION ALL SELECT doc_id, a // 450, array_to_string(w[a + 1:a + 500], ' ') FROM s)
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(len(string_split_regex(chunk, '\s+')) AS INT) AS words, md5(chunk) AS chunk_md5 FROM u""",
    ),
    "c10_report_clauses": (
        c10,
        rf"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_STRIP % 'x'}), lambda x: x <> '') AS a, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: x <> '') AS b FROM documents),
c AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a ELSE b END AS x FROM d)
SELECT doc_id, k AS clause_no, md5(y) AS clause_md5 FROM (SELECT doc_id, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS k FROM c)""",
    ),
    "c11_c12_nested_flattened": (c11, f"WITH {_CLAUSES} SELECT doc_id, section_no, clause_no, CASE WHEN clause_no % 2 = 1 THEN clause_id ELSE section_no || '.' || clause_no END AS clause_number FROM clause"),
    "d01_d02_indicators": (d1, f"WITH {_found_sql('documents', 'doc_id', 'text')} SELECT doc_id, indicator, severity, keywords, applies FROM found"),
    "d03_d04_indicator_score": (
        d3,
        f"""WITH {_found_sql('documents', 'doc_id', 'text')} SELECT doc_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'context') AS context, count(*) AS total,
least(sum(CASE WHEN severity = 'high' THEN 3.0 WHEN severity = 'medium' THEN 1.5 WHEN applies THEN 0.5 ELSE 0.0 END), 10.0)::DOUBLE AS indicator_score FROM found GROUP BY doc_id""",
    ),
    "d05_document_type": (
        d5,
        rf"""
WITH {_HEADING}, rules AS (SELECT * FROM (VALUES {_TYPES}) t(type_no, type, part, keyword, weight)),
t AS (SELECT d.doc_id, lower(text) AS t, heads FROM documents d LEFT JOIN (SELECT doc_id, list(string_split_regex(heading, '[ \t]+')) AS heads FROM hd GROUP BY doc_id) USING (doc_id)),
hit AS (SELECT doc_id, type_no, type, part, keyword, weight FROM t, rules WHERE CASE part WHEN 'title' THEN contains(left(t, 500), keyword) WHEN 'content' THEN contains(t, keyword)
  ELSE len(list_filter(coalesce(heads, []), lambda h: len(list_intersect(h, string_split(keyword, ' '))) / len(string_split(keyword, ' ')) >= 0.6)) > 0 END),
sc AS (SELECT doc_id, type_no, type, CAST(sum(weight) AS DOUBLE) AS score, string_agg(DISTINCT part || ': ' || keyword, ',' ORDER BY part || ': ' || keyword) AS matched FROM hit GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type_no) AS place FROM sc),
b AS (SELECT doc_id, max(type) FILTER (place = 1) AS document_type, max(least(score / 15.0, 1.0)) FILTER (place = 1) AS confidence, max(matched) FILTER (place = 1) AS matched, string_agg(type, ',' ORDER BY place) FILTER (place BETWEEN 2 AND 4) AS secondary FROM rk GROUP BY doc_id)
SELECT doc_id, coalesce(document_type, 'other') AS document_type, round(coalesce(confidence, 0.0), 6) AS confidence, coalesce(matched, '') AS matched, coalesce(secondary, '') AS secondary FROM documents LEFT JOIN b USING (doc_id)""",
    ),
    "d16_required_terms": (
        d16,
        f"""WITH r AS (SELECT * FROM (VALUES {', '.join(map(str, TERMS))}) t(lang, term)), j AS (SELECT doc_id, d.lang, term, contains(lower(text), replace(term, '_', ' ')) AS has FROM documents d LEFT JOIN r ON d.lang = r.lang)
SELECT doc_id, lang, coalesce(string_agg(term, ',' ORDER BY term) FILTER (has), '') AS found, coalesce(string_agg(term, ',' ORDER BY term) FILTER (NOT has), '') AS missing, round(coalesce(avg(CAST(has AS DOUBLE)), 1.0), 6) AS compliance, count(*) FILTER (NOT has) = 0 AS compliant, coalesce(string_agg(printf('{fixed.MISSING_ADVICE}', replace(term, '_', ' '), lang), '; ' ORDER BY replace(term, '_', ' ')) FILTER (NOT has), '') AS recommendations FROM j GROUP BY doc_id, lang""",
    ),
    "d17_d18_prohibited_expected": (
        d17,
        """SELECT doc_id, array_to_string(list_slice(list_filter(CASE lang WHEN 'en' THEN ['Of the', 'zz', 'and', 'in', 'is'] WHEN 'fr' THEN ['DE', 'la'] ELSE [] END, lambda t: contains(lower(text), lower(t))), 1, 3), ',') AS prohibited,
len(list_filter(['src_1', 'x_src3', 'src20'], lambda x: contains(x, source) OR contains(source, x))) > 0 AS expected FROM documents""",
    ),
    "flagship_riskiest": (
        flagship,
        f"""WITH {_CLAUSES}, {_found_sql('clause', 'doc_id, section_no, clause_no', 'clause_text')},
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT indicator) AS categories FROM found GROUP BY doc_id),
fs AS (SELECT *, round(CAST(greatest(1.0, least(10.0, least(n / 2, 4.0) + least(0.75 * high + 0.35 * medium + 0.15 * (n - high - medium), 4.0) + least(0.5 * categories, 2.0))) AS DOUBLE), 6) AS risk_score FROM t)
SELECT *, CASE WHEN risk_score >= 7 THEN 'High' WHEN risk_score >= 4 THEN 'Medium' ELSE 'Low' END AS risk_level FROM fs ORDER BY risk_score DESC, n DESC, doc_id LIMIT 10""",
    ),
}
