"""Vector queries over embeddings; labels stand for categories and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import vectors as V
from textloom.plans.common import Plans, table
from textloom.session import cut


def emb(s, d):
    return table(s, d, "embeddings").withColumn("namespace", F.col("vec_id") % 2)


def _queries(s, d, every=20):
    """The stated query set: every row whose id is divisible by ``every``."""
    return emb(s, d).filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")


def _templates(s, d):
    """The first three vectors of every label as templates."""
    first = F.row_number().over(V.Window.partitionBy("label").orderBy("vec_id"))
    own = table(s, d, "embeddings").withColumn("r", first).filter("r <= 3")
    return own.select(F.col("label").alias("type"), F.col("vec_id").alias("template"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "high").otherwise("medium").alias("severity"))


def e2(s, d):
    e = table(s, d, "embeddings")
    o = table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"), F.round(V.cosine("embedding", "other", True), 6).alias("clamped"))


def e3(s, d):
    return V.top_k(_queries(s, d), emb(s, d), 5, equal=("namespace",)).select("query_id", "vec_id", "place", F.round("score", 6).alias("score"))


def _with_text(near, s, d):
    """Neighbours with the text of the document of the same number."""
    return near.join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")


def e4(s, d):
    near = _with_text(V.top_k(_queries(s, d), emb(s, d), 10, equal=("label",)), s, d)
    own = V.citations(near, _queries(s, d))
    return own.withColumn("confidence", F.round("confidence", 6)).withColumn("cited_text", F.md5("cited_text"))


def e5(s, d):
    return V.template_matches(table(s, d, "embeddings"), _templates(s, d), 0.5).select("vec_id", "type", "template", "severity", F.round("similarity", 6).alias("similarity"))


def e6(s, d):
    known = table(s, d, "embeddings").filter("vec_id % 3 = 0").select("vec_id", F.col("label").alias("type"))
    return V.template_matches(table(s, d, "embeddings"), _templates(s, d), 0.5).select("vec_id", "type").join(known, ["vec_id", "type"], "left_anti").unionByName(known)


def e7(s, d):
    own = V.pattern_library(table(s, d, "embeddings"), _templates(s, d), 0.5)
    return own.select("vec_id", "best", "category", "matches", "categories", F.round("similarity", 6).alias("similarity"), "is_anomaly", F.round("confidence", 6).alias("confidence"), "severity")


def e8(s, d):
    q = _queries(s, d)
    own = V.prevalence(V.top_k(q, emb(s, d), 20), q)
    return own.select("query_id", F.round("prevalence", 6).alias("prevalence"))


def e9(s, d):
    base = emb(s, d).withColumn("document_id", F.col("vec_id") % 40)
    own = V.industry_prevalence(V.top_k(_queries(s, d), base, 100, equal=("label",)), base, threshold=0.5)
    return own.withColumn("prevalence", F.round("prevalence", 6))


def e10(s, d):
    near = _with_text(V.top_k(_queries(s, d), emb(s, d), 10).filter("place <= 3"), s, d)
    return near.select("query_id", "place", "vec_id", "label", F.left(F.coalesce("text", F.lit("")), F.lit(100)).alias("preview"))


def e11(s, d):
    e = emb(s, d).withColumn("company", F.col("vec_id") % 7).withColumn("document", F.col("vec_id") % 40)
    return V.baseline_composition(e, "label", "company", "document", 30)


def _grouped(s, d):
    e = table(s, d, "embeddings")
    return V.groups(e, V.similar_links(e, 0.55))


def e12(s, d):
    return _grouped(s, d)


def e13(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("section"), (F.col("vec_id") % 10 / 10.0).alias("confidence"))
    own = V.cluster_summary(_grouped(s, d).join(e, "vec_id"))
    return own.withColumn("mean_confidence", F.round("mean_confidence", 6))


def e16(s, d):
    return _rounded(V.cluster_statistics(_grouped(s, d)))


def _rounded(own):
    return own.withColumns({c: F.round(c, 6) for c in ("mean_size", "reduction")})


def _texts(s, d):
    """Documents as rows to group: source for section, language for category."""
    docs = table(s, d, "documents")
    severity = F.element_at(F.array(*map(F.lit, V.SEVERITIES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("section"), F.coalesce("lang", F.lit("none")).alias("category"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), severity.alias("severity"), "text")


def _hashed(s, d):
    """Hashed vectors of documents, made once."""
    return cut(V.hashed_vectors(table(s, d, "documents")).withColumnRenamed("doc_id", "vec_id"))


def e12_documents(s, d):
    """Documents of 0.95 cosine and more in connected groups."""
    v = _hashed(s, d)
    return V.groups(v, V.similar_links(v, 0.95))


def e12_greedy(s, d):
    """Documents in groups as one pass in order of their ids makes them."""
    v = _hashed(s, d)
    return V.greedy_similar(v, 0.95)


def e13_consolidated(s, d):
    return V.consolidated(e12_greedy(s, d).join(_texts(s, d), "vec_id")).withColumn("confidence", F.round("confidence", 6))


def e14_clusters(s, d):
    """Documents in density clusters, single ones as noise."""
    return V.density_clusters(e12_documents(s, d))


def e14_core(s, d):
    """Documents in density clusters by core points."""
    v = _hashed(s, d)
    return V.core_clusters(v, 0.95, 3)


def e15_report(s, d):
    found = V.cluster_report(e14_clusters(s, d).join(_texts(s, d), "vec_id"))
    return found.withColumn("average_confidence", F.round("average_confidence", 6)).withColumn("consolidated_text", F.md5("consolidated_text"))


def e16_documents(s, d):
    return _rounded(V.cluster_statistics(e12_documents(s, d)))


def e1(s, d):
    """The places of every document's vector that are not 0."""
    own = V.hashed_vectors(table(s, d, "documents")).select("doc_id", F.posexplode("embedding").alias("place", "value"))
    return own.filter("value != 0").withColumn("value", F.round("value", 6))


def e17(s, d):
    own = table(s, d, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return own.filter("n > 1")


_TOP = """
q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql, vec_id % 2 AS qn FROM embeddings WHERE vec_id % {every} = 0),
t AS (SELECT query_id, vec_id, label, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) DESC, vec_id) AS place FROM q, embeddings WHERE {on}
QUALIFY place <= {k})"""


def _top(every=20, on="true", k=10) -> str:
    return _TOP.format(every=every, on=on, k=k)


_TPL = """
tpl AS (SELECT label AS type, vec_id AS template, embedding AS vector, CASE WHEN label % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
sc AS (SELECT vec_id, type, template, severity, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])), 9) AS s FROM embeddings, tpl),
tm AS (SELECT vec_id, type, template, severity, greatest(0, least(1, s)) AS similarity FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id, type ORDER BY greatest(0, least(1, s)) DESC, template DESC) = 1)"""

#: Pairs of embeddings, and of documents by hashed words.
_PAIRS = """
nodes AS (SELECT vec_id AS n FROM embeddings),
pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) >= 0.55)"""
_HASHED = r"""
dw AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents),
dh AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS h FROM dw),
ds AS (SELECT doc_id, h % 64 AS k, CAST(sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM dh GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM ds GROUP BY doc_id)"""
_DOC_PAIRS = f"""{_HASHED},
nodes AS (SELECT doc_id AS n FROM documents),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b FROM ds x JOIN ds y ON x.k = y.k AND x.doc_id < y.doc_id JOIN dn nx ON nx.doc_id = x.doc_id JOIN dn ny ON ny.doc_id = y.doc_id
  WHERE nx.n > 0 AND ny.n > 0 GROUP BY x.doc_id, y.doc_id HAVING round(sum(x.v * y.v) / (any_value(nx.n) * any_value(ny.n)), 9) >= 0.95)"""
_GROUPS = """
e2 AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr),
r(n, g) AS (SELECT n, n FROM nodes UNION SELECT e2.y, r.g FROM r JOIN e2 ON e2.x = r.n AND r.g < e2.y),
gm AS (SELECT n, min(g) AS group_id FROM r GROUP BY n),
gr AS (SELECT n AS vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM gm)"""
#: In order: a row starts a group unless one of the starts before it is its pair.
_GREEDY = """
nb AS (SELECT row_number() OVER (ORDER BY n) AS i, n, l FROM (SELECT n, coalesce(list(pr.a) FILTER (pr.a IS NOT NULL), []) AS l FROM (SELECT a AS n FROM pr UNION SELECT b FROM pr) LEFT JOIN pr ON pr.b = n GROUP BY n)),
g(i, starts) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT nb.i, CASE WHEN list_has_any(nb.l, g.starts) THEN g.starts ELSE list_append(g.starts, nb.n) END FROM g JOIN nb ON nb.i = g.i + 1),
st AS (SELECT unnest(starts) AS s FROM (SELECT starts FROM g ORDER BY i DESC LIMIT 1)),
gm AS (SELECT n, coalesce((SELECT min(a) FROM pr JOIN st ON st.s = pr.a WHERE pr.b = n), n) AS group_id FROM nodes),
gr AS (SELECT n AS vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM gm)"""
_MEMBERS = """
mb AS (SELECT vec_id, group_id, group_size, source AS section, coalesce(lang, 'none') AS category, (doc_id % 10) / 10.0 AS confidence, ['low', 'medium', 'high'][doc_id % 3 + 1] AS severity, doc_id % 3 AS sv, text FROM gr JOIN documents ON doc_id = vec_id)"""
_STATISTICS = """
sz AS (SELECT DISTINCT group_id, group_size FROM gr)
SELECT count(*) FILTER (group_size > 1) AS clusters, count(*) FILTER (group_size = 1) AS noise, CAST(sum(group_size) AS BIGINT) AS total, round(coalesce(avg(group_size) FILTER (group_size > 1), 0), 6)::DOUBLE AS mean_size,
coalesce(max(group_size) FILTER (group_size > 1), 0) AS max_size, coalesce(min(group_size) FILTER (group_size > 1), 0) AS min_size, round(1 - count(*) / sum(group_size), 6)::DOUBLE AS reduction FROM sz"""

PLANS: Plans = {
    "e01_hashed_vectors": (e1, f"WITH {_HASHED} SELECT doc_id, CAST(k AS INT) AS place, round(v / n, 6) AS value FROM ds JOIN dn USING (doc_id) WHERE v <> 0"),
    "e02_cosine": (e2, "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS clamped FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "e03_top_k": (e3, f"WITH {_top(on='vec_id % 2 = qn', k=5)} SELECT query_id, vec_id, place, round(score, 6) AS score FROM t"),
    "e04_citations": (
        e4,
        f"""WITH {_top(on='label = ql')}, x AS (SELECT query_id, vec_id, place, score, left(coalesce(text, ''), 300) AS s FROM t LEFT JOIN documents ON doc_id = vec_id),
b AS (SELECT query_id, count(*) FILTER (score >= 0.3 AND place <= 5) AS citations, coalesce(max(score) FILTER (score >= 0.3 AND place <= 5), avg(score)) AS confidence,
  coalesce(string_agg(vec_id, ',' ORDER BY place) FILTER (score >= 0.3 AND place <= 5), '') AS cited, coalesce(string_agg('[' || place || '] ' || s, chr(10) ORDER BY place) FILTER (score >= 0.3 AND place <= 5), '') AS cited_text FROM x GROUP BY query_id)
SELECT q.query_id, coalesce(citations, 0) AS citations, round(coalesce(confidence, 0.5), 6) AS confidence, coalesce(cited, '') AS cited, md5(coalesce(cited_text, '')) AS cited_text FROM q LEFT JOIN b USING (query_id)""",
    ),
    "e05_template_matches": (e5, f"WITH {_TPL} SELECT vec_id, type, template, severity, round(similarity, 6) AS similarity FROM tm WHERE similarity >= 0.5"),
    "e06_augmented": (e6, f"WITH {_TPL} SELECT vec_id, type FROM tm WHERE similarity >= 0.5 UNION SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0"),
    "e07_pattern_library": (
        e7,
        f"""WITH {_TPL}, b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, template DESC) = 1),
m AS (SELECT vec_id, coalesce(string_agg(printf('%d %d %.4f', type, template, s), ',' ORDER BY s DESC, template DESC) FILTER (s >= 0.5), '') AS matches, CAST(count(DISTINCT type) FILTER (s >= 0.5) AS INT) AS categories FROM sc GROUP BY vec_id)
SELECT vec_id, template AS best, type AS category, matches, categories, round(s, 6) AS similarity, s >= 0.5 AS is_anomaly, round(CASE WHEN s >= 0.5 THEN 0.5 + 0.5 * (s - 0.5) / 0.5 ELSE greatest(0.0, 0.5 * s / 0.5) END, 6) AS confidence,
CASE WHEN s >= 0.5 THEN severity ELSE 'low' END AS severity FROM b JOIN m USING (vec_id)""",
    ),
    "e08_prevalence": (e8, f"WITH {_top(k=20)}, m AS (SELECT query_id, avg(score) AS m FROM t WHERE place <= 5 GROUP BY query_id) SELECT query_id, round(greatest(0.0, least(1.0, CASE WHEN m > 0.75 THEN 0.6 + (m - 0.75) * 1.2 WHEN m > 0.5 THEN 0.3 + (m - 0.5) * 1.2 ELSE m * 0.6 END)), 6) AS prevalence FROM m"),
    "e09_industry_prevalence": (
        e9,
        f"""WITH {_top(on='label = ql', k=100)}, g AS (SELECT query_id, count(DISTINCT vec_id % 40) FILTER (score >= 0.5) AS matched, coalesce(string_agg(printf('%d %.4f', vec_id, round(score, 9)), ',' ORDER BY place) FILTER (score >= 0.5 AND place <= 10), '') AS matches FROM t GROUP BY query_id),
n AS (SELECT count(DISTINCT vec_id % 40) AS documents FROM embeddings) SELECT query_id, matched, matches, round(matched / documents, 6) AS prevalence, matched / documents >= 0.30 AS common FROM g, n""",
    ),
    "e10_baseline_probe": (e10, f"WITH {_top()} SELECT query_id, place, vec_id, label, left(coalesce(text, ''), 100) AS preview FROM t LEFT JOIN documents ON doc_id = vec_id WHERE place <= 3"),
    "e11_baseline_composition": (e11, "SELECT coalesce(CAST(label AS VARCHAR), 'all') AS category, count(*) AS vectors, count(DISTINCT vec_id % 7) AS companies, count(DISTINCT vec_id % 40) AS documents, count(*) >= 30 AS sufficient FROM embeddings GROUP BY ROLLUP (label)"),
    "e12_e14_duplicate_groups": (e12, f"WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT vec_id, group_id, group_size FROM gr"),
    "e13_e15_cluster_summary": (
        e13,
        f"""WITH RECURSIVE {_PAIRS}, {_GROUPS}, m AS (SELECT gr.*, label AS section, (vec_id % 10) / 10.0 AS confidence FROM gr JOIN embeddings USING (vec_id))
SELECT group_id, first(vec_id ORDER BY confidence DESC, vec_id) AS representative, count(*) AS duplicate_count, string_agg(DISTINCT CAST(section AS VARCHAR), ',' ORDER BY CAST(section AS VARCHAR)) AS sections, round(avg(confidence), 6)::DOUBLE AS mean_confidence FROM m GROUP BY group_id""",
    ),
    "e16_cluster_statistics": (e16, f"WITH RECURSIVE {_PAIRS}, {_GROUPS}, {_STATISTICS}"),
    "e12_similar_documents": (e12_documents, f"WITH RECURSIVE {_DOC_PAIRS}, {_GROUPS} SELECT vec_id, group_id, group_size FROM gr"),
    "e12_greedy_duplicates": (e12_greedy, f"WITH RECURSIVE {_DOC_PAIRS}, {_GREEDY} SELECT vec_id, group_id, group_size FROM gr"),
    "e13_consolidated_duplicates": (
        e13_consolidated,
        f"""WITH RECURSIVE {_DOC_PAIRS}, {_GREEDY}, {_MEMBERS}
SELECT first(vec_id ORDER BY confidence DESC, vec_id) AS vec_id, max(confidence)::DOUBLE AS confidence, count(*) AS duplicate_count, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS original_ids, string_agg(DISTINCT section, ',' ORDER BY section) AS sections, count(*) > 1 AS is_consolidated FROM mb GROUP BY group_id""",
    ),
    "e14_density_clusters": (e14_clusters, f"WITH RECURSIVE {_DOC_PAIRS}, {_GROUPS} SELECT *, CASE WHEN group_size > 1 THEN group_id ELSE -1 END AS cluster_id FROM gr"),
    "e14_core_clusters": (
        e14_core,
        f"""
WITH RECURSIVE {_DOC_PAIRS},
e2 AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr),
dg AS (SELECT n, count(y) AS neighbours FROM nodes LEFT JOIN e2 ON x = n GROUP BY n),
core AS (SELECT n FROM dg WHERE neighbours >= 2),
ce AS (SELECT x, y FROM e2 WHERE x IN (SELECT n FROM core) AND y IN (SELECT n FROM core)),
r(n, g) AS (SELECT n, n FROM core UNION SELECT ce.y, r.g FROM r JOIN ce ON ce.x = r.n AND r.g < ce.y),
gm AS (SELECT n, min(g) AS g FROM r GROUP BY n),
bd AS (SELECT x AS n, min_by(g, y) AS g FROM e2 JOIN gm ON gm.n = y WHERE x NOT IN (SELECT n FROM core) GROUP BY x),
al AS (SELECT dg.n AS vec_id, neighbours, CASE WHEN gm.g IS NOT NULL THEN 'core' WHEN bd.g IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
  coalesce(gm.g, bd.g, -1) AS cluster_id FROM dg LEFT JOIN gm USING (n) LEFT JOIN bd USING (n))
SELECT *, CASE WHEN cluster_id = -1 THEN 0 ELSE count(*) OVER (PARTITION BY cluster_id) END AS cluster_size FROM al""",
    ),
    "e15_cluster_report": (
        e15_report,
        f"""WITH RECURSIVE {_DOC_PAIRS}, {_GROUPS}, {_MEMBERS},
c AS (SELECT group_id AS cluster_id, first(vec_id ORDER BY confidence DESC, vec_id) AS representative, count(*) AS cluster_size, list_sort(list(DISTINCT section)) AS s, first(left(coalesce(text, ''), 200) ORDER BY confidence DESC, vec_id) AS t, avg(confidence) AS m, max(sv) AS v, string_agg(DISTINCT category, ',' ORDER BY category) AS risk_categories FROM mb WHERE group_size > 1 GROUP BY group_id)
SELECT cluster_id, representative, cluster_size, array_to_string(s, ',') AS sections, md5(t || ' [+' || (cluster_size - 1) || ' similar clause(s) in sections: ' || array_to_string(s[2:], ', ') || ']') AS consolidated_text, round(m, 6)::DOUBLE AS average_confidence, ['low', 'medium', 'high'][v + 1] AS overall_severity, risk_categories,
row_number() OVER (ORDER BY cluster_size DESC, cluster_id) AS place FROM c""",
    ),
    "e16_document_cluster_statistics": (e16_documents, f"WITH RECURSIVE {_DOC_PAIRS}, {_GROUPS}, {_STATISTICS}"),
    "e17_exact_duplicates": (e17, "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1"),
}
