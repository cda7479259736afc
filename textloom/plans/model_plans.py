"""Wording features of documents, outliers by them, and calibration with its refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import features as W
from textloom.operators import models as M
from textloom.plans.common import Plans, table
from textloom.plans.report_plans import _FB, _OUT, _REL, feedback, outcomes
from textloom.plans.scoring_plans import anomalies
from textloom.plans.text_plans import _FLESCH, _SENT, _SYL
from textloom.rules import fixed
from textloom.session import cut, shared_dir
from textloom.sources import corpus

#: The fixed lists and some words that the given documents do hold.
WORDING = {
    "modal": fixed.MODAL_VERBS,
    "negation": (*fixed.NEGATIONS, "on", "an"),
    "conditional": (*fixed.CONDITIONALS, "as"),
    "risk": (*fixed.RISK_KEYWORDS, "that", "for.*with"),
    "jargon": (*fixed.LEGAL_JARGON, "the", "is", "der"),
}
COUNTS = ("modal", "negation", "conditional", "risk", "jargon")


def features(s, d):
    return W.clause_features(table(s, d, "documents").select("doc_id", "text"), **WORDING).drop("text")


def d11(s, d):
    return features(s, d).withColumns({c: F.round(c, 6) for c in W.FEATURES})


def d12(s, d):
    own = M.profile(W.with_features(features(s, d)), list(W.FEATURES))
    return own.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


def f4(s, d):
    return M.importance(cut(W.with_features(features(s, d))), list(W.FEATURES), "doc_id").select("doc_id", "feature", F.round("importance", 6).alias("importance"))


def f2(s, d):
    own = cut(W.with_features(features(s, d)))
    forest = M.isolation_forest(own, list(W.FEATURES), "doc_id")
    return M.outlier_scores(own, forest, list(W.FEATURES), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "is_outlier", F.round("confidence", 6).alias("confidence"))


def a13_forest(s, d):
    """Scores of a forest that was fitted, saved, loaded, and walked by built-in functions."""
    own = cut(W.with_features(features(s, d)))
    path = shared_dir(s, "forest")
    corpus.save_model({"forest": M.isolation_forest(own, list(W.FEATURES), "doc_id")}, path)
    forest = corpus.load_model(s, path, ["forest"])["forest"]
    return M.forest_scores(own, forest, list(W.FEATURES), "doc_id").withColumn("score", F.round("score", 6))


def f5(s, d):
    own = outcomes(s, d)
    out = M.calibrate(own.select("doc_id", F.col("predicted").alias("confidence")), M.calibration_knots(own, "predicted", "actual"))
    return out.select("doc_id", F.round("calibrated_confidence", 6).alias("calibrated_confidence"), "confidence_tier", "tier_label", "explanation")


def f8(s, d):
    own = M.quality_with_feedback(M.fit_report(outcomes(s, d), "predicted", "actual"), M.feedback_statistics(feedback(s, d).filter("is_valid")))
    return own.select("total", "quality", "status", "size", *[F.round(c, 6).alias(c) for c in ("brier", "ece", "brier_after", "improvement", "dismissal_rate", "accuracy")])


def f9(s, d):
    own = M.calibrate(anomalies(s, d), M.calibration_knots(outcomes(s, d), "predicted", "actual"))
    out = M.calibration_summary(own, "document_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "mean_adjustment", "least", "most")})


def f14(s, d):
    own = M.refits(feedback(s, d).filter("is_valid"), ["created_at", "anomaly_id"], "document_id", 50)
    return own.withColumns({c: F.round(c, 6) for c in ("brier_before", "brier_after")})


def _train(s, d, rows):
    path = f"{shared_dir(s, 'feedback')}/feedback.json"
    M.export_feedback(rows.select("user_action", F.round("confidence", 2).alias("confidence"), "was_correct", F.col("created_at").alias("feedback_date")), path)
    return M.train_calibrator(s, path)[1]


def f15(s, d):
    """A calibrator trained from a file of all feedback, and one from a file of too little."""
    rows = feedback(s, d)
    both = _train(s, d, rows).withColumn("kind", F.lit("all")).unionByName(_train(s, d, rows.filter("document_id = 1").orderBy("anomaly_id").limit(20)).withColumn("kind", F.lit("few")))
    return both.withColumns({c: F.round(c, 6) for c in ("ece", "brier", "brier_after")})


def f11(s, d):
    names = F.element_at(F.array(*map(F.lit, ("helpful", "acted_on", "dismiss", "not_applicable", "other"))), (F.col("anomaly_id") % 5 + 1).cast("int"))
    own = anomalies(s, d).withColumn("outside", names).withColumn("user_action", M.inside_action(F.col("outside")))
    return M.labelled_feedback(own).select("anomaly_id", "outside", "user_action", "was_correct", F.coalesce("is_valid", F.lit(False)).alias("is_valid"))


def _matches(words, column: str) -> str:
    return " + ".join("len(regexp_extract_all(%s, '\\b%s\\b'))" % (column, w.replace("'", "''")) for w in words)


def feature_sql(source: str, key: str, text: str) -> str:
    """CTEs up to ``ft``: ``key`` and the nine features of ``text`` in ``source``."""
    lower = r"regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g')"
    counts = ", ".join(f"{_matches(WORDING[c], 'lt')} AS n_{c}" for c in COUNTS)
    return rf"""
f0 AS (SELECT {key}, trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM {source}),
f1 AS (SELECT *, {lower} AS lt, regexp_extract_all(text, '[a-zA-Z]+') AS w, {_SENT} AS sentences FROM f0 WHERE length(text) >= 10),
f2 AS (SELECT *, coalesce({_SYL}, 0) AS syl, {counts} FROM f1),
ft AS (SELECT {key}, CAST(length(text) AS DOUBLE) AS clause_length, CAST(sentences AS DOUBLE) AS sentence_count, length(text) / greatest(sentences, 1) AS avg_sentence_length, CAST({_FLESCH} AS DOUBLE) AS flesch_kincaid_score, CAST(n_modal AS DOUBLE) AS modal_verb_count,
  CAST(n_negation AS DOUBLE) AS negation_count, CAST(n_conditional AS DOUBLE) AS conditional_count, CAST(n_risk AS DOUBLE) AS risk_keyword_count, CASE WHEN len(w) > 0 THEN n_jargon / len(w) * 100.0 ELSE 0.0 END AS legal_jargon_density FROM f2)"""


_FT = feature_sql("documents", "doc_id", "text")
_LONG = f"{_FT}, lg AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, {c} AS value FROM ft" for c in W.FEATURES) + ")"


def isotonic_sql(source: str, keys: tuple[str, ...], x: str, y: str, out: str) -> str:
    """CTEs up to ``out``: for each of ``keys`` the distinct ``x`` of ``source`` with their isotonic value ``yhat``.

    The value at a point is the greatest, over starts before it, of the least mean up to an end after it.
    """
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    using = "".join(f"j.{k} = k.{k} AND " for k in keys)
    per = f"PARTITION BY {by}j "
    return f"""
{out}0 AS (SELECT {by}{x} AS x, count(*) AS n, sum({y}) AS s FROM {source} GROUP BY {by}{x}),
{out}1 AS (SELECT *, row_number() OVER ({part}ORDER BY x) AS i, sum(n) OVER ({part}ORDER BY x) AS nn, sum(s) OVER ({part}ORDER BY x) AS ss FROM {out}0),
{out}2 AS (SELECT {''.join(f'j.{k}, ' for k in keys)}j.i AS j, k.i AS k, (k.ss - j.ss + j.s) / (k.nn - j.nn + j.n) AS a FROM {out}1 j JOIN {out}1 k ON {using}j.i <= k.i),
{out}3 AS (SELECT {by}j, k, min(a) OVER ({per}ORDER BY k DESC) AS m FROM {out}2),
{out}4 AS (SELECT {by}k AS i, max(m) AS yhat FROM {out}3 GROUP BY {by}k),
{out} AS (SELECT {by}x, yhat FROM {out}1 JOIN {out}4 USING ({by}i))"""


_ISO = f"{_REL}, {isotonic_sql('oc', (), 'predicted', 'actual', 'iso')}"
_ONE_TIER = "CASE WHEN {c} >= 0.85 THEN {h} WHEN {c} >= 0.60 THEN {m} ELSE {l} END"
_TIER = _ONE_TIER.format(c="yhat", h="'HIGH'", m="'MODERATE'", l="'LOW'")
_LABEL = _ONE_TIER.format(c="yhat", h="'High Confidence'", m="'Moderate Confidence'", l="'Low Confidence'")
_P = "CAST(floor(yhat * 100) AS INT)"
_SAID = _ONE_TIER.format(c="yhat", **{k: "'" + fixed.TIER_TEXTS[n].replace("%d%%", f"' || {_P} || '%") + "'" for k, n in (("h", "HIGH"), ("m", "MODERATE"), ("l", "LOW"))})

PLANS: Plans = {
    "d11_clause_features": (d11, f"WITH {_FT} SELECT doc_id, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in W.FEATURES)} FROM documents LEFT JOIN ft USING (doc_id)"),
    "d11_d12_feature_profile": (d12, f"WITH {_LONG} SELECT feature, round(avg(value), 4)::DOUBLE AS mean, round(stddev_pop(value), 4)::DOUBLE AS std, round(min(value), 6)::DOUBLE AS min, round(max(value), 6)::DOUBLE AS max FROM lg GROUP BY feature"),
    "f01_f04_importance": (
        f4,
        f"WITH {_LONG}, st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM lg GROUP BY feature) SELECT doc_id, feature, round(abs((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6)::DOUBLE AS importance FROM lg JOIN st USING (feature)",
    ),
    "f02_f03_outliers": (f2, None),
    "a13_f03_stored_forest": (a13_forest, None),
    "f05_f06_calibrated": (f5, f"WITH {_ISO} SELECT doc_id, round(yhat, 6)::DOUBLE AS calibrated_confidence, {_TIER} AS confidence_tier, {_LABEL} AS tier_label, {_SAID} AS explanation FROM oc JOIN iso ON predicted = x"),
    "f08_f16_calibration_quality": (
        f8,
        f"""WITH {_ISO}, {_FB.strip()}, g AS (SELECT count(*) AS total, avg(pow(predicted - actual, 2)) AS brier, avg(pow(yhat - actual, 2)) AS after FROM oc JOIN iso ON predicted = x), e AS (SELECT sum(n * abs(mp - ma)) AS gap FROM rel),
st AS (SELECT count(*) AS size, count(*) FILTER (user_action = 'dismissed') / count(*) AS dismissal_rate, count(*) FILTER (was_correct) / count(*) AS accuracy FROM fl WHERE is_valid)
SELECT total, CASE WHEN gap / total < 0.05 THEN 'excellent' WHEN gap / total < 0.10 THEN 'good' WHEN gap / total < 0.15 THEN 'fair' ELSE 'poor' END AS quality, CASE WHEN gap / total < 0.05 THEN 'GOOD' ELSE 'NEEDS_ATTENTION' END AS status, size,
round(brier, 6)::DOUBLE AS brier, round(gap / total, 6)::DOUBLE AS ece, round(after, 6)::DOUBLE AS brier_after, round((brier - after) / brier * 100, 6)::DOUBLE AS improvement, round(dismissal_rate, 6)::DOUBLE AS dismissal_rate, round(accuracy, 6)::DOUBLE AS accuracy FROM g, e, st""",
    ),
    "f09_calibration_summary": (
        f9,
        f"""WITH {_ISO}, {_FB.strip()},
ip AS (SELECT a.document_id, a.confidence, CASE WHEN lo.x IS NULL THEN hi.yhat WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.yhat ELSE lo.yhat + (hi.yhat - lo.yhat) * (a.confidence - lo.x) / (hi.x - lo.x) END AS y
  FROM a ASOF LEFT JOIN iso lo ON a.confidence >= lo.x ASOF LEFT JOIN iso hi ON a.confidence <= hi.x)
SELECT document_id, round(avg(y), 6)::DOUBLE AS mean, round(stddev_pop(y), 6)::DOUBLE AS std, round(avg(y - confidence), 6)::DOUBLE AS mean_adjustment, round(min(y - confidence), 6)::DOUBLE AS least, round(max(y - confidence), 6)::DOUBLE AS most,
count(*) FILTER (y >= 0.85) AS high, count(*) FILTER (y >= 0.60 AND y < 0.85) AS moderate, count(*) FILTER (y < 0.60) AS low FROM ip GROUP BY document_id""",
    ),
    "f11_action_names": (
        f11,
        f"WITH {_FB.strip()}, n AS (SELECT *, ['helpful', 'acted_on', 'dismiss', 'not_applicable', 'other'][anomaly_id % 5 + 1] AS outside FROM a) SELECT anomaly_id, outside, CASE outside WHEN 'dismiss' THEN 'dismissed' WHEN 'not_applicable' THEN 'false_positive' WHEN 'other' THEN NULL ELSE outside END AS user_action, CASE WHEN outside IN ('helpful', 'acted_on') THEN true WHEN outside <> 'other' THEN false END AS was_correct, outside <> 'other' AND confidence BETWEEN 0 AND 1 AS is_valid FROM n",
    ),
    "f14_refits": (
        f14,
        f"""WITH {_FB.strip()}, g AS (SELECT *, CAST((row_number() OVER (PARTITION BY document_id ORDER BY created_at, anomaly_id) - 1) // 50 AS BIGINT) AS generation, CAST(was_correct AS INT)::DOUBLE AS y FROM fl WHERE is_valid),
{isotonic_sql('g', ('document_id', 'generation'), 'c2', 'y', 'iso')},
s AS (SELECT document_id, generation, count(*) AS n, count(*) FILTER (was_correct) AS correct, count(*) FILTER (user_action = 'dismissed') AS dismissed, avg(pow(c2 - y, 2)) AS b, avg(pow(yhat - y, 2)) AS f FROM g JOIN iso USING (document_id, generation) WHERE c2 = x GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 50 THEN 'waiting' WHEN correct = 0 OR correct = n THEN 'one_class' WHEN dismissed / n > 0.20 THEN 'refit_with_warning' ELSE 'refit' END AS action FROM s)
SELECT document_id, generation, n, correct, dismissed, action, CASE WHEN action LIKE 'refit%' THEN round(b, 6)::DOUBLE END AS brier_before, CASE WHEN action LIKE 'refit%' THEN round(f, 6)::DOUBLE END AS brier_after FROM t""",
    ),
    "f15_train_from_file": (
        f15,
        f"""WITH {_FB.strip()}, oc AS (SELECT round(c2, 2) AS predicted, CAST(was_correct AS INT)::DOUBLE AS actual FROM fl WHERE was_correct IS NOT NULL AND round(c2, 2) BETWEEN 0 AND 1),
{isotonic_sql('oc', (), 'predicted', 'actual', 'iso')}, rel AS (SELECT ceil(predicted * 10) AS bin, count(*) AS n, avg(predicted) AS mp, avg(actual) AS ma FROM oc WHERE predicted > 0 GROUP BY 1),
g AS (SELECT count(*) AS samples, avg(pow(predicted - actual, 2)) AS brier, avg(pow(yhat - actual, 2)) AS after FROM oc JOIN iso ON predicted = x), e AS (SELECT sum(n * abs(mp - ma)) AS gap FROM rel),
w AS (SELECT * FROM fl WHERE document_id = 1 ORDER BY anomaly_id LIMIT 20)
SELECT 'all' AS kind, samples, true AS fitted, round(gap / samples, 6)::DOUBLE AS ece, round(brier, 6)::DOUBLE AS brier, round(after, 6)::DOUBLE AS brier_after, gap / samples > 0.05 AS ece_alert FROM g, e
UNION ALL SELECT 'few', count(*), false, NULL, NULL, NULL, false FROM w WHERE was_correct IS NOT NULL AND round(c2, 2) BETWEEN 0 AND 1""",
    ),
}
