"""Operators on hand-made rows, with values worked out by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import features as F_
from textloom.operators import matching as M
from textloom.operators import models, scoring
from textloom.operators import structure as S
from textloom.operators import vectors as V
from textloom.rules import fixed
from textloom.sources import corpus as C
from textloom.streaming import jobs

NUMBERED = "Preamble\n1. Introduction\nWelcome.\n2. User Obligations\n2.1 Be kind.\n2.2 Be brief.\nand clear\n3. Payment Terms\n- pay\n- pay again"


def test_numbered_sections_and_clauses(spark):
    docs = spark.createDataFrame([(1, NUMBERED), (2, "one line"), (3, ""), (4, None)], "doc_id long, text string")
    found = S.sections(docs)
    rows = {(r["doc_id"], r["section_no"]): r for r in found.collect()}
    assert [rows[1, k]["section_title"] for k in (1, 2, 3)] == ["Introduction", "User Obligations", "Payment Terms"]
    assert rows[2, 1]["method"] == "single_section" and rows[2, 1]["section_title"] == "Terms and Conditions"
    assert rows[4, 1]["content"] == ""
    clauses = {(r["doc_id"], r["section_no"], r["clause_no"]): (r["clause_id"], r["clause_text"]) for r in S.clauses(found).collect()}
    assert clauses[1, 2, 1] == ("2.1", "2.1 Be kind.") and clauses[1, 2, 2] == ("2.2", "2.2 Be brief.\nand clear")
    assert clauses[1, 3, 1] == ("1", "- pay") and clauses[1, 3, 2] == ("2", "- pay again")


@pytest.mark.parametrize("header", ["Section {}: Title", "SECTION {} - TITLE", "{} GENERAL TERMS", "{}. Title here"])
def test_header_forms(spark, header):
    text = "\n".join(f"{header.format(k)}\nbody {k}" for k in (1, 2, 3))
    assert S.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 3


def test_paragraphs_of_a_long_text(spark):
    text = "\n\n".join("word " * 30 + str(k) for k in range(60))
    rows = S.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 50 and rows[0]["method"] == "paragraph" and rows[0]["section_title"].endswith("...")


@pytest.mark.parametrize("n,sizes", [(500, [500]), (501, [500, 51]), (1000, [500, 500, 100]), (0, [0])])
def test_chunks(spark, n, sizes):
    rows = S.chunks(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "doc_id long, text string")).collect()
    assert [len(r["chunk"].split()) for r in rows] == sizes


@pytest.mark.parametrize("gap,fires", [(18, True), (19, False)])
def test_words_close_together(spark, gap, fires):
    text = "alpha " + "x " * gap + "beta"
    rules = spark.createDataFrame([("i", "alpha beta", "high", "d", None)], "indicator string, keyword string, severity string, description string, relevant_for string")
    assert bool(M.indicators(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules).count()) == fires


def test_rule_tables_are_bounded(spark):
    with pytest.raises(ValueError):
        M.rule_table(spark.range(M.MAX_RULES + 1))


def test_decay_tiers(spark):
    days = spark.createDataFrame([(d,) for d in (0, 30, 31, 60, 61, 90, 91, 2000, -1)], "days int")
    tiers = spark.createDataFrame(list(fixed.DECAY_TIERS), "days_min int, days_max int, modifier double, label string")
    got = {r["days"]: r["modifier"] for r in scoring.with_tier(days, tiers).collect()}
    assert got == {0: 3.0, 30: 3.0, 31: 2.0, 60: 2.0, 61: 1.5, 90: 1.5, 91: 1.0, 2000: 1.0, -1: 1.0}


@pytest.mark.parametrize("h,m,l", [(0, 0, 3), (2, 3, 4), (8, 0, 9), (3, 9, 9), (12, 12, 12)])
def test_alert_budget_against_queues(spark, h, m, l):
    target, most = 3, 7
    alerts = [(1, k, t, float(100 - k)) for k, t in enumerate(["HIGH"] * h + ["MODERATE"] * m + ["LOW"] * l)]
    got = {r["anomaly_id"]: r["shown"] for r in scoring.budget(spark.createDataFrame(alerts, "document_id long, anomaly_id long, confidence_tier string, ranking_score double"), target=target, most=most).collect()}
    high, mod, low = ([a[1] for a in alerts if a[2] == t] for t in ("HIGH", "MODERATE", "LOW"))
    expected = {k: "high" for k in high[:target]}
    room = most - len(expected)
    queue = high[target:] + mod
    expected |= {k: "medium" for k in queue[:room]}
    rest = most - len(expected)
    expected |= {k: "low" for k in (queue[room:] + low)[:rest]}
    assert got == {a[1]: expected.get(a[1], "suppressed") for a in alerts}


def test_similarity_and_groups(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    one = rows.select("vec_id", V.cosine("embedding", F.array(F.lit(1.0), F.lit(0.0))).alias("c"))
    assert {r["vec_id"]: round(r["c"], 3) for r in one.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}
    pairs = V.similar_pairs(rows, 0.95, size=2, bits=2, tables=8)
    groups = {r["vec_id"]: r["group_id"] for r in V.groups(rows, pairs).collect()}
    assert groups == {1: 1, 2: 1, 5: 1, 3: 3, 4: 4}


def test_similar_pairs_recall(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 64))
    x = np.concatenate([base, base + 0.25 * rng.standard_normal((400, 64))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = {(r["a"], r["b"]) for r in V.similar_pairs(rows, 0.95, recall=0.99).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    assert len(true) > 300 and pairs <= true and len(pairs) / len(true) >= 0.98


def _plain_core(x, threshold, least):
    import numpy as np

    size = np.linalg.norm(x, axis=1)
    near = [[j for j in range(len(x)) if j != i and size[i] and size[j] and round(float(x[i] @ x[j] / size[i] / size[j]), 9) >= threshold] for i in range(len(x))]
    core = [len(n) + 1 >= least for n in near]
    cluster = {}
    for i in range(len(x)):
        if core[i] and i not in cluster:
            reach = [i]
            while reach:
                k = reach.pop()
                if k not in cluster:
                    cluster[k] = i
                    reach += [j for j in near[k] if core[j]]
    for i, own in enumerate(near):
        role = "core" if core[i] else "noise"
        group = cluster.get(i, -1)
        beside = [j for j in own if core[j]]
        if not core[i] and beside:
            role, group = "border", cluster[beside[0]]
        yield i, len(own), role, group


def test_core_clusters_against_plain(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    x = np.concatenate([np.repeat(centres, 12, 0) + 0.2 * rng.standard_normal((72, 8)), rng.standard_normal((30, 8)), centres[:2], centres[:2], np.zeros((2, 8))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None)], "vec_id long, embedding array<double>")
    expected = list(_plain_core(x, 0.95, 4)) + [(200, 0, "noise", -1)]
    sizes = Counter(e[3] for e in expected)
    for block in (7, 1000):
        found = V.core_clusters(rows, 0.95, 4, block=block).collect()
        assert sorted(tuple(r) for r in found) == sorted((*e, sizes[e[3]] if e[3] >= 0 else 0) for e in expected)
    assert {"core", "border", "noise"} <= {e[2] for e in expected}
    assert not V.core_clusters(rows.limit(0)).collect()


def test_groups_of_all_similar_pairs(spark, tmp_path):
    import numpy as np

    from textloom.plans import vector_plans

    rng = np.random.default_rng(1)
    a, b = np.linalg.qr(rng.standard_normal((300, 64, 2)))[0].transpose(2, 0, 1)
    x = np.concatenate([a, 0.56 * a + np.sqrt(1 - 0.56**2) * b, a[:3], np.zeros((2, 64))]).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), k % 4) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    y = x[:-2].astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near, expected = y @ y.T >= 0.55, np.arange(len(x))
    while True:  # the least place within reach
        now = np.concatenate([np.where(near, expected[: len(y)], len(x)).min(axis=1), expected[len(y) :]])
        if (now == expected).all():
            break
        expected = now
    assert len(set(expected.tolist())) < 320
    found = [vector_plans.e12(spark, str(tmp_path)), V.groups(rows, V.similar_links(rows, 0.55, block=150))]
    for own in found:
        assert {r["vec_id"]: r["group_id"] for r in own.collect()} == dict(enumerate(expected.tolist()))


def test_isolation_forest_finds_the_odd_one(spark):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 5)) for k in range(200)] + [(999, 500.0, 500.0)], "doc_id long, a double, b double")
    forest = models.isolation_forest(rows, ["a", "b"], "doc_id", trees=40)
    got = models.outlier_scores(rows, forest, ["a", "b"], "doc_id").orderBy("score").first()
    assert got["doc_id"] == 999 and got["is_outlier"] and got["confidence"] >= 0.5
    with pytest.raises(ValueError):
        models.isolation_forest(rows.limit(0), ["a", "b"], "doc_id")


def test_calibration(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.4, 1.0), (0.4, 0.0), (0.9, 1.0)], "p double, y double")
    knots = models.calibration_knots(rows, "p", "y")
    got = models.calibrate(spark.createDataFrame([(0.0,), (0.4,), (0.65,), (1.0,)], "confidence double"), knots).orderBy("confidence").collect()
    assert [round(r["calibrated_confidence"], 6) for r in got] == [0.0, 0.5, 0.75, 1.0]
    assert [r["confidence_tier"] for r in got] == ["LOW", "LOW", "MODERATE", "HIGH"]
    with pytest.raises(ValueError):
        models.calibration_knots(spark.createDataFrame([(1.5, 1.0)], "p double, y double"), "p", "y")


def test_reliability_bins_leave_out_zero(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.1, 1.0), (0.1000001, 0.0), (1.0, 1.0)], "p double, y double")
    assert {r["bin"]: r["n"] for r in models.reliability(rows, "p", "y").collect()} == {1: 1, 2: 1, 10: 1}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_tos.txt").write_text("some text")
    (tmp_path / "a" / "ok.pdf").write_bytes(b"%PDF-1.4 ... %%EOF")
    (tmp_path / "a" / "bad.pdf").write_bytes(b"nothing %%EOF")
    (tmp_path / "a" / "cut.pdf").write_bytes(b"%PDF-1.4 cut")
    rows = C.read_corpus(spark, str(tmp_path), ["a"])
    meta = spark.createDataFrame([("other.txt", "c", "k", "u")], "filename string, company string, category string, source_url string")
    got = C.with_metadata(rows, meta).first()
    assert (got["text"], got["company"], got["category"], got["source_url"]) == ("some text", "x_tos", "unknown", "")
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in C.admit_files(spark, str(tmp_path / "a")).collect()} == {"x_tos.txt": "extension", "ok.pdf": None, "bad.pdf": "header", "cut.pdf": "end"}
    C.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    C.save_model({"t": rows}, str(tmp_path / "model"))
    assert C.load_model(spark, str(tmp_path / "model"), ["t"])["t"].count() == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("a\r\n\n\n\n<b>x</b>", " null ", "1998-02-31", "Simple cat. Go!")], "t string, n string, d string, s string")
    got = row.select(X.normalize_newlines("t").alias("a"), X.blank_to_null("n").alias("b"), X.iso_date("d").alias("c"), X.sentence_count("s").alias("e"), X.file_name(F.lit("/x/..a b.pdf")).alias("f")).first()
    assert (got["a"], got["b"], got["c"], got["e"], got["f"]) == ("a\n\n<b>x</b>", None, None, 2, "a_b.pdf")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[100:140] = x[0]  # ties go by id
    x[5] = 0
    rows = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<double>, g int").repartition(5)
    queries = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    length = np.linalg.norm(x, axis=1)
    score = np.round(np.divide(x @ x.T, np.outer(length, length), out=np.zeros((300, 300)), where=np.outer(length, length) > 0), 9)
    for equal, block in ((("g",), 4), ((), 2000)):
        got = {(r["query_id"], r["place"]): r["vec_id"] for r in V.top_k(queries, rows, 7, equal=equal, block=block).collect()}
        for q in range(0, 300, 20):
            own = [k for k in range(300) if not equal or k % 3 == q % 3]
            best = sorted(own, key=lambda k: (-score[k, q], k))[:7]
            assert [got[q, place] for place in range(1, 8)] == best
    assert V.top_k(queries.limit(0), rows, 3).count() == 0


def test_citations(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1, "a" * 400), (1, 11, float("nan"), 2, "b"), (1, 12, 0.2, 3, "c"), (2, 13, 0.1, 1, "d"), (2, 14, 0.2, 2, None)], "query_id long, vec_id long, score double, place int, text string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: r for r in V.citations(near, asked).collect()}
    assert (got[1]["citations"], got[1]["confidence"], got[1]["cited"]) == (2, 0.9, "10,11") and got[1]["cited_text"] == "[1] " + "a" * 300 + "\n[2] b"
    assert (got[2]["citations"], round(got[2]["confidence"], 6)) == (0, 0.15) and (got[3]["citations"], got[3]["confidence"]) == (0, 0.5)


def test_greedy_groups_against_one_pass(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05} | {(k, k + 1) for k in range(60, 90)}
    seeds, group = [], {}
    for k in range(100):
        if k not in group:
            seeds.append(k)
            group[k] = k
            for j in range(k + 1, 100):
                if j not in group and (k, j) in pairs:
                    group[j] = k
    rows = spark.range(100).withColumnRenamed("id", "vec_id")
    frame = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs], "a long, b long")
    got = {r["vec_id"]: (r["group_id"], r["group_size"]) for r in V.greedy_groups(rows, frame).collect()}
    size = Counter(group.values())
    assert got == {k: (g, size[g]) for k, g in group.items()}


def test_copies_share_a_greedy_group(spark):
    turn = lambda a: [math.cos(a), math.sin(a)]
    angles = {1: 0.0, 2: 0.3, 3: 0.6, 4: 0.3, 5: 0.6, 6: 2.0}  # neighbours are within 0.95, the ends are not
    rows = spark.createDataFrame([(k, turn(a)) for k, a in angles.items()] + [(7, [0.0, 0.0]), (8, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["group_id"] for r in V.greedy_similar(rows, size=2).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 3, 6: 6, 7: 7, 8: 8}


def test_clusters_consolidate(spark):
    rows = spark.createDataFrame([(1, "s2", 0.5, "low", "x", "one"), (2, "s1", 0.9, "medium", "y", "two"), (3, "s3", 0.9, "high", "x", "three"), (4, "s9", 0.1, "low", "z", "four")], "vec_id long, section string, confidence double, severity string, category string, text string")
    grouped = spark.createDataFrame([(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)], "vec_id long, group_id long, group_size long")
    one = {r["vec_id"]: r for r in V.consolidated(grouped.join(rows, "vec_id")).collect()}
    assert (one[2]["duplicate_count"], one[2]["original_ids"], one[2]["sections"]) == (3, "1,2,3", "s1,s2,s3") and not one[4]["is_consolidated"]
    found = V.cluster_report(V.density_clusters(grouped).join(rows, "vec_id")).collect()
    assert len(found) == 1
    r = found[0]
    assert (r["representative"], r["cluster_size"], r["overall_severity"], r["risk_categories"]) == (2, 3, "high", "x,y")
    assert r["consolidated_text"] == "two [+2 similar clause(s) in sections: s2, s3]"
    stats = V.cluster_statistics(grouped).first()
    assert (stats["clusters"], stats["noise"], stats["min_size"], stats["reduction"]) == (1, 1, 3, 0.5)


def test_forest_scores_against_plain_trees(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((400, 3)), [[9.0, 9.0, 9.0]]])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "doc_id long, a double, b double, c double")
    forest = models.isolation_forest(rows, ["a", "b", "c"], "doc_id", trees=20)
    nodes = {(r["tree"], r["node"]): r for r in forest.collect()}
    average = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(v):
        total = 0.0
        for t in range(20):
            at, depth = 0, 0
            while nodes[t, at]["feature"] >= 0:
                n = nodes[t, at]
                at, depth = n["left"] if v[n["feature"]] <= n["threshold"] else n["right"], depth + 1
            total += depth + average(nodes[t, at]["size"])
        return -(2 ** (-total / 20 / average(nodes[0, 0]["size"])))

    got = {r["doc_id"]: r for r in models.outlier_scores(rows, forest, ["a", "b", "c"], "doc_id").collect()}
    assert all(abs(got[k]["score"] - score(v)) < 1e-9 for k, v in enumerate(x))
    assert got[400]["is_outlier"] and 25 <= sum(r["is_outlier"] for r in got.values()) <= 41
    assert all(nodes[t, 0]["size"] == 256 for t in range(20))


def test_nine_features(spark):
    text = "You must not pay. We may terminate at any time, without notice; if we change the price!"
    got = F_.clause_features(spark.createDataFrame([(1, None, text, 7), (2, "", "short", 7), (3, text, None, 7)], "id long, text string, clause_text string, words int"), ("text", "clause_text")).orderBy("id").collect()
    a, b, c = got
    assert a["clause_length"] == len(text) and a["sentence_count"] == 2 and a["avg_sentence_length"] == len(text) / 2
    # must, may; not; if; terminate, at any time, without notice, change the price; terminate
    assert (a["modal_verb_count"], a["negation_count"], a["conditional_count"], a["risk_keyword_count"]) == (2, 1, 1, 4)
    assert a["legal_jargon_density"] == pytest.approx(100 / 17) and a["words"] == 7
    assert b["clause_length"] is None and [c[f] for f in F_.FEATURES] == [a[f] for f in F_.FEATURES]


def test_calibration_of_many_knots_and_words(spark):
    knots = spark.createDataFrame([(k / 5000, (k / 5000) ** 2) for k in range(5001)], "x double, y double")
    rows = spark.createDataFrame([(0.5,), (0.93,), (0.8,), (1.7,), (None,)], "confidence double")
    got = {r["confidence"]: r for r in models.calibrate(rows, knots).collect()}
    assert got[0.5]["calibrated_confidence"] == pytest.approx(0.25) and got[1.7]["calibrated_confidence"] == 1 and got[None]["calibrated_confidence"] is None
    assert (got[0.93]["confidence_tier"], got[0.93]["tier_label"]) == ("HIGH", "High Confidence")
    assert got[0.8]["explanation"] == "This appears concerning (64% confidence), but review the specifics for your situation."
    plain = models.calibrate(rows, None).filter("confidence = 0.5").first()
    assert plain["calibrated_confidence"] == 0.5 and not plain["is_calibrated"]


def test_isotonic_against_all_means():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        x, y = np.round(rng.random(n), 1), rng.integers(0, 2, n).astype(float)
        at, got = models.isotonic(x, y)
        mean = lambda a, b: y[(x >= at[a]) & (x <= at[b])].mean()
        expected = [max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
        assert np.allclose(got, expected)


def test_refits_and_training_files(spark, tmp_path):
    rows = [(1, k, "helpful" if k % 2 else "dismissed", 0.9 if k % 2 else 0.2, bool(k % 2)) for k in range(25)] + [(2, k, "helpful", 0.5, True) for k in range(12)]
    feedback = spark.createDataFrame(rows, "model long, n long, user_action string, confidence double, was_correct boolean")
    got = {(r["model"], r["generation"]): r for r in models.refits(feedback, ["n"], "model", 10).collect()}
    assert {k: r["action"] for k, r in got.items()} == {(1, 0): "refit_with_warning", (1, 1): "refit_with_warning", (1, 2): "waiting", (2, 0): "one_class", (2, 1): "waiting"}
    assert got[1, 0]["brier_after"] == 0 < got[1, 0]["brier_before"] and got[1, 2]["brier_after"] is None
    assert models.refits(feedback, ["n"], "model", 10, force=True).filter("model = 1 AND generation = 2").first()["action"].startswith("refit")
    path = str(tmp_path / "feedback")
    models.export_feedback(feedback.withColumn("feedback_date", F.lit("2024-01-02 03:04:05").cast("timestamp")), path)
    assert models.import_feedback(spark, path).filter("feedback_date = timestamp'2024-01-02 03:04:05'").count() == 37
    knots, report = models.train_calibrator(spark, path)
    assert knots is None and not report.first()["fitted"] and report.first()["samples"] == 37
    knots, report = models.train_calibrator(spark, path, least=30)
    assert report.first()["fitted"] and knots.count() >= 2


def test_sampling_policy(spark):
    rows = spark.range(6000).select("id", ((F.col("id") % 3) * 0.15 + 0.5).alias("c"))
    share = {round(r["c"], 2): r["s"] for r in rows.groupBy("c").agg(F.avg(models.should_collect(F.col("c"), F.col("id")).cast("int")).alias("s")).collect()}
    assert share[0.5] == 1 and 0.45 < share[0.65] < 0.55 and 0.07 < share[0.8] < 0.13


def test_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, at int")
    assert {(r["k"], r["v"]) for r in C.upsert(old, new, "k", "at").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert C.upsert(old, new, "k").count() == 3


def test_first_seen_again_after_its_time(spark, tmp_path):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    # state goes at the end of a batch, by the watermark before it
    for part in [[("x", 1), ("x", 2)], [("y", 21)], [("z", 22)], [("x", 23), ("y", 24)]]:
        frame = spark.createDataFrame([(c, at(d)) for c, d in part], "content string, ts string").select("content", F.col("ts").cast("timestamp").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = Counter(r["content"] for r in jobs.to_table(jobs.first_seen(stream, "ts", "content", "7 days"), "append", "seen").collect())
    assert got == {"x": 2, "y": 1, "z": 1}


def test_groups_of_large_ids_and_long_chains(spark):
    big = 5 * 10**18
    rows = spark.createDataFrame([(big + k,) for k in range(6)], "vec_id long")
    pairs = spark.createDataFrame([(big + k + 1, big + k) for k in range(4)], "a long, b long")
    assert {tuple(r) for r in V.groups(rows, pairs).collect()} == {(big + k, big, 5) for k in range(5)} | {(big + 5, big + 5, 1)}
    rows = spark.range(600).withColumnRenamed("id", "vec_id")
    chain = spark.createDataFrame([(k, k + 1) for k in range(500)], "a long, b long")
    assert V.groups(rows, chain).filter("group_id = 0 AND group_size = 501").count() == 501
    got = {r["vec_id"]: r["group_id"] for r in V.greedy_groups(rows, chain).collect()}
    assert got == {k: k - k % 2 if k <= 500 else k for k in range(600)}
    few = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    assert {r["vec_id"]: r["group_id"] for r in V.greedy_groups(spark.range(7).withColumnRenamed("id", "vec_id"), few, most=2).collect()} == {k: k - k % 2 for k in range(7)}


def test_folders_need_a_shared_place_on_a_cluster():
    from types import SimpleNamespace

    from textloom.session import own_folder

    with pytest.raises(ValueError):
        own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://h:7077")))


def test_reasons_in_words(spark):
    from textloom.operators import scoring as S

    rows = spark.createDataFrame(
        [(1, "food", 8.0, 0.1, "renewal", True, ["a", "b", "c", "d"]), (2, None, 5.0, 0.745, None, False, []), (3, "food", 5.0, None, None, None, None), (4, "food", 5.0, 0.5, "x", False, None)],
        "n int, industry string, base double, rate double, category string, strict boolean, terms array<string>",
    )
    said = {r["n"]: r["s"] for r in rows.select("n", S.industry_reasoning(*(F.col(c) for c in rows.columns[1:])).alias("s")).collect()}
    assert said == {
        1: "Industry: food. Unusual for food (found in only 10% of baseline) - increased severity. renewal is a high-priority concern for food. "
        "Contains terms alarming for food: a, b, c. Score capped at maximum (10.0).",
        2: "Industry: Unknown industry. Common practice in Unknown industry (found in 75% of baseline) - reduced severity.",
        3: "Industry: food.",
        4: "Industry: food.",
    }
    rows = spark.createDataFrame([("alarming", "fees", "music"), ("neutral", None, "music"), ("unknown_service", "fees", None)], "c string, what string, where string")
    found = [r[0] for r in rows.select(S.service_reason(*(F.col(c) for c in rows.columns))).collect()]
    assert found[0].startswith('Category "fees" is alarming for music services.') and '"unknown" is neither' in found[1] and found[2] == 'Unknown service type "unknown", keeping anomaly for manual review'


def test_match_details(spark):
    from textloom.operators import scoring as S

    matches = spark.createDataFrame([(1, "p", 5, "a,b"), (1, "p", 6, "a"), (1, "q", 5, "c")], "document_id int, pattern string, anomaly_id int, shared string")
    own = spark.createDataFrame([(5, "high", "x" * 400), (6, None, None), (7, "low", "not matched")], "anomaly_id int, severity string, clause_text string")
    found = {(r["pattern"], r["anomaly_id"]): (r["severity"], r["text"]) for r in S.match_details(matches, own).collect()}
    assert found == {("p", 5): ("high", "x" * 150 + "..."), ("p", 6): (None, "..."), ("q", 5): ("high", "x" * 150 + "...")}


def test_trend_advice(spark):
    from textloom.operators import reports as R

    def advice(values):
        weekly = spark.createDataFrame([(k + 1, float(a), float(b)) for k, (a, b) in enumerate(values)], "week int, alerts_per_document double, detections double")
        return R.trend_direction(weekly).first()

    worse = advice([(1, 5), (1, 5), (3, 5), (3, 5)])
    assert worse["overall_trend"] == "DEGRADING" and worse["recommendations"].endswith("Alert volume is increasing. Review alert ranking thresholds.")
    assert advice([(3, 5), (1, 5)])["recommendations"].startswith("Performance is improving.")
    assert advice([(1, 5)])["overall_trend"] == "INSUFFICIENT_DATA" and advice([(1, 5)])["recommendations"] == "Performance is stable. Continue monitoring."


def test_forest_detection_is_the_forest(spark):
    """The statistical method of stage 1 against the forest's own scores by Python."""
    from conftest import SF
    from textloom.operators import features as W
    from textloom.operators import models
    from textloom.plans import stage_plans
    from textloom.session import cut

    own = cut(stage_plans.clauses(spark, SF))
    found = {r["anomaly_id"]: r for r in stage_plans.forest_outliers(own).collect()}
    kept = cut(W.with_features(W.clause_features(own.select("anomaly_id", "clause_text"), "clause_text", **stage_plans.WORDING)).drop("clause_text"))
    forest = models.isolation_forest(kept, list(W.FEATURES), "anomaly_id")
    plain = models.outlier_scores(kept, forest, list(W.FEATURES), "anomaly_id").collect()
    assert len(plain) == len(found) > 0 and any(r["is_outlier"] for r in plain)
    for r in plain:
        assert abs(found[r["anomaly_id"]]["score"] - r["score"]) < 1e-9
        assert found[r["anomaly_id"]]["is_outlier"] == r["is_outlier"]
    # a clause goes on for its outlier alone
    stage = {r["anomaly_id"]: r for r in stage_plans.h1_forest(spark, SF).collect()}
    assert set(found) <= set(stage)  # clauses without features are no outliers
    odd = {k for k, r in found.items() if r["is_outlier"]}
    assert {k for k, r in stage.items() if r["outlier_flag"]} == odd and all(stage[k]["proceed"] for k in odd)


def test_words_and_syllables_of_many_texts_at_once(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "e", "The table are Queue rhythm tree, the-e\u00e9a 1bE", "a" * 40] + ["".join(rng.choice("aeiouyEbcT .-\u00e9\U0001f600\n1") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").coalesce(1)
    own = X.words("text")
    expected = {r["n"]: tuple(r)[1:] for r in rows.select("n", F.size(own), F.aggregate(own, F.lit(0), lambda a, w: a + X.syllables(w))).collect()}
    got = rows.select("n", X.word_measures(F.col("text")).alias("m"))
    assert {r["n"]: tuple(r["m"]) if r["m"] else None for r in got.collect()} == {n: v if texts[n] is not None else None for n, v in expected.items()}
    plan = X.readability(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no list of all words, no regular expression for each


def test_outliers_shuffle_nothing(spark):
    """The greatest standard score of a row was found by nine rows and a shuffle for each."""
    from textloom.plans import stage_plans

    own = spark.createDataFrame([(k, "Some words of a clause. " * (1 + k % 5 + 90 * (k == 7))) for k in range(60)], "anomaly_id long, clause_text string")
    found = stage_plans.outliers(own)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["anomaly_id"] for r in found.filter("is_outlier").collect()] == [7]


def test_refits_of_one_buffer_pass_through_no_single_task(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(500), k, rng.choice(["helpful", "dismissed"]), rng.random(), rng.random() < 0.6) for k in range(1000)]
    own = spark.createDataFrame(rows, "day int, n int, user_action string, confidence double, was_correct boolean").repartition(5).withColumn("all", F.lit(0))
    held = models.numbered(own, ["day", "n"])
    assert [r["n"] for r in held.orderBy("_place").collect()] == [r[1] for r in sorted(rows)] and {r["_place"] for r in held.collect()} == set(range(1000))
    found = models.refits(held, ["day", "n"], "all", 30, place="_place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, models.refits(own, ["day", "n"], "all", 30).collect())) and found.count() == 34
    assert not models.refits(models.numbered(own.limit(0), ["n"]), ["n"], "all", 30, place="_place").collect()
