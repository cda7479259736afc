"""Queries against their SQL on hand-made tables of odd rows, and comparisons against brute force."""

import duckdb
import numpy as np

from textloom import registry
from textloom.operators import vectors as V
from textloom.plans import stage_plans
from textloom.sources import corpus as C

WORDS = "word " * 120


def same(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    found = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    got = sorted(tuple(map(str, r)) for r in found.select(*expected.columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in expected.fetchall())
    return got


def test_size_above_an_int(spark, tmp_path):
    got = same(spark, tmp_path, "b14_sizes", "documents", [(1, "x" * 60_000), (2, ""), (3, "é" * 46_341), (4, None)], "doc_id long, text string")
    assert got[0][1] == "3 GB"


def test_unicode_spaces_of_pages(spark, tmp_path):
    pages = [WORDS + " ", " " + WORDS, f"　 x {WORDS}\r\n\r\n y \r", f"a\n   \nb{WORDS}", f"a     b{WORDS}", f"<ſCRIPT>z</ſcript>{WORDS}", f"\t{WORDS}\t", None]
    assert len(same(spark, tmp_path, "a03_page_text", "pages", [(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")) == 7


def test_files_without_a_byte(spark, tmp_path):
    pages = [WORDS, None, "", "<nav>x</nav>", "<p></p>", "a  \n", "b"]
    got = same(spark, tmp_path, "a01_a02_corpus_files", "pages", [(3 * k, f"u{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert len(got) == 7


def test_names_of_corpus_files(spark, tmp_path):
    names = ["a b.txt", "a+b.txt", "50%.txt", "é.txt"]
    (tmp_path / "c 0").mkdir()
    for k, name in enumerate(names):
        (tmp_path / "c 0" / name).write_text("x" * (k % 2))
    assert sorted((r["file_name"], r["text"]) for r in C.read_corpus(spark, f"file://{tmp_path}").collect()) == sorted((n, "x" * (k % 2)) for k, n in enumerate(names))


def test_one_pass_over_blocks(spark):
    """The groups of one pass, whatever the blocks, with chains, copies, zeros and ids of any order."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 3)).round(1)
    x[50:60], x[60:70], x[5] = 0, x[70:80], x[6]
    keys = rng.permutation(4_000)[:400]
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)], "vec_id long, embedding array<double>").repartition(5)
    starts, expected = [], {}
    for k in np.argsort(keys):
        near = [s for s in starts if x[k].any() and round(x[k] @ x[s] / np.sqrt((x[k] @ x[k]) * (x[s] @ x[s])), 9) >= 0.95]
        expected[int(keys[k])] = int(keys[near[0] if near else k])
        starts += [] if near or not x[k].any() else [k]
    assert 3 < len(set(expected.values())) < 390
    for block in (7, 100, 1_000):
        assert {r["vec_id"]: r["group_id"] for r in V.greedy_similar(rows, 0.95, block=block).collect()} == expected


def test_heads_tell_no_pair_apart():
    """Pairs found by heads are those of all cosines, for vectors near a few directions, isotropic ones and at the threshold."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 64))
    for noise in (0.2, 0.5, 5.0):
        x = centres[rng.integers(0, 9, 3_000)] + noise * rng.standard_normal((3_000, 64))
        x[100:200] = 3 * x[:100]
        unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
        for threshold in (0.95, 0.55):
            ready = V._ready(x, V._directions(x[::3], threshold))
            found = np.zeros((3_000, 3_000), bool)
            for i, j in V._near(ready, ready, threshold):
                assert not found[i, j].any()
                found[i, j] = True
            assert (found == (np.round(unit @ unit.T, 9) >= threshold)).all()


def test_parts_tell_no_pair_apart():
    """Rows held only against the parts that they may be near find the pairs of all cosines, copies and vectors at the threshold included; isotropic vectors have no parts."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    for noise, threshold in ((0.05, 0.95), (0.3, 0.95), (0.3, 0.9), (50.0, 0.55)):
        x = centres[rng.integers(0, 40, 5_000)] + noise * rng.standard_normal((5_000, 64))
        x[100:400] = 3 * x[:300]
        ready = V._ready(x, V._directions(x[::5], threshold))
        block = V._indexed(ready, threshold, V._pivots(x))
        assert (len(block) == 2) == (noise == 50.0)
        found = np.zeros((5_000, 5_000), bool)
        for i, j in V._near(ready, block, threshold):
            assert not found[i, j].any()
            found[i, j] = True
        assert (found == (np.round(ready[0] @ ready[0].T, 9) >= threshold)).all()
        if noise < 1:
            assert V._beside(ready[0].astype(np.float32), *block[2:4]).mean() < 0.3  # of the parts


def test_one_pass_over_parts():
    """The starts of one pass where blocks have parts."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 9_000)] + 0.15 * rng.standard_normal((9_000, 16))
    ready = V._ready(x, V._directions(x[::9], 0.95))
    starts, expected = [], []
    for n, v in enumerate(ready[0]):
        near = np.flatnonzero(np.round(ready[0][starts] @ v, 9) >= 0.95)
        expected.append(starts[near[0]] if len(near) else n)
        starts += [] if len(near) else [n]
    assert (V._in_order(np.arange(9_000) + 7, ready, 0.95, V._pivots(x)) == np.array(expected) + 7).all()


def test_vectors_are_dealt_to_many_tasks(spark):
    """A few vectors, which Spark leaves to one task, are held against all by several; copies share the smallest id, zeros and rows of one id stay."""
    rows = spark.createDataFrame([(k, [float(k % 90), 1.0, float(k // 300)]) for k in range(600)], "k long, v array<double>").coalesce(1)
    single, members = V._alike(rows)
    assert single.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    first = {}
    expected = sorted((k, first.setdefault((k % 90, k // 300), k)) for k in range(600))
    assert sorted(map(tuple, members.collect())) == expected and single.count() == 180
    odd = spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 0.0]), (3, None), (9, [1.0, 0.0])], "vec_id int, embedding array<double>")
    found = V.greedy_similar(odd)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (2, 2, 4), (2, 2, 4), (3, 3, 1), (4, 2, 4), (9, 2, 4)] and found.dtypes[0] == ("vec_id", "int")


def test_top_k_against_all(spark):
    """The best of each query by score, then id, with copies, zeros and columns that must agree, whatever the blocks."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3_000, 8))
    x[1_000:1_200], x[5], x[1_500:2_900] = x[0], 0, x[1_500] + 0.01 * x[1_500:2_900]
    unit = np.divide(x, np.sqrt((x**2).sum(1, keepdims=True)), out=np.zeros_like(x), where=x.any(1, keepdims=True))
    base = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, g long, embedding array<double>").repartition(2)
    queries = base.filter("vec_id % 20 = 0 OR vec_id = 5").withColumnRenamed("vec_id", "query_id")
    score = np.round(unit @ unit.T, 9)
    for equal, block in (((), 2_000), (("g",), 60)):
        found = {(r["query_id"], r["place"]): (r["vec_id"], r["score"]) for r in V.top_k(queries, base, 4, equal=equal, block=block).collect()}
        for q in [*range(0, 3_000, 20), 5]:
            some = [k for k in range(3_000) if not equal or k % 3 == q % 3]
            best = sorted(some, key=lambda k: (-score[q, k], k))[:4]
            assert [found[q, p + 1] for p in range(4)] == [(k, score[q, k]) for k in best]


def test_top_k_after_a_first_pass(spark, monkeypatch):
    """A first pass over a share of the rows moves no neighbour: with copies, zeros, columns that must agree and queries of too few rows."""
    monkeypatch.setattr(V, "MANY_ROWS", 100)
    monkeypatch.setattr(V, "PROBE", 5)
    monkeypatch.setattr(V, "AT_ONCE", 1_000)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((60, 6)), 20, axis=0) + 0.2 * rng.standard_normal((1_200, 6))
    x[300:340], x[7] = x[0], 0
    unit = np.divide(x, np.sqrt((x**2).sum(1, keepdims=True)), out=np.zeros_like(x), where=x.any(1, keepdims=True))
    score = np.round(unit @ unit.T, 9)
    base = spark.createDataFrame([(k, min(k % 50, 40), v.tolist()) for k, v in enumerate(x)], "vec_id long, g long, embedding array<double>").repartition(3)
    queries = base.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    for equal, block, many in (((), 2_000, 5), (("g",), 60, 30)):
        found = {(r["query_id"], r["place"]): (r["vec_id"], r["score"]) for r in V.top_k(queries, base, many, equal=equal, block=block).collect()}
        expected = {}
        for q in range(0, 1_200, 7):
            some = [k for k in range(1_200) if not equal or min(k % 50, 40) == min(q % 50, 40)]
            expected |= {(q, p + 1): (k, score[q, k]) for p, k in enumerate(sorted(some, key=lambda k: (-score[q, k], k))[:many])}
        assert found == expected


def test_forest_detection_of_whole_texts(spark, tmp_path, monkeypatch):
    """Each paragraph of a long text without headers is a clause, also the sixtieth; the other queries keep the fifty of their SQL."""
    monkeypatch.setattr(stage_plans, "forest_outliers", stage_plans.outliers)  # the forest itself takes a minute
    texts = ["\n\n".join(f"paragraph {k} of document {doc} with {WORDS}" for k in range(60)) for doc in range(3)]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate([*texts, "short text"])], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r["anomaly_id"] for r in registry.queries()["h01_f03_forest_detection"](spark, str(tmp_path)).select("anomaly_id").collect()]
    assert sorted(found) == [doc * 10_000_000_000 + k * 100_000 + 1 for doc in range(3) for k in range(1, 61)] + [30_000_100_001]
    assert registry.queries()["h01_clause_detection"](spark, str(tmp_path)).count() == 151
