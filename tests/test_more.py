"""Forests as columns, ranges by bins, pages by key, open JSON, and links within documents."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import models, reports, scoring
from textloom.operators import vectors as V
from textloom.sources import corpus


def test_forest_scores_before_and_after_saving(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(8, 1, (5, 3)), np.full((3, 3), 0.5)])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "n long, a double, b double, c double")
    names = ["a", "b", "c"]
    forest = models.isolation_forest(rows, names, "n", trees=30, sample=64)
    expected = {r["n"]: r["score"] for r in models.outlier_scores(rows, forest, names, "n", sample=64).collect()}
    corpus.save_model({"forest": forest}, f"file://{tmp_path}/v1")
    loaded = corpus.load_model(spark, f"file://{tmp_path}/v1", ["forest"])["forest"]
    scored = models.forest_scores(rows, loaded, names, "n", sample=64)
    assert "Python" not in scored._jdf.queryExecution().toString() and "Arrow" not in scored._jdf.queryExecution().toString()
    got = {r["n"]: r["score"] for r in scored.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    odd = sorted(got, key=got.get)[:5]
    assert set(odd) <= set(range(400, 405)) | set(range(400))
    assert not models.forest_scores(rows.limit(0), loaded, names, "n").collect()


def test_ranges_by_bins(spark):
    rng = random.Random(1)
    values = [(k, rng.uniform(-50, 50)) for k in range(300)] + [(900, None)]
    ranges = [(k, low := rng.uniform(-60, 60), rng.choice([low, low + 3, low + 40, low - 1, None])) for k in range(80)] + [(99, None, 3.0), (98, -1e9, 1e9)]
    rows = spark.createDataFrame(values, "n long, v double")
    table = spark.createDataFrame(ranges, "r long, low double, high double")
    for width in (0.5, 7.0, 1000.0):
        found = scoring.in_ranges(rows, table, "v", "low", "high", width, most_bins=30)
        assert Counter((r["n"], r["r"]) for r in found.collect()) == Counter((n, r) for n, v in values for r, low, high in ranges if v is not None and low is not None and v >= low and (high is None or v <= high))
    only = scoring.in_ranges(rows, table.filter("high IS NOT NULL AND high - low < 50"), "v", "low", "high", 7.0)
    only.collect()
    assert not scoring.in_ranges(rows, table.limit(0), "v", "low", "high", 1.0).collect()


def test_totals_of_ranges_without_their_pairs(spark):
    rng = random.Random(3)
    values = [(k, rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), -0.0])) for k in range(300)] + [(900, None)]
    ranges = [(k, low := float(rng.randrange(-60, 60)), rng.choice([low, low + 3, low + 40, low - 1, None])) for k in range(80)] + [(99, None, 3.0), (98, -1e9, 1e9), (97, 70.0, None)]
    rows = spark.createDataFrame(values, "n long, v double").repartition(3)
    table = spark.createDataFrame(ranges, "r long, low double, high double").repartition(3)
    expected = {r: own for r, low, high in ranges if low is not None and (own := [n for n, v in values if v is not None and v >= low and (high is None or v <= high)])}
    got = scoring.range_totals(rows, table, "v", "low", "high", "r", "n").collect()
    assert sorted(map(tuple, got)) == sorted((r, len(own), min(own), max(own)) for r, own in expected.items())
    assert not scoring.range_totals(rows, table.limit(0), "v", "low", "high", "r", "n").collect()
    assert not scoring.range_totals(rows.limit(0), table, "v", "low", "high", "r", "n").collect()


def test_more_open_ranges_than_a_rule_table_holds(spark):
    rows = spark.range(1000).select(F.col("id").alias("n"), F.col("id").cast("double").alias("v"))
    table = spark.range(12_000).select(F.col("id").alias("r"), (F.col("id") % 1000).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    got = scoring.range_totals(rows, table, "v", "low", "high", "r", "n")
    assert got.count() == 12_000 and not got.filter("rows != 1000 - r % 1000 OR first != r % 1000 OR last != 999").count()


def test_pages_make_the_whole_list(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.randrange(6), rng.choice("ab")) for k in range(57)], "n long, score int, kind string").repartition(4)
    order = [("score", True), ("kind", False), ("n", True)]
    pages, last = [], None
    while page := reports.page_after(rows, order, last, 10).collect():
        pages += page
        last = page[-1].asDict()
    assert [tuple(r) for r in pages] == [tuple(r) for r in sorted(rows.collect(), key=lambda r: (-r["score"], r["kind"], -r["n"]))]


def test_open_json(spark):
    rows = [(1, '{"a": {"b": 3}, "t": ["x", 1, {"y": 2}], "n": null}'), (2, "{broken"), (3, None), (4, '{"a": {"b": "no"}, "t": 5}'), (5, "[1, 2]"), (6, "{}")]
    found = X.open_json(spark.createDataFrame(rows, "n long, raw string"), "raw", {"b": ("$.a.b", "int")}, {"t": "$.t"})
    got = {r["n"]: (r["valid"], r["b"], list(r["t"])) for r in found.collect()}
    assert got == {1: (True, 3, ["x", "1", '{"y":2}']), 2: (False, None, []), 3: (False, None, []), 4: (True, None, []), 5: (True, None, []), 6: (True, None, [])}


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_within_groups(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.standard_normal((12, 6))
    rows = [(k, int(rng.integers(0, 4)), (base[rng.integers(0, 12)] + 0.15 * rng.standard_normal(6)).tolist()) for k in range(150)] + [(200, 1, [0.0] * 6), (201, None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, doc int, embedding array<double>")
    links = V.links_within(frame, "doc", 0.95, tile=tile)
    got = {r["vec_id"]: r["group_id"] for r in V.groups(frame, links).collect()}
    group = {k: k for k, _, _ in rows}
    near = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9) >= 0.95
    pairs = [(a, b) for a, g, x in rows[:150] for b, h, y in rows[:150] if a < b and g == h and near(x, y)]
    while True:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    assert got == group and len(set(got.values())) < 150
    assert frame.select(F.max("vec_id")).first()[0] == 201
