"""Stored results with a time to live, over restarts."""

import datetime
import random

from textloom.streaming import state

START = datetime.datetime(2024, 1, 1)
SCHEMA = "n long, ts timestamp, body string, score double, days int, hit string"


def plain(rows):
    """The same, row by row."""
    kept, out = {}, {}
    for n, ts, body, score, days, _ in sorted((r for r in rows if r[1] and r[2] is not None and r[0] is not None and r[4] is not None), key=lambda r: (r[1], r[0])):
        if body not in kept or ts >= kept[body][2]:
            kept[body] = (n, score, ts + datetime.timedelta(days=days))
        out[n] = (n != kept[body][0], kept[body][0], kept[body][1])
    return out


def made(seed):
    rng = random.Random(seed)
    rows = [(k, START + datetime.timedelta(hours=rng.randrange(40 * 24)), rng.choice(["a", "b", "", "long " * 5000, f"own {k}"]), rng.choice([None, 0.5, k / 7]), rng.choice([0, 7, 14]), "x") for k in range(200)]
    rows += [(200 + k, START + datetime.timedelta(days=20), "tie", float(k), 7, None) for k in range(4)]
    return rows + [(300, START, None, 1.0, 7, "x"), (301, None, "a", 1.0, 7, "x"), (302, START, "a", 1.0, None, "x"), (None, START, "a", 1.0, 7, "x")]


def test_stored_results_over_restarts(spark, tmp_path):
    rows, path = made(3), f"file://{tmp_path}/in"
    rows.sort(key=lambda r: r[1] or START)
    for part, (a, b) in enumerate([(0, 10), (10, 25), (25, 41)]):
        # a run for each part: the second and third go on with the state of those before
        own = [r for r in rows if (r[1] or START) >= START + datetime.timedelta(days=a) and (r[1] or START) < START + datetime.timedelta(days=b)]
        spark.createDataFrame(own, SCHEMA).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        found = state.reuse_results(stream, f"file://{tmp_path}/out", "n", "ts", "body", "score", "days")
        done = [r for r in rows if (r[1] or START) < START + datetime.timedelta(days=b)]
        assert {r["n"]: (r["hit"], r["source"], r["score"]) for r in found.collect()} == plain(done), part
    got = found.collect()
    assert len(got) == 204 and any(r["hit"] for r in got)
    # the last run's state: no content that had ended before its watermark
    held = spark.read.format("statestore").option("stateVarName", "stored").load(f"file://{tmp_path}/out/progress")
    mark = max(r[1] for r in rows if r[1]) - datetime.timedelta(hours=1)
    ends = [r["value"]["ends"] for r in held.collect()]
    assert ends and min(ends) >= (mark - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6


def test_stored_results_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    assert not state.reuse_results(stream, f"file://{tmp_path}/out", "n", "ts", "body", "score", "days").collect()
