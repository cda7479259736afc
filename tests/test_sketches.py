"""Summaries merged in one and in two steps, against exact figures."""

import random

from pyspark.sql import functions as F

from textloom.operators import sketches

RANKS = {"low": 0.1, "median": 0.5, "high": 0.99}


def held(found, values, distinct):
    assert abs(found["distinct"] - distinct) <= 0.05 * distinct
    for name, rank in RANKS.items():
        n, at = len(values), found[name]
        assert sum(v < at for v in values) / n <= rank + 0.02 and sum(v <= at for v in values) / n >= rank - 0.02


def test_merged_summaries(spark):
    rng = random.Random(4)
    # day 0 holds a third of all rows, day 29 no values
    rows = [(0 if k % 3 == 0 else rng.randrange(29), rng.randrange(9000), rng.choice([rng.gauss(0, 5), 1.0])) for k in range(30_000)]
    rows += [(29, None, None)] * 3 + [(28, 5, 2.5)] * 500
    days = sketches.sketched(spark.createDataFrame(rows, "day int, part long, price double").repartition(7), ["day"], "part", "price")
    weeks = sketches.merged(days, [F.floor(F.col("day") / 7).alias("week")])
    for summary, span in ((days, 1), (weeks, 7)):
        name = summary.columns[0]
        for found in sketches.read_out(summary, RANKS).collect():
            own = [r for r in rows if r[0] // span == found[name]]
            assert found["n"] == len(own)
            values = [r[2] for r in own if r[2] is not None]
            if values:
                held(found, values, len({r[1] for r in own if r[1] is not None}))
            else:
                assert (found["distinct"], found["low"], found["high"]) == (0, None, None)
    total = sketches.read_out(sketches.merged(weeks, []), RANKS).first()
    assert total["n"] == len(rows)
    held(total, [r[2] for r in rows if r[2] is not None], len({r[1] for r in rows if r[1] is not None}))
    assert not sketches.read_out(sketches.merged(days.limit(0), ["day"]), RANKS).collect()
