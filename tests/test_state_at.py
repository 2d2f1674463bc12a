"""Point-in-range join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators.intervals import dyadic_blocks, state_at, validity_ranges

SCHEMA = "sensor int, interval_from long, interval_to long, value double"


def test_blocks_cover_each_range_once(spark):
    r = random.Random(1)
    rows = [(a, a + r.choice([1, 2, 3, 7, 8, 100, 1023, 1024])) for a in (r.randrange(-2000, 2000) for _ in range(300))] + [(0, 1 << 40), (-(1 << 40), 5), (-7, 9), (3, 4)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", dyadic_blocks("a", "b").alias("x")).collect()
    for row in got:
        parts = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in row["x"])
        assert parts[0][0] == row["a"] and parts[-1][1] == row["b"]
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        levels = [x["level"] for x in row["x"]]
        assert max(map(levels.count, levels)) <= 2


@pytest.mark.parametrize("seed,neutral", [(1, None), (2, 5.0), (3, 5.0)])
def test_state_equals_brute_force(spark, seed, neutral):
    r = random.Random(seed)
    last = {(r.randrange(-300, 300), r.randrange(1, 9)): r.random() for _ in range(250)}
    df = spark.createDataFrame([(i, s, v) for (i, s), v in last.items()], "interval_id long, sensor int, value double")
    asked = [r.randrange(-400, 400) for _ in range(60)] + [None, 299, 299, -300]
    got = state_at(validity_ranges(df), spark.createDataFrame([(x, 1) for x in asked], "t long, sensor int"), "t", neutral)
    want = set()
    for t in {x for x in asked if x is not None}:
        for s in {s for _, s in last}:
            ids = [i for i, x in last if x == s and i <= t]
            if ids:
                want.add((t, s, last[max(ids), s], max(ids)))
            elif neutral is not None:
                want.add((t, s, neutral, None))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_no_pairs_beyond_the_result(spark):
    """Dense short ranges of many sensors and few instants: the join makes the result's rows, by equality."""
    ranges = spark.range(0, 20_000).select((F.col("id") % 100).cast("int").alias("sensor"), F.expr("id div 100").alias("interval_from"), F.expr("id div 100 + 1").alias("interval_to"), F.lit(1.0).alias("value"))
    out = state_at(ranges, spark.createDataFrame([(0,), (100,), (199,)], "instant long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 300


def test_empty_inputs(spark):
    ranges, asked = spark.createDataFrame([(1, 0, None, 2.0)], SCHEMA), spark.createDataFrame([(3,)], "instant long")
    assert state_at(ranges.limit(0), asked, neutral=1.0).collect() == [] and state_at(ranges, asked.limit(0), neutral=1.0).collect() == []
    assert [tuple(r) for r in state_at(ranges, asked).collect()] == [(3, 1, 2.0, 0)]
