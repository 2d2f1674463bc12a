"""Exact positions by sketch brackets against a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import quantiles as q


def ordered(values):
    rest = sorted(v for v in values if v is not None and not math.isnan(v))
    return [None] * sum(v is None for v in values) + rest + [math.nan] * sum(v is not None and math.isnan(v) for v in values)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def check(spark, values, positions, **options):
    df = spark.createDataFrame([(v, 1) for v in values], "score double, k int").repartition(5)
    got = sorted((r["k"], r["position"], r["value"]) for r in q.values_at(df, "score", lambda n: positions, **options).collect())
    want = ordered(values)
    assert [(k, p) for k, p, _ in got] == list(enumerate(positions, 1))
    assert all(same(v, want[p]) for _, p, v in got)


R = random.Random(7)
CASES = {
    "spread": [R.gauss(0, 1) for _ in range(5000)],
    "ties": [R.choice([1.0, 2.0, 3.0, -1.0]) for _ in range(4000)] + [0.5] * 3000,
    "one value": [3.0] * 1000,
    "odd": [None] * 40 + [math.nan] * 60 + [math.inf, -math.inf, 0.0, -0.0] * 20 + [R.random() for _ in range(500)],
    "few": [2.0, 1.0, None],
    "no number": [None, math.nan, None],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [8, q.SKETCH_SIZE])  # a coarse sketch has to widen its brackets
def test_equals_sort(spark, name, size):
    values = CASES[name]
    n = len(values)
    check(spark, values, sorted({0, n - 1, n // 2, *(k * n // 20 for k in range(20))}), size=size)


def test_wrong_brackets_are_widened(spark, monkeypatch):
    """With brackets of no width most positions miss them at first."""
    monkeypatch.setattr(q, "_rank_error", lambda size: 1e-4)
    check(spark, CASES["spread"], [k * 250 for k in range(20)], size=8)


def test_positions_beyond_the_table(spark):
    with pytest.raises(ValueError):
        q.values_at(spark.createDataFrame([(1.0,)], "score double"), "score", lambda n: [n])
    assert q.values_at(spark.createDataFrame([(1.0,)], "score double"), "score", lambda n: []).count() == 0


def test_little_is_listed(spark):
    """Of a large table only the brackets' insides are told apart by value."""
    df = spark.range(0, 400_000, 1, 8).select(F.hash("id").cast("double").alias("v"))
    n, _, _, sketch = q._profile(df, "v", q.SKETCH_SIZE)
    error = q._rank_error(q.SKETCH_SIZE)
    low, high = (q._sketch_values(spark, sketch, [k / 10 + s * error for k in range(1, 10)]) for s in (-1, 1))
    edges = sorted({*low, *high})
    inside = {2 * i for i in range(1, len(edges), 2)}
    assert q._cells(df, "v", edges, inside).count() < n / 20
