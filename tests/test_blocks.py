"""Block model: a table of weights, equal to the list form; wide models; a hot block."""

import random

from pyspark.sql import functions as F

from vigil.operators.blocks import BlockModel
from vigil.operators.intervals import LinearModel, score_intervals
from vigil.session import scratch_dir

EVENTS = "ts timestamp, sensor int, value double, seq long, interval_id long"


def stored_model(spark, weights, intercept, size, parts=4):
    path = scratch_dir(spark, "blocks")
    BlockModel.write(spark.createDataFrame(weights, "sensor long, weight double"), path, size)
    return BlockModel.read(spark, path, intercept, parts)


def rows(df):
    return sorted((r["interval_id"], r["interval_no"], r["n_events"], round(r["margin"], 6), r["status"]) for r in df.collect())


def test_equals_list_form(spark):
    r = random.Random(2)
    n = 50
    weights = [r.uniform(-1, 1) for _ in range(n)]
    events = [(r.randrange(0, 9), r.choice([1, 1, 1, r.randrange(1, n + 1)]), r.uniform(0, 100), i) for i in range(600)]  # sensor 1 is hot
    ev = spark.createDataFrame(events, "interval_id long, sensor int, value double, seq long").withColumn("ts", F.timestamp_seconds(F.col("interval_id") * 60 + 1))
    want = rows(score_intervals(ev, LinearModel(weights, -3.0), 5.0))
    for size in (1, 7, 1024):
        model = stored_model(spark, [(i + 1, w) for i, w in enumerate(weights)], -3.0, size)
        assert rows(score_intervals(ev, model, 5.0)) == want


def test_absent_sensors_weigh_nothing(spark):
    model = stored_model(spark, [(2, 3.0), (9, 1.0)], 1.0, 4)
    assert spark.range(1).select(model.base(2.0)).first()[0] == 1.0 + 2.0 * 4.0
    got = model.attach(spark.createDataFrame([(s, 0) for s in (1, 2, 8, 9, 40)], "sensor int, interval_id long"), "left").collect()
    assert {r["sensor"]: r["weight"] for r in got} == {1: 0.0, 2: 3.0, 8: 0.0, 9: 1.0, 40: 0.0}


def test_a_million_sensors_without_a_list(spark):
    path, n = scratch_dir(spark, "wide"), 1_000_000
    BlockModel.write(spark.range(1, n + 1).select(F.col("id").alias("sensor"), F.lit(2.0).alias("weight")), path)
    model = BlockModel.read(spark, path)
    assert model.table.count() == 977 and model.size == 1024
    ev = spark.range(0, 2000).select(F.timestamp_seconds(F.lit(5)).alias("ts"), (F.col("id") * 500 + 1).cast("int").alias("sensor"), F.lit(1.0).alias("value"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("interval_id"))
    out = score_intervals(ev, model, 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan
    assert out.first()["margin"] == 0.5 * 2.0 * n + 2000 * 2.0 * 0.5
