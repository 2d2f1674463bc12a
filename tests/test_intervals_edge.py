import datetime as dt

from vigil.operators import intervals as iv
from vigil.operators import models as om


def test_same_millisecond_is_ordered_by_arrival(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 1000, tzinfo=dt.timezone.utc)
    rows = [(0, t, 1, 1.0, 2**62), (0, t, 1, 2.0, 2**62 + 1), (0, t - dt.timedelta(microseconds=1), 1, 9.0, 2**62 + 5)]
    last = iv.last_per_sensor(spark.createDataFrame(rows, "interval_id long, ts timestamp, sensor int, value double, seq long"))
    assert [(r["value"], r["n_readings"]) for r in last.collect()] == [(2.0, 3)]
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()


def test_fractional_intervals_and_large_numbers(spark):
    from pyspark.sql import functions as F
    from vigil.operators.scan import floor_div
    df = spark.sql("select timestamp_micros(x) ts from values (0L), (1499999L), (1500000L), (-1L) as t(x)")
    assert [r[0] for r in df.select(iv.interval_id(F.col("ts"), 1.5)).collect()] == [0, 0, 1, -1]
    big = 2**60 + 12345
    assert spark.range(1).select(floor_div(F.lit(big), 1000)).first()[0] == big // 1000


def test_training_lines_keep_a_row_each(spark):
    lines = spark.createDataFrame([("1,2,3",), ("0,x,3",), ("1,2",), ("",), (None,), ("0,5,6,7",)], "value string")
    assert {r["status"]: r["n"] for r in om.training_status(lines, 2).collect()} == {"ok": 1, "bad_field": 3, "ragged": 2}
    assert om.training_frame(lines, 2).count() == 1
