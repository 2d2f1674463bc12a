"""Reporting intervals over a sensor event table (batch form of the stream scorer).

Pipeline of the flagship query (``score_intervals``)::

    events(ts, sensor, value, seq)
      -> interval id (T1, event time)
      -> last reading per (interval, sensor)                  A3   shuffle on (interval, sensor),
                                                                   partial aggregation map-side
      -> previous reading of the same sensor (carry-forward)  T2   two-level lag, hot sensors split
      -> weighted change w_s * (v - v_prev), joined to the
         model weights                                        J3   broadcast only below a size bound
      -> sum per interval, running sum over intervals         T3/T8 two-level prefix sum
      -> margin = intercept + neutral * sum(w) + running sum; status K4

A linear model only needs the *changes*: the dense intervals x sensors grid is never built,
so the cost follows the number of readings, not intervals x sensors.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.scan import floor_div, neighbour_value, running_totals

# The two alert texts of the interval report.
ATTENTION = "Attention needed"
ALL_OK = "Everything is OK"

# Largest model (number of weights) that is broadcast to every task; above it the weights
# table is joined with a shuffle.  8 bytes x 4M weights = 32 MB.
BROADCAST_MAX_WEIGHTS = 4_000_000


def interval_id(ts: Column, seconds: float) -> Column:
    """Tumbling event-time interval number (floor(epoch / length)), exact integer math."""
    us = int(round(seconds * 1_000_000))
    return floor_div(F.unix_micros(ts), us)


def utc_instant(df: DataFrame, col: str) -> Column:
    """A TIMESTAMP column; a TIMESTAMP_NTZ wall clock is read as UTC whatever the session zone."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(col)).cast("timestamp")
    return F.col(col)


def events_from_table(events: DataFrame, sensor_offset: int = 1) -> DataFrame:
    """Driver ``events`` table -> canonical events: sensor = user_id + offset, seq = event_id."""
    return events.select(
        utc_instant(events, "ts").alias("ts"),
        (F.col("user_id") + F.lit(sensor_offset)).cast("int").alias("sensor"),
        F.col("value").cast("double").alias("value"),
        F.col("event_id").cast("long").alias("seq"),
    )


def with_interval(events: DataFrame, seconds: float) -> DataFrame:
    return events.withColumn("interval_id", interval_id(F.col("ts"), seconds))


def interval_counts(events_iv: DataFrame) -> DataFrame:
    """A1/A2: readings per non-empty interval."""
    return events_iv.groupBy("interval_id").agg(F.count(F.lit(1)).alias("n_events"))


def order_key(ts: Column, seq: Column) -> Column:
    """One number that orders by event time and then by arrival (a BIGINT); unlike a struct it lets
    the aggregate hash instead of sort."""
    return F.unix_micros(ts).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def last_per_sensor(events_iv: DataFrame) -> DataFrame:
    """A3: the last reading of each sensor in each interval (event time, then seq)."""
    return events_iv.groupBy("interval_id", "sensor").agg(
        F.max_by("value", order_key(F.col("ts"), F.col("seq"))).alias("value"),
        F.count(F.lit(1)).alias("n_readings"),
    )


def validity_ranges(last: DataFrame) -> DataFrame:
    """T2 (state form): each sensor value with the interval range it is current for,
    ``[interval_from, interval_to)``; ``interval_to`` is null while it is still current.
    This compact table is the whole carry-forward state; the dense grid is a range join."""
    out = neighbour_value(last.select("interval_id", "sensor", "value"), "sensor", "interval_id",
                          "interval_id", "interval_to", direction="next")
    return out.select("sensor", F.col("interval_id").alias("interval_from"), "interval_to", "value")


def dyadic_blocks(lo: str, hi: str) -> Column:
    """Array of (level, block): the fewest blocks ``[block << level, (block + 1) << level)`` that make up ``[lo, hi)``
    of two BIGINT columns, two per level at most."""
    first, end = f"-shiftright(-{lo}, l)", f"shiftright({hi}, l)"
    piece = "named_struct('level', l, 'block', {})"
    left = f"if({first} < {end} AND pmod({first}, 2) = 1, {piece.format(first)}, NULL)"
    right = f"if({first} < {end} AND pmod({end}, 2) = 1, {piece.format(f'{end} - 1')}, NULL)"
    return F.expr(f"filter(flatten(transform(sequence(0, length(bin({hi} - {lo})) - 1), l -> array({left}, {right}))), x -> x IS NOT NULL)")


def state_at(ranges: DataFrame, asked: DataFrame, instant: str = "instant", neutral: float | None = None) -> DataFrame:
    """T2 as a readable grid: the state of every sensor at every asked interval.

    ``ranges`` are ``validity_ranges``; ``asked`` has a BIGINT column ``instant`` of interval ids (repeated ones count once,
    null ones are left out).  One row per instant and sensor with a value then: ``instant, sensor, value, since``.
    With ``neutral``, a sensor has that value (``since`` null) before its first reading.

    A range is cut into aligned blocks of powers of two, and an instant lies in one block of each size, so the
    point-in-range join is an equality join on (size, block) that makes no row too many: a long range is a few
    rows, and neither the intervals between nor pairs of instants and ranges that do not meet are built.
    """
    points = asked.select(F.col(instant).cast("long").alias("instant")).where("instant is not null").distinct()
    bounds = points.agg(F.min("instant").alias("lo"), F.max("instant").alias("hi")).first()  # two numbers
    lo, hi = (0, -1) if bounds["lo"] is None else (bounds["lo"], bounds["hi"])
    held = ranges.select("sensor", F.col("interval_from").alias("since"), F.col("interval_from").alias("a"), F.col("interval_to").alias("b"), "value")
    if neutral is not None:
        before = ranges.groupBy("sensor").agg(F.min("interval_from").alias("b"))
        held = held.unionByName(before.select("sensor", F.lit(None).cast("long").alias("since"), F.lit(lo).cast("long").alias("a"), "b", F.lit(float(neutral)).alias("value")))
    held = held.select("sensor", "since", "value", F.greatest("a", F.lit(lo)).alias("a"), F.least(F.coalesce("b", F.lit(hi + 1)), F.lit(hi + 1)).alias("b")).where("a < b")
    blocks = held.select("sensor", "value", "since", F.explode(dyadic_blocks("a", "b")).alias("x")).select("sensor", "value", "since", "x.level", "x.block")
    top = max(1, hi - lo + 1).bit_length() - 1
    points = points.select("instant", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).select("instant", "level", F.expr("shiftright(instant, level)").alias("block"))
    return blocks.join(points, ["level", "block"]).select(F.col("instant").alias(instant), "sensor", "value", "since")


@dataclass(frozen=True)
class LinearModel:
    """Binary linear classifier over sensors 1..n: margin = intercept + sum_s w_s x_s."""

    weights: Sequence[float]
    intercept: float = 0.0

    @property
    def n(self) -> int:
        return len(self.weights)

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("sensor", T.IntegerType(), False),
                               T.StructField("weight", T.DoubleType(), False)])
        rows = pa.table({"sensor": pa.array(range(1, self.n + 1), pa.int32()), "weight": pa.array([float(w) for w in self.weights], pa.float64())})
        return spark.createDataFrame(rows, schema)

    def base(self, neutral: float) -> Column:
        """The margin of the neutral state."""
        return F.lit(float(self.intercept) + float(neutral) * float(sum(self.weights)))

    def attach(self, df: DataFrame, how: str = "inner") -> DataFrame:
        """``df`` with the ``weight`` of its ``sensor``.  The weights table is broadcast only when the model is small enough."""
        w = self.weights_frame(df.sparkSession)
        if self.n <= BROADCAST_MAX_WEIGHTS:
            w = F.broadcast(w)
        return df.join(w, "sensor", how)

    @classmethod
    def from_spark_ml(cls, model) -> "LinearModel":
        """From a fitted ``pyspark.ml.classification.LogisticRegressionModel``."""
        return cls([float(x) for x in model.coefficients.toArray()], float(model.intercept))


def join_weights(df: DataFrame, model) -> DataFrame:
    """Attach w_s of a ``LinearModel`` or a ``blocks.BlockModel``."""
    return model.attach(df)


def status_of(margin: Column) -> Column:
    """K4: predict 1 when the margin is strictly positive (probability > 0.5)."""
    return F.when(margin > 0, F.lit(ATTENTION)).otherwise(F.lit(ALL_OK))


def score_intervals(events_iv: DataFrame, model, neutral: float,
                    counts: DataFrame | None = None) -> DataFrame:
    """T3 + K4: one scored row per non-empty interval, by a ``LinearModel`` or a ``blocks.BlockModel``.

    ``events_iv`` holds valid readings (sensor in 1..n) with ``interval_id``.  ``counts`` may
    supply the per-interval event count when it differs from the valid readings (raw lines,
    where an interval of malformed lines only is still scored on the old state).
    Output: interval_id, interval_no (1-based among non-empty intervals), n_events, margin, status.
    """
    last = last_per_sensor(events_iv)
    prev = neighbour_value(last, "sensor", "interval_id", "value", "prev_value", direction="prev")
    delta = F.col("weight") * (F.col("value") - F.coalesce("prev_value", F.lit(float(neutral))))
    # one aggregate gives both the interval's weighted change and its event count
    per_iv = join_weights(prev, model).groupBy("interval_id").agg(
        F.sum(delta).alias("d"), F.sum("n_readings").alias("n_events"))
    if counts is not None:
        per_iv = counts.join(per_iv.drop("n_events"), "interval_id", "left")
    tab = per_iv.select("interval_id", "n_events", F.coalesce("d", F.lit(0.0)).alias("d"),
                        F.lit(1).cast("long").alias("one"))
    cum = running_totals(tab, "interval_id", ["d", "one"])
    cum = cum.withColumn("margin", model.base(neutral) + F.col("d_cum"))
    margin = F.col("margin")
    return cum.select(
        "interval_id",
        F.col("one_cum").alias("interval_no"),
        "n_events",
        "margin",
        status_of(margin).alias("status"),
    )


def interval_spine(counts: DataFrame, lo: Column | int | None = None, hi: Column | int | None = None, most_empty: int = 50_000_000) -> DataFrame:
    """Every interval between the first and last non-empty one, with ``n_events`` 0 for
    the empty ones.  The spine is ``spark.range`` (distributed), bounded by two scalars.  More than ``most_empty`` empty
    intervals are an error that names the extremes: a single wrong time far from the others is the usual cause."""
    spark = counts.sparkSession
    r = counts.agg(F.min("interval_id").alias("lo"), F.max("interval_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = r["lo"] if lo is None else lo, r["hi"] if hi is None else hi
    if lo is None or hi is None:
        return counts.select("interval_id", "n_events", F.lit(False).alias("empty")).limit(0)
    if int(hi) - int(lo) + 1 - r["n"] > most_empty:
        raise ValueError(f"{int(hi) - int(lo) + 1 - r['n']} empty intervals from {lo} to {hi}, more than {most_empty}")
    spine = spark.range(int(lo), int(hi) + 1).withColumnRenamed("id", "interval_id")
    out = spine.join(counts, "interval_id", "left")
    n = F.coalesce(F.col("n_events"), F.lit(0).cast("long"))
    return out.select("interval_id", n.alias("n_events"), (n == 0).alias("empty"))


def run_summary(events_iv: DataFrame, seconds: float) -> DataFrame:
    """One row of run totals, from one pass over the events.  Throughput counts only the seconds of
    non-empty intervals.  Empty intervals are those between the extremes less those with events, so no
    row per interval of the span is built."""
    per = events_iv.groupBy("interval_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    tot = per.agg(
        F.count(F.lit(1)).alias("n_intervals"),
        (F.max("interval_id") - F.min("interval_id") + 1 - F.count(F.lit(1))).alias("n_empty"),
        F.sum("n").alias("n_events"),
        ((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / F.lit(1e6)).alias("span_seconds"))
    active = F.col("n_intervals") * F.lit(float(seconds))
    return tot.select("n_intervals", "n_empty", "n_events", "span_seconds", active.alias("active_seconds"),
                      (F.col("n_events") / active).alias("events_per_sec"))
