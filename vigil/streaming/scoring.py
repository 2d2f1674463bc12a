"""Streaming interval scorer (T1-T5, T7, T8, K3): event lines -> scored event-time intervals.

1. ``keyed.closed_intervals``: keyed state per sensor and a clock; event-time timers send out the readings, line counts and
   empty intervals that the watermark has passed.  The end-of-stream record (sensor < 0) moves the watermark to the far
   future, so it closes every open interval.
2. ``foreachBatch``: weighted change per interval, running sums, status.  Besides the scores a micro-batch
   writes one row of run totals (``IntervalLedger``).  Rewriting a batch id is idempotent, so a replayed batch after a
   failure gives the same rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.events import parse_event_lines
from vigil.operators.intervals import LinearModel, status_of
from vigil.streaming import keyed


def line_status_counts(lines: DataFrame, n_sensors: int) -> DataFrame:
    """Streaming frame of (status, n): the lines seen so far by parse outcome.  Grouped by the few statuses only, so
    the state holds a row for each and no watermark is needed (update or complete mode)."""
    return parse_event_lines(lines, n_sensors).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


class IntervalLedger:
    """``foreachBatch`` function: scores the intervals that were closed in each micro-batch.

    The windows here run over one micro-batch's closed intervals only (bounded by the trigger), so a plain
    ``Window`` is the right tool.  An interval of malformed lines only is scored on the state as it was; an empty one
    gets a row without number, margin and status.  The run totals after a batch are one row in a folder of its
    id; a restarted query reads the row of the batch before.
    """

    TOTALS = "d_cum DOUBLE, n_cum BIGINT, n_empty BIGINT, n_late BIGINT"

    def __init__(self, model: LinearModel, neutral: float, out_dir: str, totals_dir: str):
        self.model, self.neutral = model, float(neutral)
        self.out_dir, self.totals_dir = out_dir.rstrip("/"), totals_dir.rstrip("/")
        self._held: tuple[int, tuple] | None = None  # batch id, totals after that batch

    def _totals(self, spark: SparkSession, batch_id: int) -> tuple:
        if batch_id == 0:
            return 0.0, 0, 0, 0
        if self._held is not None and self._held[0] == batch_id - 1:
            return self._held[1]
        return tuple(spark.read.schema(self.TOTALS).parquet(f"{self.totals_dir}/b={batch_id - 1}").first())  # missing: an error

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        d0, n0, empty0, late0 = self._totals(spark, batch_id)
        kind, n = F.col("kind"), F.col("n")
        late = Observation(f"late_{batch_id}")
        batch = batch.observe(late, F.coalesce(F.sum(F.when(kind == keyed.LATE, F.col("n_lines"))), F.lit(0)).alias("n"))
        change = F.col("weight") * (F.col("value") - F.coalesce("prev", F.lit(self.neutral)))
        per = self.model.attach(batch, "left").where(kind != keyed.LATE).groupBy("interval_id").agg(
            F.coalesce(F.sum(F.when(kind == keyed.READING, change)), F.lit(0.0)).alias("d"),
            F.sum(F.when(kind == keyed.INTERVAL, n)).alias("n_events"), F.sum(F.when(kind == keyed.INTERVAL, F.col("n_lines"))).alias("n_lines"),
            F.sum(F.when(kind == keyed.EMPTY, 1).when(kind == keyed.GAP, n)).alias("n_empty"))
        totals = Observation(f"totals_{batch_id}")
        per = per.observe(totals, F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"), F.count("n_lines").alias("n"), F.coalesce(F.sum("n_empty"), F.lit(0)).alias("empty"))
        upto = Window.orderBy("interval_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        empty = F.col("n_lines").isNull()
        margin = self.model.base(self.neutral) + F.lit(d0) + F.sum("d").over(upto)
        rows = per.select("interval_id", (F.count("n_lines").over(upto) + F.lit(n0)).alias("interval_no"), "n_events", "n_lines", margin.alias("margin"), "n_empty")
        rows = rows.select("interval_id", *[F.when(~empty, F.col(c)).alias(c) for c in ("interval_no", "margin")], F.when(~empty, status_of(F.col("margin"))).alias("status"),
                           *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_lines", "n_empty")])
        rows.write.mode("overwrite").parquet(f"{self.out_dir}/b={batch_id}")
        t = totals.get
        after = (d0 + float(t["d"] or 0.0), n0 + int(t["n"]), empty0 + int(t["empty"] or 0), late0 + int(late.get["n"] or 0))
        spark.createDataFrame([after], self.TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{self.totals_dir}/b={batch_id}")
        self._held = (batch_id, after)


def start_with_state_partitions(writer, spark: SparkSession, state_partitions: int | None) -> StreamingQuery:
    """Start a stateful query with a chosen number of state-store partitions.  Spark fixes the
    number from ``spark.sql.shuffle.partitions`` when the query first starts (and keeps it in
    the checkpoint), so the setting is applied for the start call only."""
    if not state_partitions:
        return writer.start()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(int(state_partitions)))
    try:
        return writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def start_interval_scoring(lines: DataFrame, model: LinearModel, neutral: float, seconds: float,
                           out_dir: str, checkpoint: str, delay: str = "0 seconds",
                           available_now: bool = False, processing_time: str | None = None,
                           state_partitions: int | None = None, longest_gap: int = 10_000) -> StreamingQuery:
    """Start the scorer; results accumulate under ``out_dir`` (one folder per batch id), run totals and
    the query's checkpoint under ``checkpoint``.  ``state_partitions`` sizes the state store (default: the session's
    shuffle partitions); ``longest_gap`` bounds the rows that a jump in time gives."""
    root = checkpoint.rstrip("/")
    closed = keyed.closed_intervals(lines, model.n, seconds, delay, longest_gap)
    w = (closed.writeStream.outputMode("append").foreachBatch(IntervalLedger(model, neutral, out_dir, f"{root}/totals"))
         .option("checkpointLocation", f"{root}/query"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)  # T1 cadence: the reporting interval
    spark = lines.sparkSession
    return keyed.with_store(spark, lambda: start_with_state_partitions(w, spark, state_partitions))


def read_intervals(spark: SparkSession, out_dir: str) -> DataFrame:
    """All reported intervals: ``interval_id, interval_no, margin, status, n_events, n_lines, n_empty`` (the number of
    empty intervals that the row stands for, 0 for one with lines)."""
    return spark.read.parquet(out_dir).drop("b")


def read_scores(spark: SparkSession, out_dir: str) -> DataFrame:
    """The scored intervals."""
    return read_intervals(spark, out_dir).where("n_lines > 0").select("interval_id", "interval_no", "n_events", "n_lines", "margin", "status")


def read_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row: the run totals after the last micro-batch (``n_intervals, n_empty, n_late``)."""
    rows = spark.read.schema(f"{IntervalLedger.TOTALS}, b BIGINT").parquet(f"{checkpoint.rstrip('/')}/totals")
    return rows.groupBy().agg(F.max_by(F.struct("n_cum", "n_empty", "n_late"), "b").alias("t")).select(F.col("t.n_cum").alias("n_intervals"), "t.n_empty", "t.n_late")


def stop_on_sentinel(query: StreamingQuery, poll: float = 0.2, timeout: float | None = None) -> bool:
    """T4: stop once the micro-batch that carried the end-of-stream record has been followed by
    one more completed batch (the batch that emits the intervals the record closed).
    Returns False when it stopped on the timeout instead."""
    eos_batch, t0 = None, time.time()
    while query.isActive:
        for p in query.recentProgress:
            eos = (p.observedMetrics or {}).get("eos")
            if eos_batch is None and eos is not None and eos["eos"]:
                eos_batch = p.batchId
            if eos_batch is not None and p.batchId > eos_batch:
                query.stop()
                return True
        if query.exception():
            raise query.exception()
        if timeout and time.time() - t0 > timeout:
            query.stop()
            return False
        time.sleep(poll)
    return eos_batch is not None


def stop_when_idle(query: StreamingQuery, poll: float = 0.2, timeout: float | None = None) -> int:
    """T5: stop at the first progress report without input rows once data has begun (an empty
    reporting interval).  Idle reports arrive every ``spark.sql.streaming.noDataProgressEventInterval``.
    Returns the number of empty reports seen before data began."""
    started, empty, t0, seen = False, 0, time.time(), None
    while query.isActive:
        p = query.lastProgress
        if p is not None and p.timestamp != seen:
            seen = p.timestamp
            if p.numInputRows > 0:
                started = True
            elif started:
                query.stop()
                break
            else:
                empty += 1
        if query.exception():
            raise query.exception()
        if timeout and time.time() - t0 > timeout:
            query.stop()
            break
        time.sleep(poll)
    return empty
