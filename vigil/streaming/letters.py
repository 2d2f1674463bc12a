"""Dead-letter table of an event-line stream (P1, K3): good, rejected and late lines, told apart in one pass.

A micro-batch is parsed once and written once, in folders by fate below its batch id: the good readings, and the dead letters
(rejected lines with their reason, and lines whose interval was over).  Writing a batch id again replaces it, so a batch
that is replayed after a failure leaves the same rows.  How far the stream's time had come is carried from batch to
batch: a line is late if its interval ended at or before the largest time of earlier batches less the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions import events as fe
from vigil.operators.events import parse_event_lines

GOOD, REJECTED, LATE = "good", "rejected", "late"


def start_line_sorting(lines: DataFrame, n_sensors: int, seconds: float, delay_seconds: float, out_dir: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Sort the lines of a stream by fate below ``out_dir``; ``trigger`` as for ``DataStreamWriter.trigger`` (default: what is there).
    End-of-stream records are left out.  Observed metrics per micro-batch: ``lines`` and ``rejected``."""
    spark, out, root = lines.sparkSession, out_dir.rstrip("/"), checkpoint.rstrip("/")
    length, delay = int(round(seconds * 1_000_000)), int(round(delay_seconds * 1_000_000))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        reached = None if batch_id == 0 else spark.read.schema("reached BIGINT").parquet(f"{root}/reached/b={batch_id - 1}").first()["reached"]
        at = F.unix_micros("ts")
        end = at - F.pmod(at, F.lit(length)) + length
        late = F.lit(False) if reached is None else F.coalesce(end <= reached - delay, F.lit(False))
        fate = F.when(late, LATE).when(F.col("status") != fe.OK, REJECTED).otherwise(GOOD)
        seen = Observation(f"reached_{batch_id}")
        rows = batch.where(F.col("status") != fe.CONTROL).observe(seen, F.max(at).alias("at"))
        rows.select("line", "ts", "sensor", "value", "status", fate.alias("fate")).write.mode("overwrite").partitionBy("fate").parquet(f"{out}/b={batch_id}")
        now = max((x for x in (reached, seen.get["at"]) if x is not None), default=None)
        spark.createDataFrame([(now,)], "reached BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{root}/reached/b={batch_id}")

    parsed = parse_event_lines(lines, n_sensors)
    parsed = parsed.observe("lines", F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("status").isin(fe.OK, fe.CONTROL)).alias("rejected"))
    w = parsed.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{root}/query")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _sorted(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("line STRING, ts TIMESTAMP, sensor INT, value DOUBLE, status STRING, b BIGINT, fate STRING").parquet(out_dir)


def good_readings(spark: SparkSession, out_dir: str) -> DataFrame:
    """``ts, sensor, value`` of the good lines."""
    return _sorted(spark, out_dir).where(F.col("fate") == GOOD).select("ts", "sensor", "value")


def dead_letters(spark: SparkSession, out_dir: str) -> DataFrame:
    """``line, reason, batch_id``: the reason is the parse status, or ``late``."""
    dead = _sorted(spark, out_dir).where(F.col("fate") != GOOD)
    return dead.select("line", F.when(F.col("fate") == LATE, LATE).otherwise(F.col("status")).alias("reason"), F.col("b").alias("batch_id"))
