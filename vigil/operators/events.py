"""Event lines -> typed events, with the reject split and the end-of-stream sentinel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import events as fe


def parse_event_lines(lines: DataFrame, n_sensors: int | None = None, line_col: str = "value") -> DataFrame:
    """P1 + P8: every line with its parsed fields and a ``status`` (ok, control, bad_*).
    Keeps ``seq`` (arrival order) when the source has it."""
    f = fe.event_fields(F.col(line_col))
    keep = [F.col(c) for c in lines.columns if c != line_col]
    out = lines.select(F.col(line_col).alias("line"), *keep, *[v.alias(k) for k, v in f.items()])
    return out.withColumn("status", fe.parse_status(F.col("n_fields"), F.col("ts"), F.col("sensor"),
                                                    F.col("value"), n_sensors))


def valid_events(parsed: DataFrame) -> DataFrame:
    """Data readings only (status ok): ts, sensor, name, value, seq."""
    cols = ["ts", "sensor", "name", "value"] + (["seq"] if "seq" in parsed.columns else [])
    return parsed.where(F.col("status") == fe.OK).select(*cols)


def encode_events(events: DataFrame) -> DataFrame:
    """P5: canonical events -> wire lines (plus seq)."""
    return events.select(fe.encode_event(F.col("ts"), F.col("sensor"), F.col("value")).alias("value"), "seq")
