"""Shared pieces of the registered queries: table loading and the fixed query parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.intervals import LinearModel

# Fixed query parameters (shared by the Spark queries and the oracle SQL).
DAY = 86_400          # interval of the flagship query (s)
HOUR = 3_600          # interval of the count / spine queries (s)
NEUTRAL = 50.0        # state of a sensor before its first reading (the events' value scale)
ATTENTION_OFFSET = 1.0  # the stand-in model flags an interval when the weighted mean reading > NEUTRAL + 1
IMAGE_HWC = (4, 4, 4)   # embeddings read as 4x4x4 images (channel stats, layout)
CROP_HW = (8, 8)        # embeddings read as 8x8x1 images (centre crop 6x6)
CROP_OUT = (6, 6)
PROGRESS_EVERY = 100    # count-window size of the progress report
REPLICAS = 5            # U1 replication factor
TOPK = 5
FIRST_BATCH = 256     # O4 sample size
EMB_WIDTH = 64       # values per embeddings row
GEN_SENSORS = 10     # sensors per generated training vector (one vector per lineitem row)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_sensors(events: DataFrame) -> int:
    """Number of sensors of the driver events table (user ids are dense from 0)."""
    return int(events.agg(F.max("user_id")).first()[0]) + 1


def stand_in_intercept(n: int, neutral: float = NEUTRAL, offset: float = ATTENTION_OFFSET) -> float:
    """-(neutral + offset) * (1 + 2 + ... + n)."""
    return -(neutral + offset) * (n * (n + 1) / 2)


def stand_in_model(n: int, neutral: float = NEUTRAL, offset: float = ATTENTION_OFFSET) -> LinearModel:
    """A fixed linear model over sensors 1..n: w_s = s, intercept = -(neutral + offset) * sum(w).
    margin > 0  <=>  the s-weighted mean of the current readings exceeds neutral + offset."""
    return LinearModel([float(s) for s in range(1, n + 1)], stand_in_intercept(n, neutral, offset))
