"""A linear model as a table of blocks of sensors (J3 for wide models).

A row of the table holds the weights of ``size`` sensors that follow one another, so a model of 10**6 sensors is a
thousand rows.  The model stays a table: scores come from a join on the block, and neither the driver nor a plan holds a
list of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1024
#: Parts that the readings of a block are dealt to, so that one block may hold a third of all readings.
PARTS = 16


@dataclass(frozen=True)
class BlockModel:
    """``table``: ``block`` BIGINT, ``weights`` ARRAY<DOUBLE> of sensors ``block * size + 1`` and on; absent sensors weigh 0."""

    table: DataFrame
    intercept: float = 0.0
    size: int = BLOCK
    parts: int = PARTS

    @classmethod
    def write(cls, weights: DataFrame, path: str, size: int = BLOCK) -> None:
        """Write ``sensor`` (from 1 on, distinct), ``weight`` as blocks below ``path``."""
        place = F.pmod(F.col("sensor") - 1, F.lit(size)).cast("int")
        blocks = weights.where("sensor >= 1").groupBy(F.expr(f"cast((sensor - 1) div {int(size)} as bigint)").alias("block")).agg(
            F.map_from_entries(F.collect_list(F.struct(place.alias("at"), F.col("weight").cast("double")))).alias("w"))  # ``size`` entries at most
        dense = F.transform(F.sequence(F.lit(0), F.lit(int(size) - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0)))
        blocks.select("block", dense.alias("weights")).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, intercept: float = 0.0, parts: int = PARTS) -> BlockModel:
        table = spark.read.schema("block bigint, weights array<double>").parquet(path)
        return cls(table, intercept, table.agg(F.max(F.size("weights"))).first()[0] or BLOCK, parts)  # one number

    def base(self, neutral: float) -> Column:
        """The margin of the neutral state, as a scalar subquery."""
        total = self.table.agg(F.coalesce(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)), F.lit(0.0)))
        return F.lit(float(self.intercept)) + F.lit(float(neutral)) * total.scalar()

    def attach(self, df: DataFrame, how: str = "left") -> DataFrame:
        """``df`` with the ``weight`` of its ``sensor``, 0 if the table lacks it (so every row stays, whatever ``how``); the rows of a
        block are dealt to ``parts`` parts and its weights copied to each."""
        block, part = F.expr(f"cast((sensor - 1) div {self.size} as bigint)"), F.pmod(F.xxhash64("sensor", "interval_id"), F.lit(self.parts)).cast("int")
        copies = self.table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        keyed = df.withColumn("block", block).withColumn("_part", part)
        out = keyed.join(copies, ["block", "_part"], "left")
        weight = F.get("weights", F.pmod(F.col("sensor") - 1, F.lit(self.size)).cast("int"))
        return out.withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("block", "_part", "weights")
