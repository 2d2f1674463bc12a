"""Writers: text lines, models, stream outputs, Kafka publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "overwrite") -> None:
    """K1: one text part file per partition, one line per row."""
    df.select(line.alias("value")).write.mode(mode).text(path)


def kafka_publish(df: DataFrame, line: Column, servers: str, topic: str) -> None:
    """K5: publish lines to a Kafka topic (batch write; needs the spark-sql-kafka package)."""
    (df.select(line.cast("string").alias("value"))
       .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def kafka_publish_stream(df: DataFrame, line: Column, servers: str, topic: str, checkpoint: str):
    """K5 for a streaming frame."""
    return (df.select(line.cast("string").alias("value")).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
