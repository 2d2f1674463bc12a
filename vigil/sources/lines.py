"""Line sources (batch and streaming).  Every source yields one ``value STRING`` column plus
an arrival-order key ``seq`` where the transport has one (Kafka offset, file position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file / folder of text files, one row per line (splittable)."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())


def text_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File-folder line stream (the test transport): each new file is read once."""
    r = spark.readStream.schema(schemas.LINE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.text(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Newline-delimited text from a TCP server (the sender).  Not fault tolerant - use
    Kafka or files in production; kept for parity with the socket senders."""
    return spark.readStream.format("socket").option("host", host).option("port", int(port)).load()


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                 max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S3: Kafka records; the key is dropped, the value is the line, (partition, offset) give
    the arrival order.  Needs the spark-sql-kafka package on the classpath."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", int(max_offsets_per_trigger))
    return r.load().select(F.col("value").cast("string").alias("value"), "partition", "offset",
                           F.col("offset").alias("seq"))
