"""Explicit schemas of the data model (wire lines, parsed events, training rows, images, predictions)."""

from pyspark.sql import types as T

# One wire line per row (text file, socket, Kafka value).
LINE = T.StructType([T.StructField("value", T.StringType())])

# Parsed sensor event.  `seq` breaks ties between readings with the same timestamp
# (Kafka offset, event id or file position).
EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("sensor", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

# Labelled training vector.
TRAINING = T.StructType([
    T.StructField("label", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])

# Parsed image line / record: flat HWC pixels plus the label.
IMAGE = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("pixels", T.ArrayType(T.DoubleType())),
])

# Labelled image table with raw bytes (folder / record sources).
BYTE_IMAGE = T.StructType([
    T.StructField("data", T.BinaryType()),
    T.StructField("image_name", T.StringType()),
    T.StructField("label", T.FloatType()),
])

# Prediction table consumed by the accuracy metrics.
PREDICTION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("predict", T.IntegerType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
])

# Scored interval (batch and stream give the same table).
INTERVAL_SCORE = T.StructType([
    T.StructField("interval_id", T.LongType()),
    T.StructField("interval_no", T.LongType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("margin", T.DoubleType()),
    T.StructField("status", T.StringType()),
])
