"""Image sources: fixed-length binary records and labelled image folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.scan import global_index
from vigil.sources.records import record_file

# Fixed value: CIFAR10 binary record = 1 label byte + 3 x 1024 planar bytes (R, G, B).
CIFAR_RECORD = 1 + 3 * 32 * 32

# Largest number of distinct class folders broadcast to the file rows.
MAX_BROADCAST_CLASSES = 1_000_000


def byte_at(data: Column, pos0: Column | int) -> Column:
    """Unsigned value (0..255) of the byte at 0-based ``pos0`` of a BINARY column."""
    p = pos0 if isinstance(pos0, Column) else F.lit(pos0)
    return F.conv(F.hex(F.substring(data, p + 1, 1)), 16, 10).cast("int")


def bytes_to_ints(data: Column, start0: int, length: int) -> Column:
    """Unsigned bytes [start0, start0+length) of a BINARY column as ``ARRAY<INT>``; one hex
    pass over the record, then 2-character slices (JVM-side)."""
    h = F.hex(F.substring(data, start0 + 1, length))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("int"))


def split_records(blobs: DataFrame, content: str, record_len: int) -> DataFrame:
    """Cut a BINARY column into fixed-length records: one output row per record, with its
    0-based number within the blob."""
    n = F.floor(F.length(F.col(content)) / F.lit(record_len)).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rec = blobs.select("*", F.posexplode(ids).alias("record", "_r"))
    return rec.withColumn("data", F.substring(F.col(content), F.col("_r") * record_len + 1, record_len)).drop("_r", content)


def binary_records(spark: SparkSession, path: str, record_len: int = CIFAR_RECORD,
                   splittable: bool = False) -> DataFrame:
    """Fixed-length record files -> one row per record.

    Default: each file is read whole and cut in the JVM (path, record, data); one task per
    file, for sets of many moderate files (a row holds at most 2 GB).  ``splittable=True``
    reads byte ranges of large files in many tasks (``records.record_file``)."""
    if splittable:
        return record_file(spark, path, record_len, label_bytes=0).select("path", "record", F.col("planar").alias("data"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return split_records(files, "content", record_len)


def decode_planar_record(data: Column, h: int = 32, w: int = 32, c: int = 3) -> dict[str, Column]:
    """Label byte + planar channel bytes -> label, planar pixels ``ARRAY<INT>``."""
    return {"label": byte_at(data, 0), "planar": bytes_to_ints(data, 1, h * w * c)}


def labelled_folder(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """S6 + O5 + J2: ``root/<class dir>/<file>`` -> data, image_name, label, where label is the
    1-based rank of the class dir in sorted order.  The ranks are computed on the distinct
    dir names (small), then joined back; broadcast only below a class-count bound."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(root).select("path", "content")
    parts = F.split(F.col("path"), "/")
    files = files.select(F.col("content").alias("data"),
                         F.element_at(parts, -1).alias("image_name"),
                         F.element_at(parts, -2).alias("class_dir"))
    return with_class_rank(files, "class_dir", "label").select("data", "image_name", F.col("label").cast("float"))


def with_class_rank(df: DataFrame, name_col: str, out_col: str = "label") -> DataFrame:
    """O5 + J2: 1-based dense rank of ``name_col`` over its sorted distinct values, joined back.
    The names are distinct, so the dense rank is the exact sorted position + 1 (range sort,
    no single-partition window).  The rank table is broadcast only when the counted number of
    names is under the bound; otherwise it is a shuffle join."""
    names = df.select(name_col).distinct()
    ranked = global_index(names, [name_col], "_idx").select(name_col, (F.col("_idx") + 1).cast("int").alias(out_col))
    if names.count() <= MAX_BROADCAST_CLASSES:
        ranked = F.broadcast(ranked)
    return df.join(ranked, name_col)
