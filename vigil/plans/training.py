"""Registered queries on the training path and on files: vectors as text, model fit and margins, labelled
folders and fixed-length records, each written below the checkpoint folder and read back."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import images as fi
from vigil.functions import vectors as fv
from vigil.operators import models as mo
from vigil.plans.common import EMB_WIDTH, IMAGE_HWC
from vigil.plans.queries import _checksum, _pixels, _vectors, register
from vigil.session import materialize, scratch_dir
from vigil.sinks import write_lines
from vigil.sources.images import binary_records, bytes_to_ints, decode_planar_record, labelled_folder
from vigil.sources.lines import read_lines
from vigil.sources.records import record_file

ROWS_PER_FILE = 10_000  # bounds a file, and with it the row that holds a whole file
GRADIENT_BOUND = 1e-3   # largest entry of the mean gradient at the fitted weights


def _labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as training text (label: weighted score > 0), written and read back."""
    v = _vectors(spark, sf_dir)
    label = fv.threshold_label(fv.weighted_score(F.col("features"), width=EMB_WIDTH), 0.0)
    path = scratch_dir(spark, "train-text")
    write_lines(v, fv.encode_vector(label, F.col("features"), width=EMB_WIDTH), path)
    return read_lines(spark, path)


@register("train_text_roundtrip")
def train_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per training line with its status, label and weighted score."""
    parsed = mo.parse_training_lines(_labelled_lines(spark, sf_dir), EMB_WIDTH)
    return parsed.select("status", "label", F.size("features").alias("n_values"),
                         F.round(fv.weighted_score(F.col("features")), 5).alias("score"))


@register("lr_predict")
def lr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and predictions of a linear model with the coefficients s - 32.5 (s from 1) and intercept 0.25."""
    margin = mo.lr_margin(F.col("features"), [s - 32.5 for s in range(1, EMB_WIDTH + 1)], 0.25)
    return _vectors(spark, sf_dir).select("vec_id", margin.alias("m")).select(
        "vec_id", F.round("m", 6).alias("margin"), (F.col("m") > 0).cast("int").alias("prediction"))


@register("lr_fit")
def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression fitted to the training lines, saved and loaded.  ``converged``: no entry of the
    mean gradient at the loaded weights is above the bound (one aggregate over the rows)."""
    train = materialize(mo.training_frame(_labelled_lines(spark, sf_dir), EMB_WIDTH))  # parsed once for all iterations
    path = scratch_dir(spark, "lr-model")
    mo.save_model(mo.train_lr(train), path)
    loaded = mo.load_model(path)
    scored = train.select("label", vector_to_array("features").alias("x"))
    scored = scored.withColumn("error", 1 / (1 + F.exp(-mo.lr_margin(F.col("x"), loaded.coefficients.toArray(), loaded.intercept))) - F.col("label"))
    pulls = scored.select(array_to_vector(F.transform("x", lambda x: x * F.col("error"))).alias("g"))
    total = pulls.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("g")).alias("g"))
    largest = F.array_max(F.transform(vector_to_array("g"), F.abs))
    return total.select("n", F.lit(loaded.numFeatures).alias("n_coefficients"), (largest < GRADIENT_BOUND).alias("converged"))


@register("labelled_folder_scan")
def labelled_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in one folder per class, several to a file, read back with the class ranks."""
    path = scratch_dir(spark, "classes")
    line = F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join("pixels", " "))
    _pixels(spark, sf_dir).select(line.alias("value"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class")) \
        .write.partitionBy("class").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)
    files = labelled_folder(spark, path)
    lines = files.select("label", F.explode(F.split(F.rtrim(F.col("data").cast("string"), F.lit("\n")), "\n")).alias("line"))
    fields = F.transform(F.split("line", " "), lambda x: x.cast("long"))
    return lines.select("label", fields.alias("f")).select(
        F.get("f", 0).alias("vec_id"), F.col("label").cast("int").alias("label"), _checksum(F.slice("f", 2, EMB_WIDTH)).alias("checksum"))


@register("binary_file_records")
def binary_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length records (label byte, planar bytes, a closing newline) in files, read back."""
    h, w, c = IMAGE_HWC
    path = scratch_dir(spark, "records")
    hexed = F.concat(F.lpad(F.hex(F.col("label")), 2, "0"),
                     F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    _pixels(spark, sf_dir).select(F.unhex(hexed).cast("string").alias("value")) \
        .write.option("maxRecordsPerFile", ROWS_PER_FILE).text(path)
    rec = decode_planar_record(F.col("data"), h, w, c)
    px = binary_records(spark, path, 2 + h * w * c).select(
        rec["label"].alias("label"), fi.planar_to_interleaved(rec["planar"], h, w, c, reverse_channels=False).alias("px"))
    return px.select("label", F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x).alias("pixel_sum"), _checksum(F.col("px")).alias("checksum"))


RANGE_RECORDS = 64  # records in a byte range of the file below


@register("record_file_scan")
def record_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 V13 in splits: all records (label byte, planar bytes, a closing newline) in one file that is read in byte ranges."""
    path = scratch_dir(spark, "record-file")
    hexed = F.concat(F.lpad(F.hex(F.col("label")), 2, "0"), F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    _pixels(spark, sf_dir).select(F.unhex(hexed).cast("string").alias("value")).coalesce(1).write.text(path)  # one file is what is read here
    rec = record_file(spark, path, 2 + EMB_WIDTH, range_bytes=RANGE_RECORDS * (2 + EMB_WIDTH))
    h, w, c = IMAGE_HWC
    px = rec.select("label", fi.planar_to_interleaved(bytes_to_ints(F.col("planar"), 0, EMB_WIDTH), h, w, c, reverse_channels=False).alias("px"))
    return px.select("label", F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x).alias("pixel_sum"), _checksum(F.col("px")).alias("checksum"))
