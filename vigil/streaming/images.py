"""Streaming image classification (T6, D4): image lines -> parse -> normalise -> classify ->
per-micro-batch counts of images and correct predictions (K3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions import images as fi
from vigil.operators.metrics import correct, fitted_model_literals, nearest_mean_scores  # noqa: F401
from vigil.operators.models import transformer_chain
from vigil.operators.scan import global_index, running_totals

OK, BAD_IMAGE = "ok", "bad_image"


def form_a(value: Column) -> dict[str, Column]:
    """P3."""
    return fi.parse_image_a(value)


def form_b(value: Column) -> dict[str, Column]:
    """P4 + V13: 1-based label, size header, signed bytes."""
    p = fi.parse_image_b(value)
    return {"label": (p["label"] - 1).cast("int"), "pixels": fi.unsigned(fi.strip_header(p["bytes"]))}


def classify_lines(lines: DataFrame, classes: list[int], centroids: list[list[float]], form: Callable = form_a,
                   scale: Callable[[Column], Column] | None = None, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """Image lines -> status, label, predict (the same expressions work on a static frame).

    The steps form a D6 transformer chain: parse -> normalise -> score -> argmax.  ``form`` reads a line,
    ``scale`` normalises its pixels (default: the fixed scalar constants) and ``score`` gives a score per class
    (default: the class means; D4: a ``network_udf``).  Other columns of the lines (an arrival key) are kept.  A line without a label or with another number of values,
    or with one that is no number, is a ``bad_image`` without a prediction."""
    width, kept = len(centroids[0]), [c for c in lines.columns if c != "value"]
    scale = scale or (lambda x: fi.normalise(x, fi.CIFAR_MEAN, fi.CIFAR_STD))
    score = score or (lambda x: nearest_mean_scores(x, F.lit(centroids)))

    def parse(df: DataFrame) -> DataFrame:
        p = form(F.col("value"))
        df = df.select(*kept, p["label"].alias("label"), p["pixels"].alias("pixels"))
        fits = F.col("label").isNotNull() & F.col("pixels").isNotNull() & fi.is_shape(F.col("pixels"), width, 1, 1)
        return df.withColumn("status", F.when(fits, OK).otherwise(BAD_IMAGE))

    def scaled(df: DataFrame) -> DataFrame:
        blank = F.array_repeat(F.lit(0.0), width)  # a network takes no null
        return df.select(*kept, "status", "label", F.when(F.col("status") == OK, scale(F.col("pixels"))).otherwise(blank).alias("x"))

    def scored(df: DataFrame) -> DataFrame:
        return df.select(*kept, "status", "label", score(F.col("x")).alias("scores"))

    def predict(df: DataFrame) -> DataFrame:
        best = F.get(F.lit(classes), fi.argmax(F.col("scores")))
        return df.select(*kept, "status", "label", F.when(F.col("status") == OK, best).alias("predict"))

    return transformer_chain(lines, parse, scaled, scored, predict)


def start_image_classification(lines: DataFrame, classes, centroids, out_dir: str, checkpoint: str,
                               available_now: bool = False, processing_time: str | None = None, **steps) -> StreamingQuery:
    """Per micro-batch: one row (batch_id, images, correct, rejected) appended under ``out_dir``.  ``steps``: the
    form, scale and score of ``classify_lines``."""
    pred = classify_lines(lines, classes, centroids, **steps)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        agg = batch.agg(F.count_if(F.col("status") == OK).alias("images"),
                        F.coalesce(F.sum(correct(F.col("label"), F.col("predict"))), F.lit(0)).cast("long").alias("correct"),
                        F.count_if(F.col("status") != OK).alias("rejected"))
        agg.withColumn("batch_id", F.lit(batch_id).cast("long")) \
           .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/b={batch_id}")

    w = pred.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """A10 for the image stream: non-empty intervals, images, correct, rejected lines."""
    b = spark.read.parquet(out_dir)
    return b.agg(F.sum(F.when(F.col("images") > 0, 1).otherwise(0)).cast("long").alias("intervals"),
                 F.sum("images").cast("long").alias("n"), F.sum("correct").cast("long").alias("correct"),
                 F.sum("rejected").cast("long").alias("rejected"))


def interval_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per reporting interval (micro-batch): images received and correctly predicted, with the
    running totals.  One row per micro-batch, so the ordered window runs on a small table."""
    from pyspark.sql import Window

    b = spark.read.parquet(out_dir).where(F.col("images") > 0)
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.select(F.row_number().over(Window.orderBy("batch_id")).alias("interval"), "batch_id", "images",
                    "correct", F.sum("images").over(upto).alias("images_total"),
                    F.sum("correct").over(upto).alias("correct_total"))


def start_count_windows(lines: DataFrame, classes, centroids, every: int, out_dir: str, checkpoint: str, **steps) -> StreamingQuery:
    """A13 on a stream: images and correct predictions of each ``every`` images in arrival order (``partition``, ``seq``).

    The number of images before a micro-batch is carried from batch to batch (one row per batch id, so a replayed
    batch counts on from the same place); a batch writes what it adds to the windows it touches.  Rejected lines take
    no place.  Ends with what the source holds (``availableNow``); a later start goes on."""
    spark, root = lines.sparkSession, checkpoint.rstrip("/")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        before = 0 if batch_id == 0 else spark.read.schema("n BIGINT").parquet(f"{root}/counted/b={batch_id - 1}").first()["n"]
        images = batch.where(F.col("status") == OK).select("partition", "seq", correct(F.col("label"), F.col("predict")).alias("c"))
        placed = global_index(images, ["partition", "seq"])
        per = placed.groupBy(F.expr(f"(idx + {before}) div {int(every)}").alias("report")).agg(F.count(F.lit(1)).alias("images"), F.sum("c").cast("long").alias("correct"))
        seen = Observation(f"images_{batch_id}")
        per.observe(seen, F.coalesce(F.sum("images"), F.lit(0)).alias("n")).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/b={batch_id}")
        spark.createDataFrame([(before + int(seen.get["n"] or 0),)], "n BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{root}/counted/b={batch_id}")

    w = classify_lines(lines, classes, centroids, **steps).writeStream.foreachBatch(per_batch)
    return w.option("checkpointLocation", f"{root}/query").trigger(availableNow=True).start()


def count_window_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """``report_no, images, correct, pct`` so far at the end of each window, as ``metrics.count_window_progress``."""
    per = spark.read.parquet(out_dir).groupBy("report").agg(F.sum("images").alias("images"), F.sum("correct").alias("correct"))
    cum = running_totals(per, "report", ["images", "correct"])
    return cum.select((F.col("report") + 1).alias("report_no"), F.col("images_cum").alias("images"), F.col("correct_cum").alias("correct"),
                      (F.lit(100.0) * F.col("correct_cum") / F.col("images_cum")).alias("pct"))
