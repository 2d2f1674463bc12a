"""Classification and its reports: a nearest-class-mean scorer (the stand-in network),
accuracy, top-k accuracy, class counts, count-window progress and the first-batch sample."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import images as fi
from vigil.operators.scan import floor_div, global_index, running_totals

# Largest class-mean model (classes x width) that a network function may carry to the workers.
MAX_CENTROID_VALUES = 50_000_000


def class_means(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Fit: per-class mean vector.  One row: ``classes ARRAY<INT>`` (sorted) and
    ``centroids ARRAY<ARRAY<DOUBLE>>`` in the same order.  Summarizer keeps one fixed-width
    vector buffer per (task, class)."""
    vec = array_to_vector(F.transform(F.col(features), lambda v: v.cast("double")))
    per = df.groupBy(F.col(label).alias("c")).agg(Summarizer.mean(vec).alias("m"))
    per = per.select("c", vector_to_array("m").alias("m"))
    return per.agg(F.sort_array(F.collect_list(F.struct("c", "m"))).alias("a")).select(
        F.transform("a", lambda r: r["c"]).alias("classes"),
        F.transform("a", lambda r: r["m"]).alias("centroids"))


def nearest_mean_scores(x: Column, centroids: Column, decimals: int | None = None) -> Column:
    """Score of each class = -(squared distance to its mean), rounded if ``decimals`` is given."""
    def dist(c):
        d = F.aggregate(F.zip_with(x, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                        F.lit(0.0), lambda s, v: s + v)
        return d if decimals is None else F.round(d, decimals)
    return F.transform(centroids, lambda c: -dist(c))


def fitted_model_literals(model: DataFrame) -> tuple[list[int], list[list[float]]]:
    """A fitted class-mean model (one row) on the driver, for network functions and streams.  Its
    size is checked in the task that holds it, before it is sent."""
    size = F.aggregate("centroids", F.lit(0).cast("long"), lambda n, c: n + F.size(c))
    large = F.raise_error(F.lit(f"class-mean model of more than {MAX_CENTROID_VALUES} values"))
    r = model.select(F.when(size > MAX_CENTROID_VALUES, large).otherwise(F.struct("classes", "centroids")).alias("m")).first()["m"]
    return list(r["classes"]), [list(c) for c in r["centroids"]]


def predict_nearest_mean(df: DataFrame, model: DataFrame, features: str = "features",
                         decimals: int | None = None) -> DataFrame:
    """D3 in JVM form: add ``scores``, ``predict`` (the class label of the best score) and ``classes`` (the
    label of each score).  The fitted model is a scalar subquery: it does not pass through the driver's program."""
    out = df.withColumn("_model", model.select(F.struct("classes", "centroids")).scalar())
    out = out.withColumn("scores", nearest_mean_scores(F.col(features), F.col("_model.centroids"), decimals))
    out = out.withColumn("classes", F.col("_model.classes")).drop("_model")
    return out.withColumn("predict", F.get(F.col("classes"), fi.argmax(F.col("scores"))))


def nearest_mean_predict_fn(centroids, decimals: int | None = None):
    """A ``make_predict_fn`` for ``models.network_udf``: the class-mean model as a numpy
    network (one batch of rows -> one batch of class scores), the same scores as
    ``nearest_mean_scores``.  The centroids travel in the closure (bounded: classes x width)."""
    import numpy as np

    c = np.asarray(centroids, dtype=np.float64)

    def make():
        def predict(x):
            d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=-1)
            return -(d if decimals is None else np.round(d, decimals))
        return predict
    return make


def correct(label: Column, predict: Column) -> Column:
    """``(label == predict)`` as 0/1."""
    return (label == predict).cast("int")


def accuracy(pred: DataFrame, label: str = "label", predict: str = "predict") -> DataFrame:
    """A4 + A5: n, correct, pct."""
    c = correct(F.col(label), F.col(predict))
    return pred.agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("correct")).select(
        "n", "correct", (F.lit(100.0) * F.col("correct") / F.col("n")).alias("pct"))


def topk_accuracy(pred: DataFrame, classes: Column, ks=(1, 5), label: str = "label",
                  scores: str = "scores") -> DataFrame:
    """A6 + O3: share of rows whose true class is among the k best scores, in percent.
    The true class's rank is counted in place (no per-row sort needed for the check)."""
    pred = pred.withColumn("_cls", (F.array_position(classes, F.col(label)) - 1).cast("int"))
    rank = F.when(F.col("_cls") >= 0, fi.rank_of(F.col(scores), F.col("_cls")))
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        aggs.append((F.lit(100.0) * F.avg(F.coalesce((rank <= k).cast("int"), F.lit(0)))).alias(f"acc{k}"))
    return pred.agg(*aggs)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class plus the number of distinct classes (a window over the small
    per-class table)."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n_classes = per.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("n_classes", n_classes)


def count_window_progress(pred: DataFrame, order_col: str, every: int,
                          label: str = "label", predict: str = "predict") -> DataFrame:
    """Cumulative images and correct predictions reported every ``every`` images in
    ``order_col`` order.  Exact global positions come from a range sort (``global_index``),
    the running sums from the two-level scan - no single-partition window over the rows."""
    idx = global_index(pred.select(order_col, label, predict), [order_col])
    grp = idx.select(floor_div(F.col("idx"), every).alias("report"),
                     correct(F.col(label), F.col(predict)).alias("c"))
    per = grp.groupBy("report").agg(F.count(F.lit(1)).alias("images"), F.sum("c").cast("long").alias("correct"))
    cum = running_totals(per, "report", ["images", "correct"])
    return cum.select(
        (F.col("report") + 1).alias("report_no"),
        F.col("images_cum").alias("images"),
        F.col("correct_cum").alias("correct"),
        (F.lit(100.0) * F.col("correct_cum") / F.col("images_cum")).alias("pct"),
    )


def first_batch(df: DataFrame, order_col: str, batch_size: int) -> DataFrame:
    """The first ``batch_size`` rows in ``order_col`` order; an error if there are fewer."""
    head = df.orderBy(order_col).limit(batch_size)
    n = head.count()
    if n < batch_size:
        raise ValueError(f"first batch needs {batch_size} rows, the set has {n}")
    return head
