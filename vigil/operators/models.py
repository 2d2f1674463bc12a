"""Models: train / save / load the sensor logistic regression (pyspark.ml), predict with it,
and run a user-supplied network over image arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import vectors as fv


OK, BAD_FIELD, RAGGED = "ok", "bad_field", "ragged"


def parse_training_lines(lines: DataFrame, width: int, line_col: str = "value") -> DataFrame:
    """S1 + P2: text lines ``label,v1..vn`` -> ``status``, ``label`` DOUBLE, ``features`` ARRAY<DOUBLE>.
    Every line keeps a row: ``bad_field`` if a field is not numeric (or the line is null), ``ragged`` if it
    does not hold ``width`` values, else ``ok``."""
    arr = fv.parse_training_array(F.coalesce(F.col(line_col), F.lit("")))
    parsed = lines.select(fv.training_label(arr).alias("label"), fv.training_features(arr).alias("features"))
    bad = F.col("label").isNull() | F.exists("features", lambda x: x.isNull())
    status = F.when(bad, BAD_FIELD).when(F.size("features") != width, RAGGED).otherwise(OK)
    return parsed.select(status.alias("status"), "label", "features")


def training_status(lines: DataFrame, width: int, line_col: str = "value") -> DataFrame:
    """Lines by status: what ``training_frame`` takes and what it leaves out."""
    return parse_training_lines(lines, width, line_col).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def training_frame(lines: DataFrame, width: int, line_col: str = "value") -> DataFrame:
    """The ``ok`` lines as label DOUBLE, features VECTOR; ``training_status`` counts the others."""
    ok = parse_training_lines(lines, width, line_col).where(F.col("status") == OK)
    return ok.select("label", array_to_vector("features").alias("features"))


def train_lr(train: DataFrame, fit_intercept: bool = False, max_iter: int = 100, reg: float = 0.0,
             tol: float = 1e-6) -> LogisticRegressionModel:
    """Binary logistic regression, L-BFGS.  Defaults keep the original trainer's:
    no intercept, no regularisation, 100 iterations, tolerance 1e-6, features scaled inside
    the optimiser (the optimum is unchanged without regularisation).  The data is cached for
    the iterations (each L-BFGS step is one distributed treeAggregate)."""
    cached = train.select("label", "features").cache()
    try:
        lr = LogisticRegression(maxIter=max_iter, regParam=reg, tol=tol, fitIntercept=fit_intercept,
                                standardization=True, family="binomial")
        return lr.fit(cached)
    finally:
        cached.unpersist()


def save_model(model: LogisticRegressionModel, path: str) -> None:
    """K2."""
    model.write().overwrite().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    """S7."""
    return LogisticRegressionModel.load(path)


def predict_lr(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (0/1, margin > 0) and ``probability``."""
    return model.transform(df)


def lr_margin(features: Column, coefficients, intercept: float = 0.0) -> Column:
    """D2 in SQL form on an ``ARRAY<DOUBLE>``: intercept + sum_i w_i x_i (no Python)."""
    w = F.array(*[F.lit(float(v)) for v in coefficients])
    return F.lit(float(intercept)) + F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0),
                                                  lambda s, v: s + v)


def network_udf(make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], n_classes: int,
                input_shape: tuple[int, ...], batch_size: int = 256):
    """Wrap a user network as an Arrow-batched UDF.  ``make_predict_fn`` runs once per
    Python worker (it loads the network - ONNX, Keras, Torch...) and returns a function from
    a batch ``(b, *input_shape)`` float array to ``(b, n_classes)`` scores."""
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                             batch_size=batch_size, input_tensor_shapes=[list(input_shape)])


def onnx_loader(path: str, input_name: str | None = None) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """S8 (single-file network): a ``make_predict_fn`` for ``network_udf`` that opens an ONNX
    model once per Python worker (onnxruntime, CPU).  The path must be readable by every
    executor (shared storage)."""
    def make():
        import onnxruntime as ort  # imported on the worker

        sess = ort.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = input_name or sess.get_inputs()[0].name

        def predict(x: np.ndarray) -> np.ndarray:
            return sess.run(None, {name: x.astype(np.float32)})[0].astype(np.float64)
        return predict
    return make


def transformer_chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A chain of feature transformers (each a DataFrame -> DataFrame step)."""
    for step in steps:
        df = df.transform(step)
    return df
