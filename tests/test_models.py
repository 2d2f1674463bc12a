"""Training, persistence, the linear scorer and the batch network UDF."""

import datetime as dt
import os
import tempfile

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vigil.operators import intervals as iv
from vigil.operators import models as om
from vigil.operators import vectors as ov

def test_train_save_load_predict(spark):
    g = ov.generate_range(spark, 800, 5, 4, seed=11)
    lines = g.select(F.concat_ws(",", F.format_string("%.5f", "label"),
                                 F.array_join(F.transform("features", lambda x: F.format_string("%.5f", x)), ","))
                     .alias("value"))
    train = om.training_frame(lines, 5)
    model = om.train_lr(train, fit_intercept=True)
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-lr-"), "m")
    om.save_model(model, path)
    loaded = om.load_model(path)
    assert np.allclose(loaded.coefficients.toArray(), model.coefficients.toArray())
    pred = om.predict_lr(loaded, train)
    acc = pred.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9
    # SQL-form margin equals the model's raw prediction
    arr = g.select(F.col("features").alias("f"))
    m1 = arr.select(om.lr_margin(F.col("f"), model.coefficients.toArray(), model.intercept).alias("m")).toPandas()["m"]
    m2 = model.transform(arr.select(array_to_vector("f").alias("features"))).select(
        F.get(vector_to_array("rawPrediction"), 1).alias("m")).toPandas()["m"]
    assert np.allclose(m1.values, m2.values)

def test_interval_scores_with_trained_model(spark):
    model = iv.LinearModel([0.5, -1.0, 2.0], 0.25)
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t0, 1, 2.0, 1), (t0, 3, 1.0, 2), (t0 + dt.timedelta(hours=1), 2, 4.0, 3)],
                               "ts timestamp, sensor int, value double, seq long")
    got = [r["margin"] for r in iv.score_intervals(iv.with_interval(ev, 3600), model, 0.0).orderBy("interval_id").collect()]
    assert np.allclose(got, [0.25 + 1.0 + 2.0, 0.25 + 1.0 - 4.0 + 2.0])

def test_network_udf_matches_linear_scorer(spark):
    w = np.arange(12, dtype=float).reshape(4, 3)

    def make():

        def predict(x):
            return x.reshape(len(x), -1) @ w
        return predict

    udf = om.network_udf(make, 3, (4,), batch_size=16)
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(40)], "id int, x array<double>")
    got = np.array([r["s"] for r in df.select("id", udf("x").alias("s")).orderBy("id").collect()])
    exp = np.array([[float(i), 1.0, 2.0, 3.0] for i in range(40)]) @ w
    assert np.allclose(got, exp)
