"""A4 A5 A6 A9 A13 O3 O4 and the nearest-class-mean scorer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import metrics as om


def _pred(spark):
    # F8 fixture: id, label, predict, scores (row 3 has a score tie between classes 0 and 2)
    rows = [(1, 0, 0, [0.9, 0.05, 0.05]), (2, 1, 0, [0.5, 0.4, 0.1]), (3, 2, 0, [0.4, 0.2, 0.4]),
            (4, 2, 2, [0.1, 0.1, 0.8])]
    return spark.createDataFrame(rows, "id long, label int, predict int, scores array<double>")


def test_accuracy_and_topk(spark):
    p = _pred(spark)
    a = om.accuracy(p).first()
    assert (a["n"], a["correct"], a["pct"]) == (4, 2, 50.0)
    t = om.topk_accuracy(p, F.array(F.lit(0), F.lit(1), F.lit(2)), (1, 2)).first()
    # ranks of the true class: 1, 2, 2 (tie, lower index first), 1
    assert (t["acc1"], t["acc2"]) == (50.0, 100.0)


def test_nearest_mean_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6))
    y = rng.integers(0, 4, 200)
    x += y[:, None] * 0.8
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "label": y.astype("int32"), "features": list(x)}))
    model = om.class_means(df)
    got = om.predict_nearest_mean(df, model).orderBy("id").toPandas()
    cents = np.stack([x[y == c].mean(axis=0) for c in range(4)])
    d = np.round(((x[:, None, :] - cents[None]) ** 2).sum(-1), 4)
    assert (got["predict"].values == d.argmin(axis=1)).all()


def test_class_counts_and_progress(spark):
    p = _pred(spark)
    cc = {r["label"]: (r["n"], r["n_classes"]) for r in om.class_counts(p).collect()}
    assert cc == {0: (1, 3), 1: (1, 3), 2: (2, 3)}
    prog = om.count_window_progress(p, "id", 3).orderBy("report_no").collect()
    assert [(r["report_no"], r["images"], r["correct"]) for r in prog] == [(1, 3, 1), (2, 4, 2)]


def test_first_batch(spark):
    p = _pred(spark)
    assert [r["id"] for r in om.first_batch(p, "id", 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        om.first_batch(p, "id", 10)
