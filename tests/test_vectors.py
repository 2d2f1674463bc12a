"""P2 P6 V1-V4 A7 A8."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions import vectors as fv
from vigil.operators import vectors as ov

# Fixed sample: the first five rows of the shipped 10-sensor training file.
SAMPLE = [
    "1.00000,0.50457,0.06221,0.07500,0.60180,0.43030,0.48300,0.90816,0.60859,0.40584,0.87647",
    "1.00000,0.04493,0.27824,0.16447,0.46271,0.92100,0.94577,0.63252,0.95342,0.16438,0.33269",
    "0.00000,0.51404,0.69344,0.31516,0.48384,0.02342,0.68141,0.50664,0.09665,0.12016,0.32808",
    "1.00000,0.68720,0.29893,0.59346,0.29191,0.36441,0.91206,0.64133,0.01655,0.15727,0.96810",
    "1.00000,0.84226,0.39450,0.74643,0.98281,0.48525,0.14911,0.54405,0.23900,0.41318,0.30536",
]


def test_sample_labels_follow_weights_2_to_11(spark):
    df = spark.createDataFrame([(x,) for x in SAMPLE], "value string")
    arr = fv.parse_training_array(F.col("value"))
    p = df.select(fv.training_label(arr).alias("label"), fv.training_features(arr).alias("f"))
    cut = fv.default_cutoff(10)
    assert cut == 27.5
    rows = p.select("label", fv.threshold_label(fv.weighted_score(F.col("f"), 2), cut).alias("l2"),
                    fv.threshold_label(fv.weighted_score(F.col("f"), 1), cut).alias("l1")).collect()
    assert all(r["label"] == r["l2"] for r in rows)
    assert [r["l1"] for r in rows][3:5] == [0, 0]  # lines 4 and 5 disagree with weights 1..n


def test_encode_vector_roundtrip(spark):
    df = spark.createDataFrame([(1.0, [0.5, 0.25, 0.125])], "label double, f array<double>")
    line = df.select(fv.encode_vector(F.col("label"), F.col("f")).alias("l")).first()["l"]
    assert line == "1.00000,0.50000,0.25000,0.12500"


def test_threshold_tie_is_zero(spark):
    df = spark.createDataFrame([(27.5,)], "s double")
    assert df.select(fv.threshold_label(F.col("s"), 27.5)).first()[0] == 0


def test_generate_is_deterministic_and_rounds_rows(spark):
    a = ov.generate_range(spark, 1000, 10, 7, seed=5).toPandas().sort_values("key")
    b = ov.generate_range(spark, 1000, 10, 3, seed=5).toPandas().sort_values("key")
    assert len(a) == 1001  # ceil(1000 / 7) * 7
    common = a.merge(b, on="key")
    assert all(np.allclose(x, y) for x, y in zip(common["features_x"], common["features_y"]))
    f = np.stack(a["features"].values)
    assert f.min() >= 0 and f.max() < 1 and abs(f.mean() - 0.5) < 0.02
    corr = np.corrcoef(f.T)
    assert np.abs(corr - np.eye(10)).max() < 0.12  # values of one row are not related
    assert abs(f.std() - (1 / 12) ** 0.5) < 0.01
    score = (f * np.arange(1, 11)).sum(axis=1)
    assert np.allclose(score, a["score"].values)
    assert ((score > 27.5).astype(float) == a["label"].values).all()
    s = ov.label_stats(ov.generate_range(spark, 1000, 10, 7, seed=5)).first()
    assert s["n"] == 1001 and abs(s["pct_ones"] - 100.0 * (score > 27.5).mean()) < 1e-9


def test_score_cutoffs_index_rule(spark):
    rng = np.random.default_rng(4)
    scores = rng.random(1234) * 100
    df = spark.createDataFrame(pd.DataFrame({"score": scores}))
    got = {r["pct"]: r["cutoff"] for r in ov.score_cutoffs(df).collect()}
    srt = np.sort(scores)
    step = 1234 // 100
    exp = {99 - p: srt[step::step][p] for p in range(99)}
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_score_cutoffs_needs_100_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "score double")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(ValueError, match="at least 100 rows"):
            ov.score_cutoffs(df)
    spark.conf.unset("spark.sql.ansi.enabled")


def test_score_cutoffs_with_a_hot_score(spark):
    scores = sorted([5.0] * 900 + [float(i) for i in range(100)])
    df = spark.createDataFrame([(s,) for s in scores], "score double").repartition(7)
    got = {r["pct"]: r["cutoff"] for r in ov.score_cutoffs(df).collect()}
    assert got == {100 - k: scores[k * 10] for k in range(1, 100)}


def test_wide_vector_is_an_error(spark):
    import pyspark.errors
    five = spark.createDataFrame([([1.0] * 5,), (None,)], "f array<double>")
    assert five.where("f is not null").select(fv.weighted_score(F.col("f"))).first()[0] == 15.0
    for c in (fv.weighted_score(F.col("f"), width=3), fv.encode_vector(F.lit(1.0), F.col("f"), width=3)):
        with pytest.raises(pyspark.errors.PySparkException, match="3 values"):
            five.select(c).collect()
