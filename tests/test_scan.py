"""Distributed ordering helpers against pandas brute force (small blocks force the two-level path)."""

import numpy as np
import pandas as pd

from vigil.operators.scan import global_index, neighbour_value, running_totals


def test_running_totals_multi_block(spark):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(10_000, 500, replace=False))
    vals = rng.integers(-5, 50, 500)
    df = spark.createDataFrame(pd.DataFrame({"k": keys.astype("int64"), "v": vals.astype("int64")}))
    got = running_totals(df, "k", ["v"], block=37).toPandas().sort_values("k")
    assert got["v_cum"].tolist() == np.cumsum(vals).tolist()


def test_neighbour_value_multi_block(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key in range(5):
        ords = np.sort(rng.choice(3000, 80 if key else 400, replace=False))  # key 0 is hot
        rows += [(key, int(o), float(rng.random())) for o in ords]
    pdf = pd.DataFrame(rows, columns=["k", "o", "v"])
    df = spark.createDataFrame(pdf)
    exp = pdf.sort_values(["k", "o"]).copy()
    exp["p"] = exp.groupby("k")["v"].shift(1)
    exp["n"] = exp.groupby("k")["v"].shift(-1)
    got_p = neighbour_value(df, "k", "o", "v", "p", "prev", block=50).toPandas().sort_values(["k", "o"])
    got_n = neighbour_value(df, "k", "o", "v", "n", "next", block=50).toPandas().sort_values(["k", "o"])
    assert np.allclose(got_p["p"].fillna(-1).values, exp["p"].fillna(-1).values)
    assert np.allclose(got_n["n"].fillna(-1).values, exp["n"].fillna(-1).values)


def test_global_index_with_ties(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, 1000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = global_index(df, ["x"], partitions=7).toPandas()
    assert sorted(got["idx"].tolist()) == list(range(1000))
    assert got.sort_values("idx")["x"].tolist() == sorted(vals.tolist())
