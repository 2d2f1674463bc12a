"""Interval scoring against a dense brute force."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF001
from vigil.operators import intervals as iv
from vigil.plans.common import stand_in_model


def _events(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, sensor int, value double, seq long")


def dense_scores(pdf: pd.DataFrame, weights, intercept, neutral, seconds):
    """Brute force: walk the events in time order, keep the full feature array, score each
    non-empty interval on the state at its end (the reference's driver loop)."""
    pdf = pdf.sort_values(["ts", "seq"])
    us = int(seconds * 1e6)
    epoch = (pdf["ts"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)
    pdf = pdf.assign(interval_id=epoch // us)
    x = np.full(len(weights), neutral, dtype=float)
    out = []
    for k, (ivid, grp) in enumerate(pdf.groupby("interval_id", sort=True), start=1):
        for s, v in zip(grp["sensor"], grp["value"]):
            x[s - 1] = v
        m = intercept + float(np.dot(weights, x))
        out.append((ivid, k, len(grp), m, "Attention needed" if m > 0 else "Everything is OK"))
    return pd.DataFrame(out, columns=["interval_id", "interval_no", "n_events", "margin", "status"])


def test_worked_case_f3(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    ev = _events(spark, [(t0 + dt.timedelta(seconds=1), 1, 0.9, 1), (t0 + dt.timedelta(seconds=2), 2, 0.1, 2),
                         (t0 + dt.timedelta(seconds=11), 2, 0.7, 3)])
    model = iv.LinearModel([1.0, 10.0], -5.0)
    got = iv.score_intervals(iv.with_interval(ev, 10), model, 0.5).orderBy("interval_id").collect()
    # features (0.9, 0.1) then (0.9, 0.7)
    assert [round(r["margin"], 9) for r in got] == [round(-5 + 0.9 + 1.0, 9), round(-5 + 0.9 + 7.0, 9)]
    assert [r["status"] for r in got] == ["Everything is OK", "Attention needed"]
    assert [r["interval_no"] for r in got] == [1, 2]


def test_last_write_wins_by_time_then_seq(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 30)
    ev = _events(spark, [(t0, 1, 5.0, 2), (t0, 1, 7.0, 1), (t0 - dt.timedelta(seconds=1), 1, 9.0, 3)])
    last = iv.last_per_sensor(iv.with_interval(ev, 3600)).first()
    assert last["value"] == 5.0 and last["n_readings"] == 3


def test_neutral_state_is_not_attention(spark):
    # q10: a score equal to the cutoff is label 0
    ev = _events(spark, [(dt.datetime(2024, 1, 1), 1, 0.5, 1)])
    m = iv.LinearModel([1.0, 1.0], -1.0)
    assert iv.score_intervals(iv.with_interval(ev, 1), m, 0.5).first()["status"] == "Everything is OK"


def test_delta_form_equals_dense_form(spark):
    raw = spark.read.parquet(f"{SF001}/events.parquet")
    ev = iv.events_from_table(raw)
    n = raw.agg(F.max("user_id")).first()[0] + 1
    model = stand_in_model(n)
    for seconds in (3600, 86400):
        got = iv.score_intervals(iv.with_interval(ev, seconds), model, 50.0).toPandas().sort_values("interval_id")
        pdf = ev.toPandas()
        exp = dense_scores(pdf, np.array(model.weights), model.intercept, 50.0, seconds)
        assert got["interval_id"].tolist() == exp["interval_id"].tolist()
        assert got["n_events"].tolist() == exp["n_events"].tolist()
        assert got["interval_no"].tolist() == exp["interval_no"].tolist()
        assert np.allclose(got["margin"].values, exp["margin"].values, atol=1e-6)
        assert got["status"].tolist() == exp["status"].tolist()


def test_validity_ranges_cover_dense_grid(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = _events(spark, [(t0, 1, 1.0, 1), (t0 + dt.timedelta(days=2), 1, 2.0, 2), (t0 + dt.timedelta(days=1), 2, 3.0, 3)])
    r = iv.validity_ranges(iv.last_per_sensor(iv.with_interval(ev, 86400))).orderBy("sensor", "interval_from").collect()
    base = r[0]["interval_from"]
    assert [(x["sensor"], x["interval_from"] - base, None if x["interval_to"] is None else x["interval_to"] - base, x["value"])
            for x in r] == [(1, 0, 2, 1.0), (1, 2, None, 2.0), (2, 1, None, 3.0)]


def test_spine_and_summary(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = iv.with_interval(_events(spark, [(t0, 1, 1.0, 1), (t0 + dt.timedelta(hours=3), 1, 2.0, 2),
                                          (t0 + dt.timedelta(hours=3, minutes=5), 2, 2.0, 3)]), 3600)
    spine = iv.interval_spine(iv.interval_counts(ev)).orderBy("interval_id").collect()
    assert [(r["n_events"], r["empty"]) for r in spine] == [(1, False), (0, True), (0, True), (2, False)]
    s = iv.run_summary(ev, 3600).first()
    assert (s["n_intervals"], s["n_empty"], s["n_events"]) == (2, 2, 3)
    assert abs(s["events_per_sec"] - 3 / 7200) < 1e-12
