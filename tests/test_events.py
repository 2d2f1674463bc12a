"""Event wire lines."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.functions import events as fe
from vigil.operators.events import encode_events, parse_event_lines, valid_events

GOOD = "2018-01-13T21:37:30.830Z,77,Sensor 77,0.47453"


def _parse(spark, lines, n=100):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return {r["line"]: r for r in parse_event_lines(df, n).collect()}


def test_parse_good_line(spark):
    r = _parse(spark, [GOOD])[GOOD]
    assert r["status"] == "ok"
    assert r["sensor"] == 77 and r["name"] == "Sensor 77" and abs(r["value"] - 0.47453) < 1e-12
    utc = r["ts"].replace(tzinfo=dt.timezone.utc) if r["ts"].tzinfo is None else r["ts"]
    assert utc.strftime("%Y-%m-%dT%H:%M:%S") == "2018-01-13T21:37:30"
    assert utc.microsecond == 830000


def test_edge_lines(spark):
    lines = {
        "": "bad_fields",
        "2018-01-13T21:37:30.830Z,1,Sensor 1": "bad_fields",
        "2018-01-13T21:37:30.830Z,1,Sensor 1,0.5,x": "bad_fields",
        "2018-01-13T21:37:30.830Z,1,Sensor 1,": "bad_type",  # trailing empty field is kept, then rejected
        "2018-01-13T21:37:30.830Z,one,Sensor 1,0.5": "bad_type",
        "2018-01-13T21:37:30.830Z,1,Sensor 1,abc": "bad_type",
        "2018-01-13T21:37:30.830Z,0,Sensor 0,0.5": "bad_range",
        "2018-01-13T21:37:30.830Z,101,Sensor 101,0.5": "bad_range",
        "2018-01-13T21:37:30.830Z,-1,Sensor -1,0.00000": "control",
        "not-a-time,5,Sensor 5,0.5": "bad_time",
        GOOD: "ok",
    }
    got = _parse(spark, list(lines))
    assert {k: got[k]["status"] for k in lines} == lines


def test_encode_parse_roundtrip(spark):
    rows = [(dt.datetime(2018, 1, 13, 21, 37, 30, 830123), 77, 0.47453, 1),
            (dt.datetime(2024, 2, 29, 23, 59, 59, 999999), 3, 123.5, 2)]
    ev = spark.createDataFrame(rows, "ts timestamp, sensor int, value double, seq long")
    lines = encode_events(ev)
    got = sorted(r["value"] for r in lines.collect())
    assert got[0] == GOOD
    assert got[1] == "2024-02-29T23:59:59.999Z,3,Sensor 3,123.50000"
    back = valid_events(parse_event_lines(lines, 100)).orderBy("seq").collect()
    assert [(r["sensor"], r["value"]) for r in back] == [(77, 0.47453), (3, 123.5)]


def test_encode_is_session_zone_independent(spark):
    ev = spark.createDataFrame([(dt.datetime(2018, 1, 13, 21, 37, 30, 830000), 77, 0.47453, 1)],
                               "ts timestamp, sensor int, value double, seq long")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        utc_line = encode_events(ev).first()["value"]
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        ev2 = spark.createDataFrame([(GOOD,)], "value string")
        parsed = parse_event_lines(ev2, 100).select(fe.format_ts_utc(F.col("ts")).alias("t")).first()["t"]
        assert parsed == "2018-01-13T21:37:30.830Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc_line.startswith("2018-01-13T21:37:30.830Z")


def test_sentinel_line(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 13, 21, 37, 30, 830000),)], "ts timestamp")
    assert df.select(fe.sentinel_line(F.col("ts"))).first()[0] == "2018-01-13T21:37:30.830Z,-1,Sensor -1,0.00000"
