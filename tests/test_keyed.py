"""Keyed interval state: timers, malformed-only and empty intervals, late lines, restart, changed state only."""

import os
import time

import pytest

from vigil.operators.intervals import LinearModel
from vigil.session import scratch_dir
from vigil.sources.lines import text_stream
from vigil.streaming import keyed
from vigil.streaming import scoring as ss

MODEL = LinearModel([1.0, 2.0, 3.0], -20.0)


def line(second, sensor, value):
    m, s = divmod(second, 60)
    return f"2018-01-13T21:{m:02d}:{s:02d}.000Z,{sensor},Sensor {sensor},{value}"


BATCHES = [
    [line(1, 1, 5.0), line(2, 2, 6.0), line(11, 1, 7.0), line(12, 9, 1.0), "no line"],    # sensor 9 is out of range
    [line(25, 1, "x"), line(9, 3, 4.0), line(62, 1, 9.0), line(61, 1, 8.0)],              # 20-30 malformed only, then a gap; 0-10 still open
    [line(5, 2, 99.0), line(65, 3, 1.5), line(75, 2, 2.0), line(80, 2, 1.0)],             # the first one is late
]


def folder(spark, batches, end=True):
    """One file, and so one micro-batch, per list of lines."""
    base = scratch_dir(spark, "keyed").removeprefix("file:")
    os.makedirs(f"{base}/in")
    for n, lines in enumerate(batches):
        add(base, n, lines)
    if end:
        add(base, 99, [line(99, -1, 0.0)])
    return base


def add(base, n, lines):
    path = f"{base}/in/{n:03d}.txt"
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (1_500_000_000 + n, 1_500_000_000 + n))


def start(spark, base, **options):
    return ss.start_interval_scoring(text_stream(spark, f"{base}/in", 1), MODEL, 5.0, 10, f"{base}/out", f"{base}/ckpt", delay="10 seconds", state_partitions=2, **options)


def rows(spark, base):
    out = ss.read_intervals(spark, f"{base}/out").collect()
    first = min(r["interval_id"] for r in out)
    return sorted((r["interval_id"] - first, r["interval_no"], r["n_events"], r["n_lines"], r["margin"], r["n_empty"]) for r in out)


# Margins: -20 + 1*v1 + 2*v2 + 3*v3 with 5.0 before the first reading.
EXPECTED = [
    (0, 1, 3, 3, -20 + 5 + 12 + 12.0, 0), (1, 2, 1, 2, -20 + 7 + 12 + 12.0, 0), (2, 3, 0, 1, -20 + 7 + 12 + 12.0, 0),
    (3, None, 0, 0, None, 1), (4, None, 0, 0, None, 1), (5, None, 0, 0, None, 1),
    (6, 4, 3, 3, -20 + 9 + 12 + 4.5, 0), (7, 5, 1, 1, -20 + 9 + 4 + 4.5, 0), (8, 6, 1, 1, -20 + 9 + 2 + 4.5, 0)]


def test_intervals_by_timers(spark):
    base = folder(spark, BATCHES)
    q = start(spark, base, processing_time="0 seconds")
    assert ss.stop_on_sentinel(q, timeout=300)
    assert rows(spark, base) == EXPECTED
    t = ss.read_totals(spark, f"{base}/ckpt").first()
    assert (t["n_intervals"], t["n_empty"], t["n_late"]) == (6, 3, 1)


def test_restart_keeps_state_and_writes_changes_only(spark):
    base = folder(spark, BATCHES[:2], end=False)
    q = start(spark, base, available_now=True)
    q.awaitTermination()
    add(base, 2, BATCHES[2])
    q = start(spark, base, available_now=True)
    q.awaitTermination()
    with_rows = [p for p in q.recentProgress if p.numInputRows > 0]
    assert [p.numInputRows for p in with_rows] == [4]
    add(base, 99, [line(99, -1, 0.0)])
    q = start(spark, base, processing_time="0 seconds")
    assert ss.stop_on_sentinel(q, timeout=300)
    assert rows(spark, base) == EXPECTED


def test_untouched_sensors_are_not_written(spark):
    many = [line(1, 1, 1.0)] + [line(2, s, 1.0) for s in range(1, 4)]
    base = folder(spark, [many, [line(50, 1, 2.0)], [line(51, 1, 3.0)], [line(52, 1, 4.0)]], end=False)
    q = start(spark, base, available_now=True)
    q.awaitTermination()
    updated = {p.batchId: p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators}
    assert updated[0] == 4 and updated[3] == 2  # the last batch: sensor 1 and the clock, of four keys


def test_jump_in_time_is_one_row(spark):
    base = folder(spark, [[line(1, 1, 1.0)], ["2038-01-13T21:00:00.000Z,1,Sensor 1,2.0"], ["2038-01-13T21:01:00.000Z,1,Sensor 1,2.0"]])
    q = start(spark, base, processing_time="0 seconds", longest_gap=50)
    assert ss.stop_on_sentinel(q, timeout=300)
    got = rows(spark, base)
    assert len(got) < 20
    assert sum(r[5] for r in got) > 60_000_000 and max(r[1] or 0 for r in got) == 3


def test_ties_go_by_arrival_and_partials_merge():
    import pandas as pd
    import pyarrow as pa

    def batch(values):
        n = len(values)
        return pa.RecordBatch.from_pandas(pd.DataFrame({"key": [1] * n, "interval_id": [4] * n, "at": [40] * n, "part": [""] * n, "seq": [s for s, _ in values], "value": [v for _, v in values], "ok": [True] * n}))

    out = pd.concat(b.to_pandas() for b in keyed._partial(iter([batch([(2, 2.0), (1, 1.0)]), batch([(3, 3.0)])])))
    readings = out[out["key"] == 1]
    assert readings["value"].tolist() == [2.0, 3.0] and readings["n"].tolist() == [2, 1]
    assert out[out["key"] == 0]["n_lines"].tolist() == [2, 1]


def test_sensors_share_keys_and_keep_their_own_values(spark):
    """600 sensors over three runs of a query are a few keys, and each reading goes out with its sensor's value before."""
    n, out = 600, []
    sent = [[(3 + 10 * b + s % 2, s, float(s + 1000 * b)) for s in range(1, n + 1) if (s + b) % 3] for b in range(4)]
    base = folder(spark, [[line(*r) for r in lines] + [line(1 + 10 * b, 70, -1.0)] for b, lines in enumerate(sent)], end=False)  # sensor 70 has an earlier reading in each interval, too

    def collect(batch, batch_id):
        out.extend((batch_id, *r) for r in batch.where("kind = 'reading'").select("interval_id", "sensor", "value", "prev", "n").collect())

    def run():
        closed = keyed.closed_intervals(text_stream(spark, f"{base}/in"), n, 10, "5 seconds")
        w = closed.writeStream.outputMode("append").foreachBatch(collect).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
        q = keyed.with_store(spark, lambda: ss.start_with_state_partitions(w, spark, 2))
        q.awaitTermination()
        return [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows > 0]

    first = run()
    blocks = -(-(n - keyed.SINGLE) // keyed.BLOCK)
    assert first and max(first) <= 2 * (1 + keyed.SINGLE + blocks) < n / 3
    for second in (99, 199):
        add(base, second, [line(second, -1, 0.0)])
        run()
    start_at = min(r[1] for r in out)
    got = sorted((r[1] - start_at, *r[2:]) for r in out)
    held, expected = {}, []
    for b, lines in enumerate(sent):
        for _, s, v in lines:
            expected.append((b, s, v, held.get(s), 2 if s == 70 else 1))
            held[s] = v
        if not any(s == 70 for _, s, _ in lines):
            expected.append((b, 70, -1.0, held.get(70), 1))
            held[70] = -1.0
    assert got == sorted(expected)


def test_state_keys(spark):
    from pyspark.sql import functions as F

    keys = [r[0] for r in spark.range(0, 2000).select(keyed.state_key(F.col("id").cast("int"))).collect()]
    assert keys[:keyed.SINGLE + 1] == list(range(keyed.SINGLE + 1))
    assert keys[keyed.SINGLE + 1:] == [keyed.SINGLE + 1 + i // keyed.BLOCK for i in range(2000 - keyed.SINGLE - 1)]


@pytest.fixture(autouse=True)
def _no_left_over(spark):
    yield
    for q in spark.streams.active:
        q.stop()
    time.sleep(0.1)
