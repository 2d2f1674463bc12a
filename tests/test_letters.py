"""Dead letters and run report: one pass, replay and restart leave the same rows."""

import os

from vigil.session import scratch_dir
from vigil.sources.lines import text_stream
from vigil.streaming.letters import dead_letters, good_readings, start_line_sorting
from vigil.streaming.report import RunReport


def line(second, sensor, value):
    m, s = divmod(second, 60)
    return f"2018-01-13T21:{m:02d}:{s:02d}.000Z,{sensor},Sensor {sensor},{value}"


BATCHES = [[line(1, 1, 1.0), "no line", line(15, 9, 1.0), line(40, 2, 2.0)], [line(5, 1, 3.0), line(31, 1, 4.0), line(6, 2, "x"), line(60, -1, 0)], [line(41, 1, 5.0)]]


def folder(spark):
    base = scratch_dir(spark, "letters").removeprefix("file:")
    os.makedirs(f"{base}/in")
    return base


def add(base, n):
    path = f"{base}/in/{n}.txt"
    with open(path, "w") as f:
        f.write("\n".join(BATCHES[n]) + "\n")
    os.utime(path, (1_500_000_000 + n, 1_500_000_000 + n))


def run(spark, base):
    q = start_line_sorting(text_stream(spark, f"{base}/in", 1), 3, 10, 20, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return q


def result(spark, base):
    return (sorted((r["sensor"], r["value"]) for r in good_readings(spark, f"{base}/out").collect()),
            sorted((r["line"], r["reason"], r["batch_id"]) for r in dead_letters(spark, f"{base}/out").collect()))


# The second batch's lines of 21:00:05 and :06 are late: their interval was over 20 seconds before 21:00:40.
WANT = ([(1, 1.0), (1, 4.0), (1, 5.0), (2, 2.0)], sorted([("no line", "bad_fields", 0), (BATCHES[0][2], "bad_range", 0), (BATCHES[1][0], "late", 1), (BATCHES[1][2], "late", 1)]))


def test_replayed_batch_after_a_restart(spark):
    base = folder(spark)
    for n in (0, 1):
        add(base, n)
    run(spark, base)
    # the second batch was written, but the query died before Spark noted its end
    for name in os.listdir(f"{base}/ckpt/query/commits"):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{base}/ckpt/query/commits/{name}")
    add(base, 2)
    q = run(spark, base)
    assert [p.batchId for p in q.recentProgress if p.numInputRows] == [1, 2]
    assert result(spark, base) == WANT
    assert sorted(x for x in os.listdir(f"{base}/out") if x.startswith("b=")) == ["b=0", "b=1", "b=2"]


def test_report_has_a_row_per_batch(spark):
    base = folder(spark)
    for n in range(3):
        add(base, n)
    with RunReport(spark) as report:
        q = run(spark, base)
        report.wait_for(q)
    rows = [r for r in report.batches().collect() if r["run_id"] == str(q.runId) and r["n_rows"]]
    assert [(r["batch_id"], r["n_rows"], r["n_lines"], r["n_rejected"]) for r in rows] == [(0, 4, 4, 2), (1, 4, 4, 1), (2, 1, 1, 0)]
    assert all(r["busy_ms"] > 0 for r in rows)
    assert result(spark, base) == WANT
