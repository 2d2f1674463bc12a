"""The command-line programs end to end: generate -> train -> score a file stream."""

import datetime as dt
import os
import tempfile

from vigil import cli


def test_generate_train_cutoffs_score(spark, capsys):
    d = tempfile.mkdtemp(prefix="vigil-cli-")
    cli.main(["generate", "1000", "5", "4", f"{d}/train"], spark)
    assert spark.read.text(f"{d}/train").count() == 1000
    cli.main(["train", f"{d}/train", f"{d}/model", "--intercept"], spark)
    cli.main(["cutoffs", "1000", "5"], spark)
    out = capsys.readouterr().out
    assert "cutoffs: rows=1000 sensors=5" in out and "'ok': 1000" in out and "\n50 " in out

    os.makedirs(f"{d}/in")
    t0 = dt.datetime(2024, 1, 1)
    lines = []
    for i in range(60):
        ts = t0 + dt.timedelta(seconds=i)
        lines.append(f"{ts:%Y-%m-%dT%H:%M:%S}.000Z,{i % 5 + 1},Sensor {i % 5 + 1},{(i % 7) / 7:.5f}")
    lines.append(f"{t0 + dt.timedelta(seconds=61):%Y-%m-%dT%H:%M:%S}.000Z,-1,Sensor -1,0.00000")
    with open(f"{d}/in/events.txt", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    cli.main(["score-stream", "5", "10", f"{d}/model", f"{d}/out", f"{d}/ckpt", "--files", f"{d}/in"], spark)
    scores = spark.read.parquet(f"{d}/out").orderBy("interval_id").collect()
    assert [r["n_events"] for r in scores] == [10] * 6
    assert [r["interval_no"] for r in scores] == list(range(1, 7))
    assert "events=60 " in capsys.readouterr().out
