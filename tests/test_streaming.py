"""Stream == batch: the event-line stream and the static query give the same interval table."""

import numpy as np

from conftest import SF001
import __spark_entry__ as E


def test_stream_equals_batch(spark):
    q = E.queries()
    batch = q["interval_attention"](spark, SF001).toPandas().sort_values("interval_id").reset_index(drop=True)
    stream = q["stream_attention"](spark, SF001).toPandas().sort_values("interval_id").reset_index(drop=True)
    assert batch["interval_id"].tolist() == stream["interval_id"].tolist()
    assert batch["n_events"].tolist() == stream["n_events"].tolist()
    assert batch["interval_no"].tolist() == stream["interval_no"].tolist()
    assert np.allclose(batch["margin"].values, stream["margin"].values, atol=1e-3)
    assert batch["status"].tolist() == stream["status"].tolist()


def test_stream_rejects_equal_batch(spark):
    q = E.queries()
    batch: dict = {}
    for r in q["parse_rejects"](spark, SF001).collect():
        batch[r["status"]] = batch.get(r["status"], 0) + r["n"]
    assert {r["status"]: r["n"] for r in q["stream_rejects"](spark, SF001).collect()} == batch


def test_image_stream_totals(spark):
    r = E.queries()["stream_classify"](spark, SF001).first()
    assert r["n"] == 500 and 0 <= r["correct"] <= 500


def test_stop_when_idle(spark):
    """T5: a running line stream stops at its first empty report after data arrived."""
    import os
    import tempfile

    from pyspark.sql import functions as F

    from vigil.sources.lines import text_stream
    from vigil.streaming.scoring import stop_when_idle

    d = tempfile.mkdtemp(prefix="vigil-idle-")
    with open(os.path.join(d, "a.txt"), "w") as fh:
        fh.write("2018-01-13T21:37:30.830Z,1,Sensor 1,0.5\n")
    old = spark.conf.get("spark.sql.streaming.noDataProgressEventInterval")
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "500ms")
    try:
        counts = text_stream(spark, d).agg(F.count(F.lit(1)).alias("n"))
        q = (counts.writeStream.outputMode("complete").format("memory").queryName("idle_probe")
             .option("checkpointLocation", tempfile.mkdtemp(prefix="vigil-idle-ck-"))
             .trigger(processingTime="200 milliseconds").start())
        stop_when_idle(q, timeout=120)
        assert not q.isActive
        assert spark.table("idle_probe").first()["n"] == 1
    finally:
        spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", old)


def test_stream_restart_from_checkpoint(spark):
    """A stopped scorer restarted on the same checkpoint continues from its stored state
    (new scorer object: the running totals are read back from the state table) and ends with
    the batch result."""
    import time

    from pyspark.sql import functions as F

    from vigil.operators import intervals as iv
    from vigil.plans import streams as st
    from vigil.plans.common import DAY, NEUTRAL, stand_in_model
    from vigil.session import scratch_dir
    from vigil.sources.lines import text_stream
    from vigil.streaming import scoring as ss

    raw = spark.read.parquet(f"{SF001}/events.parquet")
    n = raw.agg(F.max("user_id")).first()[0] + 1
    model = stand_in_model(n)
    base = scratch_dir(spark, "restart")
    st.write_event_line_files(iv.events_from_table(raw), f"{base}/in")

    def start():
        lines = text_stream(spark, f"{base}/in", max_files_per_trigger=st.FILES_PER_CHUNK)
        return ss.start_interval_scoring(lines, model, NEUTRAL, DAY, f"{base}/out", f"{base}/ckpt",
                                         delay=f"{st.CHUNK_DAYS} days", processing_time="0 seconds",
                                         state_partitions=4)

    q = start()
    t0 = time.time()
    while q.isActive and (q.lastProgress is None or q.lastProgress.batchId < 2) and time.time() - t0 < 300:
        time.sleep(0.2)
    q.stop()
    q = start()
    assert ss.stop_on_sentinel(q, timeout=300)
    got = ss.read_scores(spark, f"{base}/out").toPandas().sort_values("interval_id").reset_index(drop=True)
    exp = E.queries()["interval_attention"](spark, SF001).toPandas().sort_values("interval_id").reset_index(drop=True)
    assert got["interval_id"].tolist() == exp["interval_id"].tolist()
    assert got["interval_no"].tolist() == exp["interval_no"].tolist()
    assert np.allclose(got["margin"].values, exp["margin"].values, atol=1e-3)


def test_image_stream_interval_report(spark):
    import tempfile

    from pyspark.sql import functions as F

    from vigil.functions import images as fi
    from vigil.operators import metrics as om
    from vigil.sources.lines import text_stream
    from vigil.streaming import images as si

    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    px = e.select("label", fi.quantize(F.transform("embedding", lambda x: x.cast("double"))).alias("pixels"))
    train = px.select("label", fi.normalise(F.col("pixels"), fi.CIFAR_MEAN, fi.CIFAR_STD).alias("features"))
    classes, cents = om.fitted_model_literals(om.class_means(train))
    d = tempfile.mkdtemp(prefix="vigil-img-")
    px.select(fi.encode_image_a(F.col("label"), F.col("pixels")).alias("value")).repartition(3).write.text(f"{d}/in")
    q = si.start_image_classification(text_stream(spark, f"{d}/in", 1), classes, cents, f"{d}/out", f"{d}/ck",
                                      available_now=True)
    q.awaitTermination()
    rep = si.interval_report(spark, f"{d}/out").orderBy("interval").collect()
    assert len(rep) == 3 and [r["interval"] for r in rep] == [1, 2, 3]
    assert rep[-1]["images_total"] == 500 and rep[-1]["correct_total"] == sum(r["correct"] for r in rep)


def test_bad_image_lines_are_rejected_not_misclassified(spark):
    from vigil.streaming import images as si

    lines = spark.createDataFrame([("10 0",), ("2255 255",), ("11",), ("",), ("x1 2",), ("11 a",)], "value string")
    got = si.classify_lines(lines, [1, 2], [[-1.9, -1.9], [2.1, 2.1]]).collect()
    assert [(r["status"], r["predict"]) for r in got] == [("ok", 1), ("ok", 2)] + [("bad_image", None)] * 4


def test_chunks_have_files_by_their_lines(spark, monkeypatch):
    """Every chunk has the same number of files, which grows with the lines (it was two, so two tasks wrote all)."""
    import os

    from pyspark.sql import functions as F

    from vigil.plans import streams as st
    from vigil.session import scratch_dir

    monkeypatch.setattr(st, "LINES_PER_FILE", 100)
    lines = spark.range(0, 900).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"), (F.col("id") % 3).alias("chunk"))
    path = scratch_dir(spark, "files").removeprefix("file:")
    files = st.write_chunks(lines, path, spark.createDataFrame([("end",)], "value string"))
    assert files == min(3, max(2, spark.sparkContext.defaultParallelism))
    parts = sorted((os.stat(f"{path}/{f}").st_mtime_ns, f) for f in os.listdir(path) if f.startswith("part-"))
    chunks = [{int(x.split()[1]) % 3 for x in open(f"{path}/{f}") if x != "end\n"} for _, f in parts]
    assert [c for c in chunks] == [{0}] * files + [{1}] * files + [{2}] * files
    assert sum(len(open(f"{path}/{f}").readlines()) for _, f in parts) == 901
