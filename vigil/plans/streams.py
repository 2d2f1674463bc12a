"""Registered stream queries: the table is written as a sequence of line files (in time order),
replayed through Structured Streaming to completion, and the sink's table is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions import events as fe
from vigil.functions import images as fi
from vigil.operators import intervals as iv
from vigil.operators import metrics as om
from vigil.plans.common import CROP_HW, DAY, HOUR, IMAGE_HWC, NEUTRAL, PROGRESS_EVERY, n_sensors, stand_in_model, table
from vigil.operators.models import network_udf
from vigil.plans.queries import DISTANCE_DECIMALS, line_kinds, register
from vigil.session import scratch_dir
from vigil.sources.lines import text_stream
from vigil.sources.records import placed_lines
from vigil.streaming import images as si
from vigil.streaming import keyed
from vigil.streaming import scoring as ss
from vigil.streaming.letters import dead_letters, good_readings, start_line_sorting
from vigil.streaming.report import RunReport

CHUNK_DAYS = 7      # one group of input files per 7 days of events (one micro-batch each)
FILES_PER_CHUNK = 2  # at least; as many in every chunk
LINES_PER_FILE = 100_000
STREAM_TIMEOUT_S = 1800


def write_event_line_files(events: DataFrame, path: str) -> int:
    """Event lines as files written chunk after chunk in time order (file streams read the
    oldest files first); the end-of-stream record rides with the last chunk.  Gives the files per chunk."""
    ev = events.withColumn("chunk", F.floor(iv.interval_id(F.col("ts"), DAY) / CHUNK_DAYS))
    end = events.agg(F.max("ts").alias("ts")).select(fe.sentinel_line(F.col("ts")).alias("value"))
    return write_chunks(ev.select(fe.encode_event(F.col("ts"), F.col("sensor"), F.col("value")).alias("value"), "chunk"), path, end)


def write_chunks(lines: DataFrame, path: str, end: DataFrame | None = None) -> int:
    """(value, chunk) lines as text files written chunk after chunk, so that the file times follow the chunk numbers; each chunk is one micro-batch.
    This replays a stored table as a stream for the registered check (a single partitioned write would give the files arbitrary times).
    ``end`` rides with the last chunk.  Gives the files per chunk: they grow with the smallest chunk, up to a task for each core."""
    spark = lines.sparkSession
    staged = scratch_dir(spark, "chunks")  # the table is read once; a chunk is then one folder
    lines.write.partitionBy("chunk").parquet(staged)
    keyed = spark.read.parquet(staged)
    sizes = sorted((r["chunk"], r["count"]) for r in keyed.groupBy("chunk").count().collect())  # a few chunk ids
    files = max(FILES_PER_CHUNK, min(spark.sparkContext.defaultParallelism, min((n for _, n in sizes), default=0) // LINES_PER_FILE))
    for c, _ in sizes:
        part = keyed.where(F.col("chunk") == c).select("value")
        if end is not None and c == sizes[-1][0]:
            part = part.unionByName(end)
        part.repartition(files).write.mode("append").text(path)
    return files


def disturbed_lines(events: DataFrame) -> DataFrame:
    """(value, chunk): the events' lines with hours that have no line (every 11th), hours of lines without a value
    only (every 7th), and lines that are sent again two chunks later, when their hour is over (every 97th)."""
    ev = events.withColumn("hour", iv.interval_id(F.col("ts"), HOUR)).withColumn("chunk", F.floor(iv.interval_id(F.col("ts"), DAY) / CHUNK_DAYS))
    good = fe.encode_event(F.col("ts"), F.col("sensor"), F.col("value"))
    bad = F.concat(F.concat_ws(",", fe.format_ts_utc(F.col("ts")), F.col("sensor").cast("string"), fe.sensor_name(F.col("sensor"))), F.lit(","))
    last = F.broadcast(ev.agg(F.max("chunk").alias("last"), F.max("ts").alias("end")))  # one row
    ev = ev.join(last)
    sent = F.array(F.struct(F.when(F.col("hour") % 11 != 5, F.when(F.col("hour") % 7 == 3, bad).otherwise(good)).alias("value"), F.col("chunk").alias("chunk")),
                   F.struct(F.when((F.col("seq") % 97 == 5) & (F.col("chunk") + 2 <= F.col("last")), good).alias("value"), (F.col("chunk") + 2).alias("chunk")))
    end = last.select(fe.sentinel_line(F.col("end")).alias("value"), F.col("last").alias("chunk"))
    return ev.select(F.explode(sent).alias("s")).select("s.value", "s.chunk").where("value is not null").unionByName(end)


def _score_stream(spark: SparkSession, sf_dir: str, seconds: float) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    events = iv.events_from_table(raw)
    model = stand_in_model(n_sensors(raw))
    base = scratch_dir(spark, "stream")
    files = write_event_line_files(events, f"{base}/in")
    lines = text_stream(spark, f"{base}/in", max_files_per_trigger=files)
    q = ss.start_interval_scoring(lines, model, NEUTRAL, seconds, f"{base}/out", f"{base}/ckpt",
                                  delay=f"{CHUNK_DAYS} days", processing_time="0 seconds",
                                  state_partitions=spark.sparkContext.defaultParallelism)
    if not ss.stop_on_sentinel(q, timeout=STREAM_TIMEOUT_S):
        raise TimeoutError("event stream did not reach its end-of-stream record")
    return ss.read_scores(spark, f"{base}/out")


@register("stream_attention")
def stream_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T5 + T8 in streaming form: the per-day attention report of Q1 from an event-line
    file stream (same result as the batch query)."""
    s = _score_stream(spark, sf_dir, DAY)
    return s.select("interval_id", "interval_no", "n_events", F.round("margin", 4).alias("margin"), "status")


@register("stream_intervals")
def stream_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + A2 + T8 in streaming form: readings per hour and the running interval number."""
    s = _score_stream(spark, sf_dir, HOUR)
    return s.select("interval_id", "n_events", "interval_no")


@register("stream_interval_report")
def stream_interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 (rule q8), T7, T8 on a stream: every hour as its timer closes it, scored if it had any line (also malformed ones
    only), reported as empty if not; lines that came after their hour was over are counted (``n_late``)."""
    raw = table(spark, sf_dir, "events")
    base = scratch_dir(spark, "report")
    files = write_chunks(disturbed_lines(iv.events_from_table(raw)), f"{base}/in")
    lines = text_stream(spark, f"{base}/in", max_files_per_trigger=files)
    q = ss.start_interval_scoring(lines, stand_in_model(n_sensors(raw)), NEUTRAL, HOUR, f"{base}/out", f"{base}/ckpt", delay="1 day",
                                  processing_time="0 seconds", state_partitions=spark.sparkContext.defaultParallelism)
    if not ss.stop_on_sentinel(q, timeout=STREAM_TIMEOUT_S):
        raise TimeoutError("event stream did not reach its end-of-stream record")
    late = ss.read_totals(spark, f"{base}/ckpt").select("n_late")  # one row
    out = ss.read_intervals(spark, f"{base}/out").join(F.broadcast(late))
    number = F.coalesce("interval_no", F.lit(0)).alias("interval_no")
    return out.select("interval_id", number, "n_events", "n_lines", F.round("margin", 4).alias("margin"), "status", (F.col("n_empty") > 0).alias("empty"), "n_late")


@register("stream_ties")
def stream_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2/S3 contract, A3, q9: every event is sent twice at one millisecond, so only the arrival order tells the readings apart.
    The files come in two parts and the query is started anew for each, from its checkpoint."""
    raw = table(spark, sf_dir, "events")
    ev = iv.events_from_table(raw).withColumn("day", iv.interval_id(F.col("ts"), DAY))
    twice = F.array(*[F.struct(F.lit(i).alias("i"), fe.encode_event(F.col("ts"), F.col("sensor"), F.col("value") + i).alias("value")) for i in (0, 1)])
    base, files = scratch_dir(spark, "ties"), max(FILES_PER_CHUNK, spark.sparkContext.defaultParallelism)
    days = ev.agg(F.expr("(min(day) + max(day)) div 2").alias("middle")).first()  # one number
    end = ev.agg(F.max("ts").alias("ts")).select(fe.sentinel_line(F.col("ts")).alias("value"))

    def part(late: bool) -> DataFrame:
        dealt = ev.where((F.col("day") > days["middle"]) == late).repartitionByRange(files, "seq")
        return dealt.select("seq", F.explode(twice).alias("l")).select("seq", "l.i", "l.value").sortWithinPartitions("seq", "i").select("value")

    def collect(batch: DataFrame, batch_id: int) -> None:
        batch.where(F.col("kind") == keyed.READING).select("interval_id", "sensor", F.round("value", 5).alias("value"), F.col("n").alias("n_readings")) \
            .write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    for number, lot in enumerate([part(False), part(True), end, end]):  # the record's watermark holds from the batch after it on
        lot.write.text(f"{base}/in/{number:05d}")
        if number == 1:
            continue  # goes with the record
        closed = keyed.closed_intervals(placed_lines(spark, f"{base}/in"), n_sensors(raw), DAY, "1 day")
        w = closed.writeStream.outputMode("append").foreachBatch(collect).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
        keyed.with_store(spark, lambda: ss.start_with_state_partitions(w, spark, spark.sparkContext.defaultParallelism)).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("b")


@register("stream_rejects")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 reject path in streaming form: good and malformed lines of every event, counted by outcome.  Each micro-batch
    writes the counts so far below its own id (a replayed batch writes the same again); the last one is the answer."""
    raw = table(spark, sf_dir, "events")
    ev = raw.select(iv.utc_instant(raw, "ts").alias("ts"), (F.col("user_id") + 1).cast("int").alias("sensor"),
                    F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"), "props", "event_type")
    base = scratch_dir(spark, "rejects")
    line_kinds(ev).select("value").write.text(f"{base}/in")
    counts = ss.line_status_counts(text_stream(spark, f"{base}/in"), n_sensors(raw))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    writer = counts.writeStream.outputMode("complete").foreachBatch(per_batch).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    ss.start_with_state_partitions(writer, spark, spark.sparkContext.defaultParallelism).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, "batch_id", "left_semi").select("status", "n")


@register("stream_classify")
def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 + D4: image lines (form A) streamed, normalised with the fixed constants, classified
    by the nearest class mean fitted on the same normalised images; run totals."""
    e = table(spark, sf_dir, "embeddings")
    px = e.select("vec_id", "label", fi.quantize(F.transform("embedding", lambda x: x.cast("double"))).alias("pixels"))
    train = px.select("label", fi.normalise(F.col("pixels"), fi.CIFAR_MEAN, fi.CIFAR_STD).alias("features"))
    classes, cents = si.fitted_model_literals(om.class_means(train))
    base = scratch_dir(spark, "images")
    px.select(fi.encode_image_a(F.col("label"), F.col("pixels")).alias("value")).repartition(4) \
      .write.mode("overwrite").text(f"{base}/in")
    lines = text_stream(spark, f"{base}/in", max_files_per_trigger=1)
    q = si.start_image_classification(lines, classes, cents, f"{base}/out", f"{base}/ckpt", available_now=True,
                                      score=lambda x: om.nearest_mean_scores(x, F.lit(cents), DISTANCE_DECIMALS))
    q.awaitTermination()
    t = si.run_totals(spark, f"{base}/out")
    return t.select("n", "correct", F.round(F.lit(100.0) * F.col("correct") / F.col("n"), 4).alias("pct"))


@register("stream_count_windows")
def stream_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 on a stream: progress of each 100 images in arrival order, over two runs of one query."""
    e = table(spark, sf_dir, "embeddings")
    px = e.select("vec_id", "label", fi.quantize(F.transform("embedding", lambda x: x.cast("double"))).alias("pixels"))
    classes, cents = si.fitted_model_literals(om.class_means(px.select("label", fi.normalise(F.col("pixels"), fi.CIFAR_MEAN, fi.CIFAR_STD).alias("features"))))
    base, middle = scratch_dir(spark, "windows"), e.agg(F.expr("(min(vec_id) + max(vec_id)) div 2")).first()[0]  # one number
    for number, part in enumerate((px.where(F.col("vec_id") <= middle), px.where(F.col("vec_id") > middle))):
        lines = part.repartitionByRange(FILES_PER_CHUNK, "vec_id").sortWithinPartitions("vec_id").select(fi.encode_image_a(F.col("label"), F.col("pixels")).alias("value"))
        lines.write.text(f"{base}/in/{number:05d}")
        si.start_count_windows(placed_lines(spark, f"{base}/in"), classes, cents, PROGRESS_EVERY, f"{base}/out", f"{base}/ckpt",
                               score=lambda x: om.nearest_mean_scores(x, F.lit(cents), DISTANCE_DECIMALS)).awaitTermination()
    return si.count_window_report(spark, f"{base}/out").select("report_no", "images", "correct", F.round("pct", 4).alias("pct"))


def _sort_lines(spark: SparkSession, sf_dir: str) -> tuple[str, StreamingQuery]:
    """Sorts the disturbed lines by fate, a week per micro-batch; where they are, and the query."""
    raw = table(spark, sf_dir, "events")
    base = scratch_dir(spark, "letters")
    files = write_chunks(disturbed_lines(iv.events_from_table(raw)), f"{base}/in")
    q = start_line_sorting(text_stream(spark, f"{base}/in", files), n_sensors(raw), HOUR, DAY, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return f"{base}/out", q


@register("stream_dead_letters")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 and K3 on a stream: good lines and dead letters (rejected, late) in two tables, counted by reason."""
    out, _ = _sort_lines(spark, sf_dir)
    good = good_readings(spark, out).select(F.lit("good").alias("reason"))
    return good.unionByName(dead_letters(spark, out).select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("stream_run_report")
def stream_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11, T8 on a stream: the totals of a run from the rows that a listener writes per micro-batch."""
    with RunReport(spark) as report:
        _, q = _sort_lines(spark, sf_dir)
        report.wait_for(q)
    rows = report.batches().where(F.col("run_id") == str(q.runId))
    return rows.agg(F.count_if(F.col("n_rows") > 0).alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.sum("n_lines").alias("n_lines"), F.sum("n_rejected").alias("n_rejected"),
                    (F.sum("busy_ms") > 0).alias("busy"))


CHANNEL_MEANS, CHANNEL_STDS = (120.0, 122.0, 124.0, 126.0), (60.0, 62.0, 64.0, 66.0)
IDLE_REPORT = "spark.sql.streaming.noDataProgressEventInterval"


@register("stream_classify_bytes")
def stream_classify_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lines of form B, normalised per channel with fixed constants and classified by the
    class means as a network in Arrow batches; the stream ends at its first empty report.  One line in fifty is
    cut short and counted as rejected."""
    e = table(spark, sf_dir, "embeddings")
    px = e.select("vec_id", "label", fi.quantize(F.transform("embedding", lambda x: x.cast("double"))).alias("pixels"))

    def scale(x):
        return fi.normalise_channels(x, CHANNEL_MEANS, CHANNEL_STDS, IMAGE_HWC[2])

    classes, cents = om.fitted_model_literals(om.class_means(px.select("label", scale(F.col("pixels")).alias("features"))))
    net = network_udf(om.nearest_mean_predict_fn(cents, DISTANCE_DECIMALS), len(classes), (len(cents[0]),))
    line = fi.encode_image_b(F.col("label"), F.concat(fi.size_header(*CROP_HW), fi.to_signed_bytes(F.col("pixels"))))
    line = F.when(F.pmod("vec_id", F.lit(50)) == 7, F.substring_index(line, ",", 40)).otherwise(line)
    base = scratch_dir(spark, "image-bytes")
    px.select(line.alias("value")).write.text(f"{base}/in")
    before = spark.conf.get(IDLE_REPORT)
    spark.conf.set(IDLE_REPORT, "500ms")
    try:
        q = si.start_image_classification(text_stream(spark, f"{base}/in"), classes, cents, f"{base}/out", f"{base}/ckpt",
                                          processing_time="0 seconds", form=si.form_b, scale=scale, score=net)
    finally:
        spark.conf.set(IDLE_REPORT, before)
    ss.stop_when_idle(q, timeout=STREAM_TIMEOUT_S)
    t = si.run_totals(spark, f"{base}/out")
    return t.select("n", "correct", "rejected", F.round(F.lit(100.0) * F.col("correct") / F.col("n"), 4).alias("pct"))
