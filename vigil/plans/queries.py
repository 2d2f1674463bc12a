"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator group.

Every query reads the driver tables (or data Spark derives from them) in full.  Computed
columns carry the same names as in the oracle SQL (vigil/plans/oracle.py); doubles are
rounded where two engines may sum in a different order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import events as fe
from vigil.functions import images as fi
from vigil.functions import vectors as fv
from vigil.operators.models import training_status as om_status
from vigil.operators import events as oe
from vigil.operators import images as oi
from vigil.operators import intervals as iv
from vigil.operators import metrics as om
from vigil.operators import vectors as ov
from vigil.operators.blocks import BlockModel
from vigil.operators.scan import global_index, running_totals
from vigil.plans.common import (CROP_HW, CROP_OUT, DAY, HOUR, IMAGE_HWC, NEUTRAL, PROGRESS_EVERY,
                                REPLICAS, TOPK, EMB_WIDTH, GEN_SENSORS, FIRST_BATCH, n_sensors, stand_in_intercept, stand_in_model, table)
from vigil.session import materialize, scratch_dir
from vigil.sources.images import bytes_to_ints, byte_at, with_class_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _events(spark: SparkSession, sf_dir: str, seconds: float):
    raw = table(spark, sf_dir, "events")
    return raw, iv.with_interval(iv.events_from_table(raw), seconds)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as labelled float vectors (features ARRAY<DOUBLE>)."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    # the unrolled expressions assume the fixed width; a row of another width fails loudly
    return v.withColumn("features", F.when(F.size("features") == EMB_WIDTH, F.col("features"))
                        .otherwise(F.raise_error(F.lit(f"embedding width is not {EMB_WIDTH}"))))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings viewed as 0..255 images (64 pixels)."""
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", "label", fi.quantize(F.col("features")).alias("pixels"))


def line_kinds(ev: DataFrame) -> DataFrame:
    """Good and malformed wire lines derived from every event row: one scan, one generator
    (``explode`` of six (kind, line) pairs per row) - no union of six scans."""
    good = fe.encode_event(F.col("ts"), F.col("sensor"), F.col("value"))
    head3 = F.concat_ws(",", fe.format_ts_utc(F.col("ts")), F.col("sensor").cast("string"),
                        fe.sensor_name(F.col("sensor")))
    zero_based = fe.encode_event(F.col("ts"), F.col("sensor") - 1, F.col("value"))
    kinds = [
        ("event", good),
        ("props", F.col("props")),
        ("truncated", head3),
        ("trailing_empty", F.concat(head3, F.lit(","))),
        ("extra_field", F.concat(good, F.lit(","), F.col("event_type"))),
        ("zero_based", zero_based),
    ]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), line.alias("value")) for k, line in kinds])
    return ev.select("seq", F.explode(pairs).alias("p")).select("p.kind", "seq", "p.value")


# ------------------------------------------------------------------ sensor intervals
@register("interval_attention")
def interval_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 (T1 A3 T2 J3 T3 K4 T8): for each day, is attention needed?"""
    raw, ev = _events(spark, sf_dir, DAY)
    model = stand_in_model(n_sensors(raw))
    out = iv.score_intervals(ev, model, NEUTRAL)
    return out.select("interval_id", "interval_no", "n_events",
                      F.round("margin", 4).alias("margin"), "status")


@register("interval_attention_blocks")
def interval_attention_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 with the model as a table: the weights (w_s = s) are written as blocks of sensors, read back and joined by block."""
    raw, ev = _events(spark, sf_dir, DAY)
    n = n_sensors(raw)
    path = scratch_dir(spark, "weights")
    weights = spark.range(1, n + 1).select(F.col("id").alias("sensor"), F.col("id").cast("double").alias("weight"))
    BlockModel.write(weights, path, size=64)
    out = iv.score_intervals(ev, BlockModel.read(spark, path, stand_in_intercept(n)), NEUTRAL)
    return out.select("interval_id", "interval_no", "n_events", F.round("margin", 4).alias("margin"), "status")


@register("parse_events")
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 (P5 P10 P1): encode every event as a wire line and parse it back."""
    raw = table(spark, sf_dir, "events")
    lines = oe.encode_events(iv.events_from_table(raw))
    parsed = oe.parse_event_lines(lines, n_sensors(raw))
    return parsed.select(F.col("seq").alias("event_id"), "line", F.unix_millis("ts").alias("ts_ms"),
                         "sensor", "name", "value", "status")


@register("parse_rejects")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 (P1 reject path): well-formed and malformed lines, counted by outcome."""
    raw = table(spark, sf_dir, "events")
    ev = raw.select(iv.utc_instant(raw, "ts").alias("ts"), (F.col("user_id") + 1).cast("int").alias("sensor"),
                    F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"),
                    "props", "event_type")
    parsed = oe.parse_event_lines(line_kinds(ev), n_sensors(raw))
    return parsed.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@register("last_per_sensor_interval")
def last_per_sensor_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 (A3): last reading of each sensor in each day."""
    _, ev = _events(spark, sf_dir, DAY)
    return iv.last_per_sensor(ev).select("interval_id", "sensor", "value", "n_readings")


@register("interval_counts")
def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 (A1 A2 T8): readings per hour with running totals."""
    _, ev = _events(spark, sf_dir, HOUR)
    c = iv.interval_counts(ev).withColumn("one", F.lit(1).cast("long"))
    cum = running_totals(c, "interval_id", ["n_events", "one"])
    return cum.select("interval_id", "n_events", F.col("n_events_cum").alias("events_cum"),
                      F.col("one_cum").alias("interval_no"))


@register("empty_intervals")
def empty_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 (T7): every hour between the first and last reading, empty ones flagged."""
    _, ev = _events(spark, sf_dir, HOUR)
    return iv.interval_spine(iv.interval_counts(ev))


@register("run_summary")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7 (A10 A11): run totals and throughput over hourly intervals."""
    _, ev = _events(spark, sf_dir, HOUR)
    s = iv.run_summary(ev, HOUR)
    return s.select("n_intervals", "n_empty", "n_events", F.round("span_seconds", 3).alias("span_seconds"),
                    "active_seconds", F.round("events_per_sec", 6).alias("events_per_sec"))


@register("sensor_state_daily")
def sensor_state_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 as a readable grid: every sensor's value at the end of each day, by a point-in-range join."""
    _, ev = _events(spark, sf_dir, HOUR)
    last = materialize(iv.last_per_sensor(ev))
    hours = DAY // HOUR
    days = last.agg((F.min("interval_id") - F.pmod(F.min("interval_id"), F.lit(hours))).alias("lo"), F.max("interval_id").alias("hi"))
    asked = days.select(F.explode(F.sequence(F.col("lo") + hours - 1, F.col("hi") + hours - 1, F.lit(hours).cast("long"))).alias("hour"))
    state = iv.state_at(iv.validity_ranges(last), asked, "hour", NEUTRAL)
    return state.select(F.expr(f"hour div {hours}").alias("day"), "sensor", "value", F.coalesce(F.col("hour") - F.col("since"), F.lit(-1)).alias("hours_old"))


@register("carry_forward")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 (T2): the carry-forward state as validity ranges per sensor (daily intervals)."""
    _, ev = _events(spark, sf_dir, DAY)
    return iv.validity_ranges(iv.last_per_sensor(ev))


@register("sentinel_split")
def sentinel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 (P8): the event lines plus the end-of-stream record; data vs control per day."""
    raw = table(spark, sf_dir, "events")
    ev = iv.events_from_table(raw)
    lines = oe.encode_events(ev).select("value")
    end = ev.agg(F.max("ts").alias("ts")).select(fe.sentinel_line(F.col("ts")).alias("value"))
    parsed = oe.parse_event_lines(lines.unionByName(end), n_sensors(raw))
    parsed = parsed.withColumn("interval_id", iv.interval_id(F.col("ts"), DAY))
    return parsed.groupBy("interval_id").agg(
        F.sum((F.col("status") == fe.OK).cast("long")).alias("n_data"),
        F.sum((F.col("status") == fe.CONTROL).cast("long")).alias("n_control"),
        F.max((F.col("status") == fe.CONTROL)).alias("last_interval"))


# ------------------------------------------------------------------ vectors
@register("weighted_score")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 (V1): sum_s x_s * (s+1) per vector."""
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.round(fv.weighted_score(F.col("features"), width=EMB_WIDTH), 6).alias("score"))


@register("threshold_label")
def threshold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11 (V2 A8): label = score > 0, then the positive count and percent."""
    v = _vectors(spark, sf_dir)
    lab = v.select(fv.threshold_label(fv.weighted_score(F.col("features"), width=EMB_WIDTH), 0.0).alias("label"))
    s = ov.label_stats(lab)
    return s.select("n", "n_ones", F.round("pct_ones", 6).alias("pct_ones"))


@register("score_cutoffs")
def score_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12 (O1 O2 A7): empirical cutoff table of the embedding scores."""
    v = _vectors(spark, sf_dir)
    sc = v.select(fv.weighted_score(F.col("features"), width=EMB_WIDTH).alias("score"))
    return ov.score_cutoffs(sc).select("pct", F.round("cutoff", 6).alias("cutoff"))


@register("event_value_cutoffs")
def event_value_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 O2 A7 on a column of many ties: the cutoff table of the event values, rounded to whole numbers."""
    values = table(spark, sf_dir, "events").select(F.round(F.col("value").cast("double")).alias("score"))
    return ov.score_cutoffs(values)


@register("encode_vector")
def encode_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 (P6 P2): vectors to ``%.5f`` CSV lines and back."""
    v = _vectors(spark, sf_dir)
    lines = v.select("vec_id", fv.encode_vector(F.col("label"), F.col("features")).alias("line"))
    arr = fv.parse_training_array(F.col("line"))
    return lines.select("vec_id", "line", F.size(arr).alias("n_fields"),
                        fv.training_label(arr).alias("label"),
                        F.round(fv.vector_sum(fv.training_features(arr)), 5).alias("feature_sum"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return ov.generate_vectors(keys, "k", n=GEN_SENSORS, seed=42)


@register("generate_vectors")
def generate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q30 (V4 V1 V2 V3): one 10-sensor training vector per lineitem row, labelled by the
    default cutoff; label statistics."""
    g = _generated(spark, sf_dir)
    return g.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.min("score"), 6).alias("min_score"),
        F.round(F.max("score"), 6).alias("max_score"),
        F.round(F.sum(F.get(F.col("features"), 0)), 4).alias("sum_first"))


@register("generated_cutoffs")
def generated_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12 on generated vectors: the cutoff table of 10-sensor uniform scores."""
    g = _generated(spark, sf_dir)
    return ov.score_cutoffs(g.select("score")).select("pct", F.round("cutoff", 6).alias("cutoff"))


# ------------------------------------------------------------------ images
@register("global_mean_std")
def global_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14 (V6)."""
    m = oi.pixel_moments(_vectors(spark, sf_dir), "features")
    return m.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@register("scalar_normalise")
def scalar_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15 (V6 V5): normalise by the set's mean and std; position-weighted sum per vector."""
    n = oi.normalise_by_moments(_vectors(spark, sf_dir), "features")
    return n.select("vec_id", F.round(fv.weighted_score(F.col("normalised")), 4).alias("norm_sum"))


@register("fixed_normalise")
def fixed_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with the fixed CIFAR10 constants on 0..255 pixels; position-weighted sum per image."""
    p = _pixels(spark, sf_dir)
    return p.select("vec_id", F.round(fv.weighted_score(fi.normalise(F.col("pixels"), fi.CIFAR_MEAN, fi.CIFAR_STD)), 6)
                    .alias("norm_sum"))


@register("mean_vector_subtract")
def mean_vector_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16 (V7 V8): pixels / 255, minus the per-position mean image."""
    p = _pixels(spark, sf_dir).withColumn("scaled", fi.scale_255(F.col("pixels")))
    c = oi.subtract_mean_image(p, "scaled")
    return c.select("vec_id", F.round(fv.weighted_score(F.col("centred")), 6).alias("centred_sum"),
                    F.round(F.get(F.col("centred"), 0), 6).alias("centred_first"))


@register("channel_normalise")
def channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17 (V9): 4x4x4 HWC images, per-channel (x - mean_c) / std_c."""
    c = IMAGE_HWC[2]
    n = oi.normalise_by_channel(_pixels(spark, sf_dir), c, "pixels")
    return n.select("vec_id", F.round(fv.weighted_score(F.col("normalised")), 4).alias("norm_sum"),
                    F.round(F.get(F.col("normalised"), 1), 6).alias("norm_second"))


@register("center_crop")
def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18 (V10 V12): 8x8x1 images cropped to the centre 6x6; misfits keep a row and their status."""
    h, w = CROP_HW
    oh, ow = CROP_OUT
    status = fi.shape_status(F.col("pixels"), h, w, 1)
    p = _pixels(spark, sf_dir).withColumn("status", status)
    cr = F.when(F.col("status") == "ok", fi.center_crop(F.col("pixels"), h, w, 1, oh, ow))
    return p.select("vec_id", "status", F.size(cr).alias("n_pixels"),
                    F.aggregate(cr, F.lit(0).cast("long"), lambda a, x: a + x).alias("pixel_sum"),
                    F.get(cr, 0).alias("first_pixel"))


def _checksum(arr):
    return F.aggregate(F.transform(arr, lambda x, i: x.cast("long") * (i + 1).cast("long")),
                       F.lit(0).cast("long"), lambda a, x: a + x)


@register("layout_reorder")
def layout_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19 (V11 V12): planar 4 x (4x4) -> interleaved, channels reversed."""
    h, w, c = IMAGE_HWC
    p = _pixels(spark, sf_dir)
    il = fi.planar_to_interleaved(F.col("pixels"), h, w, c)
    return p.select("vec_id", _checksum(il).alias("checksum"),
                    F.array_join(F.slice(il, 1, 8), ",").alias("head"))


@register("image_line_roundtrip")
def image_line_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q26 (P3 P4 P7 P9 V13): images to line form A, parsed, re-sent as form B (1-based
    label, size header, signed bytes) and parsed again."""
    p = _pixels(spark, sf_dir)
    line_a = fi.encode_image_a(F.col("label"), F.col("pixels"))
    a = p.select("vec_id", line_a.alias("line_a"))
    pa = fi.parse_image_a(F.col("line_a"))
    a = a.select("vec_id", "line_a", pa["label"].alias("label_a"), pa["pixels"].alias("px_a"))
    h, w = CROP_HW
    body = F.concat(fi.size_header(h, w), fi.to_signed_bytes(F.col("px_a")))
    b = a.withColumn("line_b", fi.encode_image_b(F.col("label_a"), body))
    pb = fi.parse_image_b(F.col("line_b"))
    px_b = fi.unsigned(fi.strip_header(pb["bytes"]))
    return b.select(
        "vec_id", "label_a", (pb["label"] - 1).cast("int").alias("label_b"),
        F.size("px_a").alias("n_a"), F.size(px_b).alias("n_b"),
        F.round(fv.vector_sum(F.col("px_a")), 1).alias("sum_a"), F.round(fv.vector_sum(px_b), 1).alias("sum_b"),
        F.length("line_a").alias("len_a"), F.length("line_b").alias("len_b"))


@register("binary_image_records")
def binary_image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q27 (S5 V13 V11): images packed as binary records (label byte + planar bytes),
    decoded back to interleaved pixels."""
    h, w, c = IMAGE_HWC
    p = _pixels(spark, sf_dir)
    hexed = F.concat(F.lpad(F.hex(F.col("label")), 2, "0"),
                     F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    rec = p.select("vec_id", F.unhex(hexed).alias("data"))
    planar = bytes_to_ints(F.col("data"), 1, h * w * c)
    il = fi.planar_to_interleaved(planar, h, w, c, reverse_channels=False)
    return rec.select("vec_id", byte_at(F.col("data"), 0).alias("label"), F.length("data").alias("n_bytes"),
                      F.aggregate(il, F.lit(0).cast("long"), lambda a, x: a + x).alias("pixel_sum"),
                      _checksum(il).alias("checksum"))


# ------------------------------------------------------------------ classification reports
DISTANCE_DECIMALS = 4  # distances are rounded so that engines, which sum in different orders, agree on ties


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return om.predict_nearest_mean(v, om.class_means(v), decimals=DISTANCE_DECIMALS)


@register("classify_accuracy")
def classify_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20 (D3 D5 V14 A4 A5): nearest-class-mean classifier; accuracy."""
    pred = _predictions(spark, sf_dir)
    return om.accuracy(pred).select("n", "correct", F.round("pct", 4).alias("pct"))


@register("classify_accuracy_udf")
def classify_accuracy_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 through the network plug-in: the fitted class means run as a numpy network inside
    ``predict_batch_udf`` (Arrow batches of 256 rows, loader once per Python worker); same
    result as ``classify_accuracy``."""
    from vigil.operators.models import network_udf
    v = _vectors(spark, sf_dir)
    classes, cents = om.fitted_model_literals(om.class_means(v))
    net = network_udf(om.nearest_mean_predict_fn(cents, DISTANCE_DECIMALS), len(classes), (EMB_WIDTH,), batch_size=256)
    pred = v.select("label", net(F.col("features")).alias("scores"))
    pred = pred.select("label", F.get(F.lit(classes), fi.argmax(F.col("scores"))).alias("predict"))
    return om.accuracy(pred).select("n", "correct", F.round("pct", 4).alias("pct"))


@register("topk_accuracy")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q21 (A6 O3): top-1 and top-5 accuracy."""
    pred = _predictions(spark, sf_dir)
    t = om.topk_accuracy(pred, F.col("classes"), (1, TOPK))
    return t.select("n", F.round("acc1", 4).alias("acc1"), F.round(f"acc{TOPK}", 4).alias("acc5"))


@register("first_batch_topk")
def first_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 + A6: top-1 / top-5 accuracy on the first batch of 256 images (vec_id order), the
    sample the single-machine loop reports; an error if the set is smaller than one batch."""
    pred = _predictions(spark, sf_dir)
    head = om.first_batch(pred, "vec_id", FIRST_BATCH)
    t = om.topk_accuracy(head, F.col("classes"), (1, TOPK))
    return t.select("n", F.round("acc1", 4).alias("acc1"), F.round(f"acc{TOPK}", 4).alias("acc5"))


@register("topk_classes")
def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the five best classes of every image, best first."""
    best = F.transform(fi.topk_classes(F.col("scores"), TOPK), lambda i: F.get(F.col("classes"), i).cast("string"))
    return _predictions(spark, sf_dir).select("vec_id", F.array_join(best, ",").alias("best"))


@register("class_counts")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22 (A9)."""
    return om.class_counts(table(spark, sf_dir, "embeddings"))


@register("count_window_progress")
def count_window_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q23 (A13): cumulative accuracy reported every 100 images in vec_id order."""
    pred = _predictions(spark, sf_dir)
    p = om.count_window_progress(pred, "vec_id", PROGRESS_EVERY)
    return p.select("report_no", "images", "correct", F.round("pct", 4).alias("pct"))


@register("replicate")
def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24 (U1): the set five times over; per copy counts."""
    e = table(spark, sf_dir, "embeddings")
    r = oi.replicate(e.select("vec_id", "label"), REPLICAS)
    return r.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("label_sum"))


@register("replay")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of 2.5 x n rows replaying the set with wrap-around; rows per source."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1))).first()[0]
    total = (5 * n) // 2
    idx = global_index(e.select("vec_id", "label"), ["vec_id"])
    r = oi.replay(idx, "idx", total, n)
    return r.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"), F.min("i").alias("first_i"))


@register("label_rank")
def label_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25 (S6 O5 J2): class names -> 1-based rank of the sorted distinct names, joined back."""
    ev = table(spark, sf_dir, "events").select("event_type")
    r = with_class_rank(ev, "event_type", "label")
    return r.groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ model training
@register("lr_train_predict")
def lr_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q28 (V4 P6 K1 S1 P2 D1 K2 S7 D2): generate labelled 10-sensor vectors from every
    lineitem row, write them as CSV text, read them back, train the logistic regression
    (L-BFGS, no intercept), save and reload it, and score the training set.  L-BFGS is not
    SQL-expressible, so this query has no oracle (row-count check only)."""
    from vigil.operators import models as om_
    from vigil.session import scratch_dir
    from vigil.sinks import write_lines
    from vigil.sources.lines import read_lines

    g = _generated(spark, sf_dir)
    base = scratch_dir(spark, "lr")
    write_lines(g, fv.encode_vector(F.col("label"), F.col("features"), width=GEN_SENSORS), f"{base}/train")
    train = om_.training_frame(read_lines(spark, f"{base}/train"), GEN_SENSORS)
    model = om_.train_lr(train)
    om_.save_model(model, f"{base}/model")
    loaded = om_.load_model(f"{base}/model")
    pred = om_.predict_lr(loaded, train)
    acc = om.accuracy(pred.select("label", F.col("prediction").alias("predict")))
    return acc.select("n", "correct", F.round("pct", 4).alias("pct"),
                      F.lit(len(loaded.coefficients)).alias("n_coefficients"))


@register("parse_training_status")
def parse_training_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines of the embeddings, some with a field that is no number and some cut short, by status."""
    v = _vectors(spark, sf_dir)
    line = fv.encode_vector(F.col("label"), F.col("features"))
    kind = F.pmod(F.col("vec_id"), F.lit(10))
    line = F.when(kind == 3, F.concat(line, F.lit(",x"))).when(kind == 6, F.substring_index(line, ",", 5)).otherwise(line)
    return om_status(v.select(line.alias("value")), EMB_WIDTH)
