"""Image arrays and sources."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from vigil.functions import images as fi
from vigil.operators import images as oi
from vigil.sources import images as si


def test_parse_form_a_ints_and_floats(spark):
    df = spark.createDataFrame([("71 2 3 4",), ("3-0.12 0.5 -1.25",)], "value string")
    p = fi.parse_image_a(F.col("value"))
    rows = df.select(p["label"].alias("l"), p["pixels"].alias("p")).collect()
    assert rows[0]["l"] == 7 and rows[0]["p"] == [1.0, 2.0, 3.0, 4.0]
    assert rows[1]["l"] == 3 and rows[1]["p"] == [-0.12, 0.5, -1.25]


def test_encode_form_a_has_no_delimiter_after_label(spark):
    df = spark.createDataFrame([(6, [59, 62, 63])], "label int, px array<int>")
    assert df.select(fi.encode_image_a(F.col("label"), F.col("px"))).first()[0] == "659 62 63"


def test_form_b_roundtrip_with_header(spark):
    df = spark.createDataFrame([(2, [0, 127, 128, 255])], "label int, px array<int>")
    body = F.concat(fi.size_header(32, 32), fi.to_signed_bytes(F.col("px")))
    line = df.select(fi.encode_image_b(F.col("label"), body).alias("v")).first()["v"]
    assert line == "3.0,0,0,0,32,0,0,0,32,0,127,-128,-1"
    p = fi.parse_image_b(F.lit(line))
    r = df.select((p["label"] - 1).alias("l"), fi.unsigned(fi.strip_header(p["bytes"])).alias("px")).first()
    assert r["l"] == 2 and r["px"] == [0.0, 127.0, 128.0, 255.0]


def test_crop_layout_argmax(spark):
    img = list(range(16))  # 4x4x1
    df = spark.createDataFrame([(img,)], "p array<int>")
    assert df.select(fi.center_crop(F.col("p"), 4, 4, 1, 2, 2)).first()[0] == [5, 6, 9, 10]
    planar = [1, 2, 3, 4, 10, 20, 30, 40, 100, 200, 300, 400]  # c=3 planes of 2x2
    df2 = spark.createDataFrame([(planar,)], "p array<int>")
    assert df2.select(fi.planar_to_interleaved(F.col("p"), 2, 2, 3)).first()[0] == [
        100, 10, 1, 200, 20, 2, 300, 30, 3, 400, 40, 4]
    s = spark.createDataFrame([([0.1, 0.9, 0.9, 0.2],)], "s array<double>")
    r = s.select(fi.argmax(F.col("s")).alias("a"), fi.topk_classes(F.col("s"), 3).alias("t"),
                 fi.rank_of(F.col("s"), F.lit(2)).alias("r")).first()
    assert r["a"] == 1 and r["t"] == [1, 2, 3] and r["r"] == 2


def test_normalise_channels_and_moments(spark):
    rng = np.random.default_rng(5)
    imgs = rng.integers(0, 256, (20, 2 * 2 * 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(imgs)], "id int, pixels array<double>")
    m = oi.pixel_moments(df).first()
    assert abs(m["mean"] - imgs.mean()) < 1e-9 and abs(m["std"] - imgs.std()) < 1e-9
    got = np.array([r["normalised"] for r in oi.normalise_by_channel(df, 3).orderBy("id").collect()])
    ch = imgs.reshape(20, 4, 3)
    exp = ((ch - ch.mean(axis=(0, 1))) / ch.std(axis=(0, 1))).reshape(20, 12)
    assert np.allclose(got, exp)
    centred = np.array([r["centred"] for r in oi.subtract_mean_image(df).orderBy("id").collect()])
    assert np.allclose(centred, imgs - imgs.mean(axis=0))


def test_replicate_and_replay(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "idx long")
    assert oi.replicate(df, 5).count() == 35
    r = oi.replay(df, "idx", 17, 7).select("idx", "i").collect()
    assert sorted(x["i"] for x in r) == list(range(17))
    assert all(x["i"] % 7 == x["idx"] for x in r)


def test_binary_records_file(spark):
    d = tempfile.mkdtemp(prefix="vigil-rec-")
    rng = np.random.default_rng(6)
    recs = [(int(rng.integers(0, 10)), rng.integers(0, 256, 12, dtype=np.uint8)) for _ in range(5)]
    with open(os.path.join(d, "batch.bin"), "wb") as fh:
        for label, px in recs:
            fh.write(bytes([label]) + px.tobytes())
    df = si.binary_records(spark, d, 13)
    dec = si.decode_planar_record(F.col("data"), 2, 2, 3)
    got = df.select("record", dec["label"].alias("label"), dec["planar"].alias("px")).orderBy("record").collect()
    assert [(r["label"], r["px"]) for r in got] == [(lab, px.tolist()) for lab, px in recs]
    split = si.binary_records(spark, d, 13, splittable=True)
    got2 = sorted((r["label"], r["px"]) for r in split.select(dec["label"].alias("label"), dec["planar"].alias("px")).collect())
    assert got2 == sorted((lab, px.tolist()) for lab, px in recs)


def test_labelled_folder(spark):
    d = tempfile.mkdtemp(prefix="vigil-folder-")
    for cls, files in {"n02": ["a.jpg", "b.jpg"], "n01": ["c.jpg"], "n10": ["d.jpg"]}.items():
        os.makedirs(os.path.join(d, cls))
        for f in files:
            with open(os.path.join(d, cls, f), "wb") as fh:
                fh.write(b"x" * 3)
    got = {r["image_name"]: r["label"] for r in si.labelled_folder(spark, d).collect()}
    assert got == {"c.jpg": 1.0, "a.jpg": 2.0, "b.jpg": 2.0, "d.jpg": 3.0}


def test_binary_records_empty_and_partial_files(spark):
    d = tempfile.mkdtemp(prefix="vigil-rec-empty-")
    open(os.path.join(d, "empty.bin"), "wb").close()
    with open(os.path.join(d, "one.bin"), "wb") as fh:
        fh.write(bytes([3]) + bytes(range(12)) + b"\x01\x02")  # one record plus a short tail
    got = si.binary_records(spark, d, 13).collect()
    assert len(got) == 1 and got[0]["data"][0] == 3


def test_moments_of_large_values_and_mixed_sizes(spark):
    rows = [[1e9 + 0.5, 1e9 - 0.5], [1e9 + 1.0, 1e9, 1e9 - 1.0, 1e9], []]
    df = spark.createDataFrame([(r,) for r in rows], "pixels array<double>")
    m = oi.pixel_moments(df).first()
    flat = np.concatenate(rows)
    assert m["n"] == 6 and abs(m["mean"] - flat.mean()) < 1e-6 and abs(m["std"] - flat.std()) < 1e-6


def test_shape_status(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2],), ([1, None, 3, 4],), (None,)], "p array<int>")
    assert [r[0] for r in df.select(fi.shape_status(F.col("p"), 2, 2, 1)).collect()] == ["ok", "bad_shape", "bad_shape", "bad_shape"]
