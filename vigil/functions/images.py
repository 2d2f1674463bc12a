"""Image arrays as flat columns: parsing the wire forms, encoding, normalising, cropping,
re-laying out, argmax / top-k.  Images are flat ``ARRAY<DOUBLE>`` (or INT) in HWC order plus
their (h, w, c) dims, so every operation is a higher-order array expression (no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CIFAR10 training-set pixel mean and standard deviation used by the
# streaming classifier's scalar normalisation, and the 8-byte size header of the
# comma-separated byte form (two big-endian ints: rows, cols).
CIFAR_MEAN = 120.70756512369792
CIFAR_STD = 64.1500758911213
HEADER_BYTES = 8


# ---------------------------------------------------------------- wire forms
def parse_image_a(line: Column) -> dict[str, Column]:
    """P3, form A: one label character, then whitespace-separated numbers (ints or floats,
    possibly negative) with no delimiter after the label."""
    body = F.trim(F.substring(line, 2, 1 << 30))
    return {
        "label": F.substring(line, 1, 1).try_cast("int"),
        "pixels": F.transform(F.split(body, r"\s+"), lambda x: x.try_cast("double")),
    }


def encode_image_a(label: Column, pixels: Column, as_int: bool = True) -> Column:
    """P7, form A: label digit + space-joined pixels (``%d`` or ``%f``)."""
    fmt = "%d" if as_int else "%f"
    cast = "long" if as_int else "double"
    body = F.array_join(F.transform(pixels, lambda x: F.format_string(fmt, x.cast(cast))), " ")
    return F.concat(label.cast("string"), body)


def parse_image_b(line: Column) -> dict[str, Column]:
    """P4, form B: ``<label>.0,b0,b1,...``: text before the first comma is a float label
    (1-based), the rest are signed bytes."""
    rest = F.substring(line, F.length(F.substring_index(line, ",", 1)) + 2, 1 << 30)
    return {
        "label": F.substring_index(line, ",", 1).try_cast("double"),
        "bytes": F.transform(F.split(rest, ","), lambda x: x.try_cast("tinyint")),
    }


def encode_image_b(label0: Column, signed_bytes: Column) -> Column:
    """P7, form B: 1-based float label (P9), then the comma-joined signed bytes."""
    return F.concat(F.format_string("%.1f", (label0 + 1).cast("double")), F.lit(","),
                    F.array_join(F.transform(signed_bytes, lambda b: b.cast("string")), ","))


def to_signed_bytes(pixels: Column) -> Column:
    """0..255 ints -> signed bytes (the JVM byte view)."""
    return F.transform(pixels, lambda x: (F.pmod(x.cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def unsigned(bytes_: Column) -> Column:
    """Signed byte -> 0..255 as double."""
    return F.transform(bytes_, lambda b: F.pmod(b.cast("int"), F.lit(256)).cast("double"))


def size_header(h: int, w: int) -> Column:
    """The 8 header bytes: rows and cols as big-endian 32-bit ints."""
    def be(v: int) -> list[int]:
        return [(v >> s) & 0xFF for s in (24, 16, 8, 0)]
    return F.array(*[F.lit(b).cast("tinyint") for b in be(h) + be(w)])


def strip_header(bytes_: Column) -> Column:
    return F.slice(bytes_, HEADER_BYTES + 1, 1 << 30)


# ---------------------------------------------------------------- pixel maths
def quantize(values: Column, lo: float = -0.5, hi: float = 0.5) -> Column:
    """Map floats in [lo, hi] to 0..255 ints (clamped) - used to view vectors as images."""
    scale = 255.0 / (hi - lo)
    return F.transform(values, lambda x: F.least(F.greatest(F.round((x.cast("double") - F.lit(lo)) * F.lit(scale)),
                                                             F.lit(0.0)), F.lit(255.0)).cast("int"))


def scale_255(pixels: Column) -> Column:
    """V7: pixel / 255."""
    return F.transform(pixels, lambda x: x.cast("double") / F.lit(255.0))


def normalise(pixels: Column, mean: float | Column, std: float | Column) -> Column:
    """V5: (x - mean) / std with one scalar mean and std."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = std if isinstance(std, Column) else F.lit(float(std))
    return F.transform(pixels, lambda x: (x.cast("double") - m) / s)


def normalise_channels(pixels: Column, means: Sequence[float] | Column, stds: Sequence[float] | Column,
                       channels: int) -> Column:
    """V9: per-channel (x - mean_c) / std_c on an HWC image; c = index mod channels."""
    m = means if isinstance(means, Column) else F.array(*[F.lit(float(v)) for v in means])
    s = stds if isinstance(stds, Column) else F.array(*[F.lit(float(v)) for v in stds])
    return F.transform(pixels, lambda x, i: (x.cast("double") - F.get(m, F.pmod(i, F.lit(channels))))
                       / F.get(s, F.pmod(i, F.lit(channels))))


def subtract(pixels: Column, other: Column) -> Column:
    """V8 (apply): element-wise x - mean_image."""
    return F.zip_with(pixels, other, lambda a, b: a.cast("double") - b.cast("double"))


def crop(pixels: Column, h: int, w: int, c: int, top: int, left: int, out_h: int, out_w: int) -> Column:
    """Keep rows [top, top+out_h) and cols [left, left+out_w) of an HWC image."""
    def keep(x, i):
        row = F.floor(i / F.lit(w * c))
        col = F.pmod(F.floor(i / F.lit(c)), F.lit(w))
        return (row >= top) & (row < top + out_h) & (col >= left) & (col < left + out_w)
    return F.filter(pixels, keep)


def center_crop(pixels: Column, h: int, w: int, c: int, out_h: int, out_w: int) -> Column:
    return crop(pixels, h, w, c, (h - out_h) // 2, (w - out_w) // 2, out_h, out_w)


def planar_to_interleaved(pixels: Column, h: int, w: int, c: int, reverse_channels: bool = True) -> Column:
    """Planar (c, h, w) -> interleaved (h, w, c); with ``reverse_channels`` RGB becomes BGR."""
    hw = h * w

    def src(j):
        p = F.floor(j / F.lit(c))
        ch = F.pmod(j, F.lit(c))
        if reverse_channels:
            ch = F.lit(c - 1) - ch
        return F.get(pixels, (ch * F.lit(hw) + p).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(h * w * c - 1)), src)


def is_shape(pixels: Column, h: int, w: int, c: int) -> Column:
    """A flat image is valid for (h, w, c) when it has h*w*c values, none null."""
    return (F.size(pixels) == h * w * c) & ~F.exists(pixels, lambda x: x.isNull())


def shape_status(pixels: Column, h: int, w: int, c: int) -> Column:
    """V12 as a status: ``ok``, or ``bad_shape`` for a null or misfit image."""
    return F.when(pixels.isNotNull() & is_shape(pixels, h, w, c), "ok").otherwise("bad_shape")


def argmax(scores: Column) -> Column:
    """0-based index of the largest score; the lowest index wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def topk_classes(scores: Column, k: int) -> Column:
    """O3: the k best class indices (0-based), score descending, lower index first on ties."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("cls")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["cls"])


def rank_of(scores: Column, cls: Column) -> Column:
    """1-based rank of class ``cls`` by score (descending, lower index first on ties)."""
    mine = F.get(scores, cls)
    better = F.filter(scores, lambda s, i: (s > mine) | ((s == mine) & (i < cls)))
    return F.size(better) + 1
