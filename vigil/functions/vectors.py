"""Labelled training vectors: CSV text <-> arrays, weighted score, threshold label, cutoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_FORMAT = "%.5f"  # fixed value: every field of a training line is written with 5 decimals

# Widths up to this many values are unrolled into plain column arithmetic (whole-stage
# codegen, ~10x faster than an interpreted lambda); wider vectors use higher-order functions.
UNROLL_MAX = 256


def parse_training_array(line: Column) -> Column:
    """All fields to double (null when a field is not numeric)."""
    return F.transform(F.split(line, ",", -1), lambda x: x.try_cast("double"))


def training_label(arr: Column) -> Column:
    return F.get(arr, 0)


def training_features(arr: Column) -> Column:
    return F.slice(arr, 2, F.size(arr) - 1)


def fixed5(x: Column) -> Column:
    """``%.5f`` text of a number without ``java.util.Formatter`` (about 2x faster): a cast to
    DECIMAL(38,5) rounds half-up on the decimal form exactly as ``format_string`` does; the
    sign of a negative value that rounds to zero is kept, and values a decimal cannot hold
    (NaN, infinities, |x| >= 1e33) fall back to ``format_string``."""
    v = x.cast("double")
    d = v.try_cast("decimal(38,5)")
    txt = d.cast("string")
    txt = F.when((v < 0) & (d == 0), F.concat(F.lit("-"), txt)).otherwise(txt)
    return F.coalesce(txt, F.format_string(VALUE_FORMAT, v))


def _of_width(features: Column, width: int, value: Column) -> Column:
    """``value`` where the vector has ``width`` values (or is null), else an error."""
    wrong = F.size(features) != width
    return F.when(features.isNotNull() & wrong, F.raise_error(F.lit(f"a vector does not have {width} values"))).otherwise(value)


def encode_vector(label: Column, features: Column, width: int | None = None) -> Column:
    """``label,v1,...,vn`` with ``%.5f`` fields (unrolled when ``width`` is given; a vector of
    another width is an error)."""
    if width is not None and width <= UNROLL_MAX:
        return F.concat_ws(",", fixed5(_of_width(features, width, label)), *[fixed5(F.get(features, i)) for i in range(width)])
    return F.concat_ws(",", fixed5(label), F.array_join(F.transform(features, fixed5), ","))


def weighted_score(features: Column, first_weight: int = 1, width: int | None = None) -> Column:
    """V1: sum_s x_s * (s + first_weight), s from 0.  first_weight=1 gives weights 1..n;
    first_weight=2 gives 2..n+1.  Pass ``width`` when every vector has that many values to get
    the unrolled (codegen) form; a vector of another width is an error."""
    if width is not None and width <= UNROLL_MAX:
        terms = [F.get(features, s).cast("double") * F.lit(float(s + first_weight)) for s in range(width)]
        total = _of_width(features, width, terms[0])
        for t in terms[1:]:
            total = total + t
        return total
    weighted = F.transform(features, lambda x, i: x.cast("double") * (i + F.lit(first_weight)).cast("double"))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def threshold_label(score: Column, cutoff: float | Column) -> Column:
    """V2: strict ``score > cutoff`` -> 1 else 0 (a tie is 0)."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return (score > c).cast("int")


def default_cutoff(n_sensors: int) -> float:
    """V3: the median score of n uniform [0,1) values with weights 1..n: .25 n (n+1)."""
    return 0.25 * n_sensors * (n_sensors + 1)


def vector_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
