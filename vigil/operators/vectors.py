"""Labelled sensor vectors: deterministic distributed generation, labelling, the empirical
score-cutoff table and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import vectors as fv
from vigil.operators.quantiles import values_at

# Fixed values of the integer hash behind the generator: multiply-add steps mod 2^31 with
# xor-shift mixing in between (affine steps alone would leave the values of one row in an
# arithmetic progression).  Every product fits in a signed 64-bit integer, so DuckDB can
# repeat the numbers exactly.
MUL = 1103515245
ADD = 12345
MOD31 = 2147483648


def _mix(x: Column, shift: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, shift))


def _step(x: Column) -> Column:
    return F.pmod(x * F.lit(MUL) + F.lit(ADD), F.lit(MOD31))


def key_mix(key: Column) -> Column:
    """Fold a 64-bit row key into 31 bits (computed once per row)."""
    return F.pmod(key.cast("long"), F.lit(MOD31)).bitwiseXOR(F.shiftright(key.cast("long"), 31))


def uniform(key: Column, s: Column, seed: int, mixed: Column | None = None) -> Column:
    """Uniform [0, 1) from (row key, sensor index, seed) - the same number on every run and
    every partitioning (``rand(seed)`` depends on the partition layout).  ``mixed`` may pass a
    column that already holds ``key_mix(key)``."""
    k = mixed if mixed is not None else key_mix(key)
    x = F.pmod(k * F.lit(MUL) + s.cast("long") * F.lit(ADD) + F.lit(int(seed)), F.lit(MOD31))
    # two xor-shift rounds: each doubles the expression tree, so the count stays small
    x = _mix(_step(_mix(_step(x), 16)), 13)
    return x.cast("double") / F.lit(float(MOD31))


# Vectors up to this width get one generated expression per value (fastest once compiled);
# wider ones use one lambda over the index sequence, whose compile cost does not grow with n
# (measured: n=10 unrolled 10x faster; n=100 unrolled costs ~10 s of code generation).
GEN_UNROLL_MAX = 32


def random_vector(key: Column, n: int, seed: int, mixed: Column | None = None) -> Column:
    """n uniforms for one row key; unrolled into codegen'd arithmetic up to ``GEN_UNROLL_MAX``."""
    if n <= GEN_UNROLL_MAX:
        return F.array(*[uniform(key, F.lit(s), seed, mixed) for s in range(n)])
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: uniform(key, s, seed, mixed))


def generate_vectors(keys: DataFrame, key_col: str, n: int, seed: int = 42,
                     cutoff: float | None = None, first_weight: int = 1) -> DataFrame:
    """V4 + V1 + V2: one labelled vector of n uniform values per input row.

    Work is a narrow projection of ``keys`` (no shuffle); the vector of a row depends only on
    its key, so a lost partition recomputes the same rows.  Output: key, label DOUBLE,
    features ARRAY<DOUBLE>, score DOUBLE.
    """
    c = fv.default_cutoff(n) if cutoff is None else float(cutoff)
    mixed = keys.select(F.col(key_col).alias("key"), key_mix(F.col(key_col)).alias("_k"))
    out = mixed.select("key", random_vector(F.col("key"), n, seed, F.col("_k")).alias("features"))
    out = out.withColumn("score", fv.weighted_score(F.col("features"), first_weight, width=n))
    return out.select("key", fv.threshold_label(F.col("score"), c).cast("double").alias("label"),
                      "features", "score")


def generate_range(spark, n_rows: int, n: int, partitions: int, seed: int = 42,
                   cutoff: float | None = None, first_weight: int = 1) -> DataFrame:
    """V4 on ``spark.range``: rows rounded up to a multiple of the partition count, as the
    per-partition generator does (ceil(n_rows / p) * p)."""
    per = -(-n_rows // partitions)
    keys = spark.range(0, per * partitions, 1, partitions)
    return generate_vectors(keys, "id", n, seed, cutoff, first_weight)


def label_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """Positive labels, count and percent."""
    y = F.col(label).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("n_ones"),
                  (F.avg(y) * F.lit(100.0)).alias("pct_ones"))


def score_cutoffs(df: DataFrame, score: str = "score", steps: int = 100) -> DataFrame:
    """A7 + O1 + O2: the empirical cutoff table.  With scores sorted ascending and
    step = floor(n / steps), row ``k * step`` (0-based, k = 1..steps-1) is the cutoff that
    leaves ``steps - k`` percent of the rows above it.  Fewer than ``steps`` rows is an error.

    The table is not sorted: a sketch brackets the asked rows and only what lies inside the brackets is
    (``vigil.operators.quantiles``).
    """
    def positions(n: int) -> list[int]:
        if n < steps:
            raise ValueError(f"a cutoff table of {steps} steps needs at least {steps} rows, not {n}")
        return [k * (n // steps) for k in range(1, steps)]

    picked = values_at(df, score, positions)
    return picked.select((F.lit(steps) - F.col("k")).cast("int").alias("pct"), F.col("value").alias("cutoff"))
