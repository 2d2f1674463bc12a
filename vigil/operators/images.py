"""Image-set operators: dataset statistics used for normalisation, mean-image subtraction,
replication / replay of a set, and byte-record decoding."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import images as fi


def _merged_moments(parts: DataFrame, values: str, *keys: str) -> DataFrame:
    """``n, mean, std`` (population) over all values of the arrays, per ``keys``.

    Each array is folded to its size, mean and mean squared deviation.  Arrays of one size merge by Spark's own
    mean and variance; the few sizes that occur merge by their deviations from the common mean, so
    no square of a large mean is ever subtracted."""
    def mean_of(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(values)

    rows = parts.where(F.size(values) > 0).select(*keys, F.size(values).alias("k"), values, mean_of(F.col(values)).alias("m"))
    rows = rows.select(*keys, "k", "m", mean_of(F.transform(values, lambda v: (v.cast("double") - F.col("m")) * (v.cast("double") - F.col("m")))).alias("q"))
    sizes = rows.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("r"), F.avg("m").alias("m"), (F.avg("q") + F.var_pop("m")).alias("q"))
    sizes = sizes.withColumn("n", F.col("r") * F.col("k"))
    merged = sizes.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
                                      F.collect_list(F.struct("n", "m", "q")).alias("s"))  # a row per array size
    total = F.aggregate("s", F.lit(0.0), lambda a, r: a + r["n"] * (r["q"] + (r["m"] - F.col("mean")) * (r["m"] - F.col("mean"))))
    return merged.select(*keys, "n", "mean", F.sqrt(total / F.col("n")).alias("std"))


def pixel_moments(df: DataFrame, pixels: str = "pixels") -> DataFrame:
    """V6: global pixel count, mean and population std, in one pass and without explode."""
    return _merged_moments(df.select(pixels), pixels)


def normalise_by_moments(df: DataFrame, pixels: str = "pixels", out: str = "normalised") -> DataFrame:
    """V6 + V5: (x - mean) / std with the set's own mean and std (a scalar subquery, so the
    two numbers reach every task as literals; no join)."""
    m = pixel_moments(df, pixels)
    # subqueries cannot sit inside a lambda: bind them as columns first
    b = df.withColumn("_mean", m.select("mean").scalar()).withColumn("_std", m.select("std").scalar())
    return b.withColumn(out, fi.normalise(F.col(pixels), F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def mean_image(df: DataFrame, pixels: str = "pixels") -> DataFrame:
    """V8 (fit): per-position mean over the set, one row ``mean_image ARRAY<DOUBLE>``.
    ``Summarizer`` keeps one fixed-width vector buffer per task."""
    vec = array_to_vector(F.transform(F.col(pixels), lambda v: v.cast("double")))
    return df.select(vec.alias("_v")).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(
        vector_to_array("_m").alias("mean_image"))


def subtract_mean_image(df: DataFrame, pixels: str = "pixels", out: str = "centred",
                        reference: DataFrame | None = None) -> DataFrame:
    """V8 (apply): subtract the mean image of ``reference`` (default: the set itself)."""
    mi = mean_image(reference if reference is not None else df, pixels).scalar()
    return df.withColumn("_mi", mi).withColumn(out, fi.subtract(F.col(pixels), F.col("_mi"))).drop("_mi")


def channel_stats(df: DataFrame, channels: int, pixels: str = "pixels") -> DataFrame:
    """Per-channel mean and population std of HWC images (channel = index mod c).  An image gives one
    row per channel; only the channels' partial sums are shuffled."""
    def plane(c: int) -> Column:
        return F.filter(pixels, lambda x, i: F.pmod(i, F.lit(channels)) == c)

    planes = F.array(*[plane(c) for c in range(channels)])
    px = df.select(F.posexplode(planes).alias("channel", "plane"))
    return _merged_moments(px, "plane", "channel").select("channel", "mean", "std")


def normalise_by_channel(df: DataFrame, channels: int, pixels: str = "pixels", out: str = "normalised",
                         stats: DataFrame | None = None) -> DataFrame:
    """V9 with the set's own channel statistics (or given ``stats``)."""
    st = stats if stats is not None else channel_stats(df, channels, pixels)
    arr = st.agg(F.sort_array(F.collect_list(F.struct("channel", "mean", "std"))).alias("a"))
    means = arr.select(F.transform("a", lambda r: r["mean"])).scalar()
    stds = arr.select(F.transform("a", lambda r: r["std"])).scalar()
    b = df.withColumn("_cm", means).withColumn("_cs", stds)
    return b.withColumn(out, fi.normalise_channels(F.col(pixels), F.col("_cm"), F.col("_cs"), channels)).drop("_cm", "_cs")


def replicate(df: DataFrame, times: int, copy_col: str = "copy") -> DataFrame:
    """Every row ``times`` times (UNION ALL x times) via a generator - no join."""
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.lit(times))))


#: Positions that a row emits from one array.
REPLAY_STRETCH = 4096


def replay(df: DataFrame, index_col: str, total: int, n: int | Column, out_col: str = "i") -> DataFrame:
    """Rows i = 0..total-1 take row ``i mod n`` of an indexed set (wrap-around replay).
    Each source row emits its own positions (idx, idx+n, idx+2n, ...), in stretches of ``REPLAY_STRETCH``: generators
    on the row, no join, no cross product and no array of all positions."""
    nn = n if isinstance(n, Column) else F.lit(int(n))
    k = F.floor((F.lit(total) - 1 - F.col(index_col)) / nn)  # the last round that the row has, below 0 if none
    rounds = F.when(k >= 0, F.sequence(F.lit(0).cast("long"), k, F.lit(REPLAY_STRETCH).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    begun = df.withColumn("_round", F.explode(rounds))
    inner = F.sequence(F.col("_round"), F.least(k, F.col("_round") + REPLAY_STRETCH - 1))
    return begun.withColumn("_round", F.explode(inner)).withColumn(out_col, (F.col(index_col) + F.col("_round") * nn).cast("long")).drop("_round")
