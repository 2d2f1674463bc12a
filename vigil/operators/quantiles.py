"""Exact order statistics without sorting the table.

A mergeable sketch (KLL) brackets the values at the asked positions.  One further pass counts the rows between the
brackets' ends and lists, counted by value, only those inside a bracket; these few are sorted, each bracket by
itself.  The counts show whether a position does lie in its bracket; if one does not, its bracket is widened and
the pass repeated.  So the sketch decides the work, never the result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import materialize, scratch_dir

#: A sketch of this size ranks within about 0.03 % of the rows; it is a few hundred kilobytes.
SKETCH_SIZE = 16_384


def _rank_error(size: int) -> float:
    """Bound of the relative rank error of a sketch, with a margin; only the work depends on it."""
    return 4.0 / size ** 0.9


def _profile(df: DataFrame, value: str, size: int) -> tuple[int, int, int, bytes | None]:
    """Rows, null rows, NaN rows and the sketch of the rest; partial sketches meet in a number of groups first."""
    plain = F.when(~F.isnan(value), F.col(value))
    sketch = F.kll_sketch_agg_double(plain, size).alias("sketch")
    parts = df.groupBy((F.spark_partition_id() % 32).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count_if(F.isnan(value)).alias("nans"), sketch)
    r = parts.agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("nans").alias("nans"), F.kll_merge_agg_double("sketch").alias("sketch")).first()
    return r["n"] or 0, r["nulls"] or 0, r["nans"] or 0, r["sketch"]


def _sketch_values(spark, sketch: bytes, ranks: Sequence[float]) -> list[float]:
    """The sketch's values at relative ranks."""
    asked = F.array(*[F.lit(min(1.0, max(0.0, r))) for r in ranks])
    return list(spark.createDataFrame([(bytearray(sketch),)], "s binary").select(F.kll_sketch_get_quantile_double("s", asked).alias("q")).first()["q"])


def _edge_index(v: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are at most ``v``: the number of whole stretches first, then those within the next one."""
    width = max(1, math.isqrt(len(edges)))
    stretches = [list(edges[a:a + width]) for a in range(0, len(edges), width)]
    whole = F.size(F.filter(F.lit([s[-1] for s in stretches]), lambda e: e <= v))
    inner = F.coalesce(F.get(F.lit([s + [math.nan] * (width - len(s)) for s in stretches]), whole), F.expr("cast(array() as array<double>)"))
    return whole * width + F.size(F.filter(inner, lambda e: e <= v)) - F.when(whole == len(stretches), width * len(stretches) - len(edges)).otherwise(0)


def _cells(df: DataFrame, value: str, edges: list[float], inside: set[int]) -> DataFrame:
    """``cell, value, n``.  Cell 2i lies between edges i - 1 and i, cell 2i + 1 is edge i itself; values are told
    apart in the cells ``inside`` only."""
    at = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select((F.col(value) + 0.0).alias("v"))
    at = at.withColumn("i", _edge_index(F.col("v"), edges))
    exact = F.col("v") == F.get(F.lit(edges), F.col("i") - 1)
    at = at.select("v", (2 * F.col("i") - F.when(exact, 1).otherwise(0)).alias("cell"))
    wanted = F.get(F.lit([c in inside for c in range(2 * len(edges) + 1)]), F.col("cell"))
    return at.groupBy("cell", F.when(wanted, F.col("v")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def values_at(df: DataFrame, col: str, positions: Callable[[int], Sequence[int]], size: int = SKETCH_SIZE) -> DataFrame:
    """``k, position, value``: the value at each 0-based position of the ascending order of ``col``.

    ``positions`` gives the positions, ascending, for the number of rows.  Nulls come first, then numbers (0.0 and -0.0 are
    equal), then NaN; equal values stand next to each other.  ``k`` counts the positions from 1.  The values are written
    once and read twice, or more often if a bracket must be widened.  A position outside the table is an error.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "values")  # the values alone, so that what makes them runs once
    df.select(F.col(col).cast("double").alias("v")).write.parquet(path)
    rows = spark.read.schema("v double").parquet(path)
    n, nulls, nans, sketch = _profile(rows, "v", size)
    asked = list(positions(n))
    if any(not 0 <= p < n for p in asked):
        raise ValueError(f"positions beyond the {n} rows")
    numbers = n - nulls - nans
    open_ = {k: p - nulls for k, p in enumerate(asked, 1) if nulls <= p < nulls + numbers}
    fixed = [(k, p, None if p < nulls else math.nan) for k, p in enumerate(asked, 1) if k not in open_]
    schema, found = "k int, position bigint, value double", []
    error = _rank_error(size)
    while open_:
        ranks = sorted(open_)
        low = _sketch_values(spark, sketch, [open_[k] / numbers - error for k in ranks])
        high = _sketch_values(spark, sketch, [(open_[k] + 1) / numbers + error for k in ranks])
        edges = sorted({x + 0.0 for x in low + high})
        inside = {2 * i for a, b in zip(low, high) for i in range(bisect_left(edges, a) + 1, bisect_left(edges, b) + 1)}
        cells = materialize(_cells(rows, "v", edges, inside))
        counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row per cell
        picks, before = [], 0
        left = dict(open_)
        for cell in sorted(counts):
            for k in [k for k, p in left.items() if p < before + counts[cell]]:
                p = left.pop(k)
                if cell % 2:
                    fixed.append((k, asked[k - 1], edges[cell // 2]))
                    del open_[k]
                elif cell in inside:
                    picks.append((k, asked[k - 1], cell, p - before))
                    del open_[k]
            before += counts[cell]
        if picks:
            upto = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            wanted = F.broadcast(spark.createDataFrame(picks, "k int, position bigint, cell int, rank bigint"))  # a row per position
            listed = cells.join(F.broadcast(spark.createDataFrame([(c,) for c in {p[2] for p in picks}], "cell int")), "cell").withColumn("end", F.sum("n").over(upto))
            found.append(listed.join(wanted, "cell").where("rank < end and rank >= end - n").select("k", "position", "value"))
        error *= 8
    out = spark.createDataFrame(fixed, schema)
    for part in found:
        out = out.unionByName(part)
    return out
