"""Order-dependent helpers that stay distributed.

Spark's plain ``Window.orderBy(...)`` (no partition) and ``partitionBy(key)`` windows put a
whole table / a whole key into one task.  The helpers here split the order key into fixed
blocks: the per-row work runs in ``partitionBy(key, block)`` windows (bounded size), and only
one summary row per block goes through the small cross-block step.

* ``running_totals``   - prefix sums over an integer order key (two-level scan)
* ``neighbour_value``  - lag / lead of a value within a key (two-level, hot keys are split)
* ``global_index``     - exact 0-based position in a total order (range sort + partition offsets)

Each helper reads its input twice (summary + rows).  By default the input is checkpointed
first, so the upstream plan runs once (see ``vigil.session.materialize``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import materialize as _materialize

DEFAULT_BLOCK = 4096


def floor_div(c: Column, d: int) -> Column:
    """Exact floor division of a BIGINT by a positive constant."""
    return F.call_function("div", c - F.pmod(c, F.lit(d)), F.lit(d))


def running_totals(df: DataFrame, order_col: str, cols: Sequence[str], block: int = DEFAULT_BLOCK,
                   suffix: str = "_cum", materialize: bool = True) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over all rows with order key <= this row's.

    ``order_col`` is an integer key, unique per row (an interval table).  Cost: one
    aggregate to block totals, a prefix sum over the (rows/block) block table, a join back
    and a ``partitionBy(block)`` window whose partitions hold at most ``block`` keys.
    """
    if materialize:
        df = _materialize(df)
    b = df.withColumn("_blk", floor_div(F.col(order_col), block))
    totals = b.groupBy("_blk").agg(*[F.sum(c).alias(c) for c in cols])
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_blk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in cols]
    )
    within = (Window.partitionBy("_blk").orderBy(order_col)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = b.join(offsets, "_blk")
    out = out.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(c).over(within) + F.col(f"_off_{c}")).alias(f"{c}{suffix}") for c in cols],
    )
    return out


def neighbour_value(df: DataFrame, key: str, order_col: str, value_col: str, out_col: str,
                    direction: str = "prev", block: int = DEFAULT_BLOCK, materialize: bool = True) -> DataFrame:
    """Add ``out_col`` = ``value_col`` of the previous (``prev``) / next (``next``) row of the
    same ``key`` in ``order_col`` order, null at the edge.  Rows are unique per (key, order).

    A key with many rows (a hot sensor over many intervals) is split into blocks of the order
    key; each block's edge value comes from a per-(key, block) summary table.
    """
    if direction not in ("prev", "next"):
        raise ValueError("direction must be 'prev' or 'next'")
    if materialize:
        df = _materialize(df)
    b = df.withColumn("_blk", floor_div(F.col(order_col), block))
    if direction == "prev":
        edge = b.groupBy(key, "_blk").agg(F.max_by(value_col, order_col).alias("_edge"))
        carry = F.lag("_edge").over(Window.partitionBy(key).orderBy("_blk"))
    else:
        edge = b.groupBy(key, "_blk").agg(F.min_by(value_col, order_col).alias("_edge"))
        carry = F.lead("_edge").over(Window.partitionBy(key).orderBy("_blk"))
    carried = edge.select(key, "_blk", carry.alias("_carry"))
    w = Window.partitionBy(key, "_blk").orderBy(order_col)
    if direction == "prev":
        is_edge = F.row_number().over(w) == 1
        inner = F.lag(value_col).over(w)
    else:
        is_edge = F.row_number().over(w.orderBy(F.col(order_col).desc())) == 1
        inner = F.lead(value_col).over(w)
    out = b.join(carried, [key, "_blk"])
    return out.select(*[F.col(c) for c in df.columns],
                      F.when(is_edge, F.col("_carry")).otherwise(inner).alias(out_col))


def global_index(df: DataFrame, order_cols: Sequence[str | Column], index_col: str = "idx",
                 partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Exact 0-based position of each row in ``order_cols`` order (``row_number() - 1``).

    Range-partitions and sorts the rows (no single-partition window), numbers rows inside
    each partition, and adds the row counts of all earlier partitions.  The partition-count
    table has one row per partition, so broadcasting it is bounded.  An explicit partition
    number keeps AQE from re-cutting the ranges, so both uses of the sorted frame agree and
    the exchange is reused.  With ``materialize`` the numbered rows are checkpointed, so the
    count pass and the row pass read the same numbering even after a task retry.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
    s = s.withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    if materialize:
        s = _materialize(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return out.withColumn(index_col, F.col("_off") + local).drop("_mid", "_pid", "_off")
