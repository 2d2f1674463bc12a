"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Anchors: of the ``KMER``-byte strings in every window of ``LENGTH`` bytes the one of least hash is the
   window's anchor (content alone decides, so equal windows have equal anchors at the same place).  An anchor
   that occurs once has no repeat around it.  If two occurrences agree in the whole context (all
   windows that hold the anchor), every window of theirs is repeated.
2. What is left are occurrences whose context is unlike the others'.  Aligned at the anchor, the contexts of all
   groups of a task are cut into shards.  Each shard gets its (positional) Burrows-Wheeler transform
   in both directions: column by column the symbols in the order of what lies between them and the anchor.
   The transforms are merged by refining the interleave of the shards, one column at a time: the merged
   symbols, read from the shards' columns as the interleave says, are dealt out stably, which gives the
   interleave of the next column.  No context is sorted again.  Runs of equal prefixes at each depth (the
   common-prefix intervals) come out on the way, and a window is repeated if its left and right part
   lie in intervals that another occurrence shares.
   A group of more contexts than a task holds is dealt out by content first: windows that begin a to a + 15 bytes
   before the anchor share the a bytes before it and the bytes after it that all of them reach, so each such
   range of windows makes groups of its own, and none of their repeats is lost.
3. Covered stretches are joined per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes

LENGTH = 400
KMER = 256
#: Windows of LENGTH bytes that hold one KMER, less one: how far a context goes on either side.
SIDE = LENGTH - KMER
SHARD, BATCH = 8192, 60_000
#: Windows of one range, where a group is dealt out by content; most large groups whose list is broadcast.
RANGE, MAX_BROADCAST = 16, 1_000_000
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return up, down


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every KMER-byte string, by prefix sums of a polynomial."""
    size = 1 << max(12, (len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[KMER:] - sums[:-KMER]) * down[:len(data) - KMER + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, op: np.ufunc, neutral: int) -> np.ndarray:
    """``op`` over each run of ``width`` values."""
    blocks = np.full(-(-len(x) // width) * width, neutral, dtype=np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:len(x) - width + 1], ahead[width - 1:len(x)])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the text's anchors: the least KMER of each window of LENGTH bytes, all of them at a tie."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _kmer_hashes(np.frombuffer(text, np.uint8))
    least = _sliding(h, SIDE + 1, np.minimum, 2**64 - 1)
    wide = np.zeros(len(least) + 2 * SIDE, np.uint64)
    wide[SIDE:SIDE + len(least)] = least
    at = np.flatnonzero(h == _sliding(wide, SIDE + 1, np.maximum, 0))  # least of some window
    return at, h[at].view(np.int64)


def _context(text: bytes, at: int) -> tuple[bytes, bytes]:
    """Up to SIDE bytes before and after the anchor."""
    return text[max(0, at - SIDE):at], text[at + KMER:at + KMER + SIDE]


class Shard:
    """Positional transform of aligned rows: ``orders[k]`` sorts them by group and the k columns next to the anchor
    (the last one first), ``symbols[k]`` is column k in that order."""

    def __init__(self, groups: np.ndarray, columns: np.ndarray):
        order = np.argsort(groups, kind="stable")
        self.groups = groups[order]
        self.orders, self.symbols = [order], []
        for column in columns:
            self.symbols.append(column[order])
            order = order[np.argsort(self.symbols[-1], kind="stable")]
            self.orders.append(order)


def merged_intervals(shards: list[Shard], starts: list[int]) -> Iterator[np.ndarray]:
    """For each depth the interval of every row: equal numbers mean equal group and columns so far.

    ``starts`` are the shards' first row numbers.  The shards' orders are only used to name the rows.
    """
    groups = np.concatenate([s.groups for s in shards])
    first = np.argsort(groups, kind="stable")
    interleave = np.repeat(np.arange(len(shards), dtype=np.int32), [len(s.groups) for s in shards])[first]
    sorted_groups = groups[first]
    interval = np.concatenate([[0], np.cumsum(sorted_groups[1:] != sorted_groups[:-1])])
    for depth in range(len(shards[0].orders)):
        if depth:
            merged = np.empty(len(groups), np.uint8)
            for k, s in enumerate(shards):
                merged[interleave == k] = s.symbols[depth - 1]
            dealt = np.argsort(merged, kind="stable")
            merged, interval, interleave = merged[dealt], interval[dealt], interleave[dealt]
            interval = np.concatenate([[0], np.cumsum((interval[1:] != interval[:-1]) | (merged[1:] != merged[:-1]))])
        by_row = np.empty(len(groups), np.int32)
        for k, s in enumerate(shards):
            by_row[starts[k] + s.orders[depth]] = interval[interleave == k]
        yield by_row


def _columns(sides: list[bytes], outward: bool) -> np.ndarray:
    """Column k holds each side's k-th byte from the anchor; 0 beyond its end."""
    turned = [(s if outward else s[::-1]).ljust(SIDE, b"\0") for s in sides]
    return np.ascontiguousarray(np.frombuffer(b"".join(turned), np.uint8).reshape(len(sides), SIDE).T)


def repeated_windows(groups: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Matrix (SIDE + 1, rows): whether the window that begins d bytes before the anchor occurs in another row of the group."""
    n = len(groups)
    ln, rn = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    starts = list(range(0, n, SHARD))
    lc, rc = _columns(left, False), _columns(right, True)
    shards = [[Shard(groups[a:a + SHARD], c[:, a:a + SHARD]) for a in starts] for c in (lc, rc)]
    right_intervals = list(merged_intervals(shards[1], starts))
    out = np.zeros((SIDE + 1, n), bool)
    for d, li in enumerate(merged_intervals(shards[0], starts)):
        ri = right_intervals[SIDE - d]
        rows = np.flatnonzero((ln >= d) & (rn >= SIDE - d))
        for side in (li, ri):  # alone in an interval: no repeat
            rows = rows[np.bincount(side[rows], minlength=n)[side[rows]] > 1]
        if len(rows):
            _, inverse, counts = np.unique(li[rows].astype(np.int64) * n + ri[rows], return_inverse=True, return_counts=True)
            out[d, rows] = counts[inverse] > 1
    return out


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[list[int]]]:
    """The text without the spans, and the maximal removed runs."""
    runs, kept, at = _joined(spans), [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), runs


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _emit(ids: pa.Array, texts: list[bytes], spans: list[list]) -> pa.RecordBatch:
    done = [_cut(t, s) for t, s in zip(texts, spans)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([k for k, _ in done], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for _, r in done], _SPANS)],
        names=["id", "n_bytes", "kept", "runs"])


def _dealt(contexts: DataFrame, group_rows: int) -> DataFrame:
    """``contexts`` with ``part`` in place of ``h``: the group, or for a group of more than ``group_rows`` contexts
    one part per range of windows and shared bytes."""
    large = stored(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("h"), "repeats-large")
    found = large.count()
    if not found:
        return contexts.withColumnRenamed("h", "part")
    listed = large.withColumn("large", F.lit(True))
    contexts = contexts.join(F.broadcast(listed) if found <= MAX_BROADCAST else listed, "h", "left")
    parts = []
    for a in range(0, SIDE + 1, RANGE):
        after = SIDE - min(a + RANGE - 1, SIDE)
        shared = F.xxhash64("h", F.lit(a), F.substring("left", F.length("left") - a + 1, F.lit(a)), F.substring("right", 1, after))
        parts.append(F.when((F.length("left") >= a) & (F.length("right") >= after), shared))
    part = F.when(F.col("large"), F.array_compact(F.array(*parts))).otherwise(F.array("h"))
    return contexts.select(F.explode(part).alias("part"), "at", "sure", "left", "right", "row")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, group_rows: int = BATCH) -> DataFrame:
    """One row per document: ``id_col, n_bytes, kept`` (binary), ``runs`` (``array<struct<a, b>>``, removed bytes, end exclusive).

    With ``digest`` the kept bytes are given as lowercase SHA-256 (as binary text) instead.  A null text counts as empty.  Equal rows are
    each other's repeats.  Groups of more than ``group_rows`` different contexts are dealt out; the result does not depend on it.  Repeated and null ids keep a row each.  Other columns are not read.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(b)), pa.int64()), *b.columns], names=["row", "id", "text"])
            at += len(b)

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    rows = stored(rows.mapInArrow(numbered, f"row bigint, id {kind}, text binary"), "repeats-rows")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # a third equal context of a task is known to be repeated and needs no group
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                at, h = anchors(text)
                if len(at):
                    seeds = [xxhash.xxh64_intdigest(text[max(0, i - SIDE):i + KMER + SIDE], min(i, SIDE) * LENGTH * 2 + min(len(text) - i, LENGTH)) for i in at.tolist()]
                    if len(seen) > 400_000:
                        seen = {}
                    known = []
                    for key in zip(h.tolist(), seeds):
                        seen[key] = n = seen.get(key, 0) + 1
                        known.append(n > 2)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(np.array(seeds, np.uint64).view(np.int64)), pa.array(np.full(len(at), row), pa.int64()), pa.array(at, pa.int64()), pa.array(known)],
                                                     names=["h", "context", "row", "at", "known"])

    found = rows.select("row", "text").mapInArrow(find, "h bigint, context bigint, row bigint, at bigint, known boolean")
    found = found.withColumn("group", F.when(F.col("known"), F.xxhash64("row", "at")).otherwise(F.col("h")))
    same, alike = Window.partitionBy("group"), Window.partitionBy("group", "context")
    found = found.withColumn("in_group", F.count(F.lit(1)).over(same)).where("in_group > 1 or known")
    found = found.withColumn("equal", F.count(F.lit(1)).over(alike)).withColumn("number", F.row_number().over(alike.orderBy("row", "at")))
    # of equal contexts in a group with others one stands for all
    marks = F.struct("at", "h", ((F.col("equal") > 1) | F.col("known")).alias("sure"), ((F.col("equal") < F.col("in_group")) & (F.col("number") == 1) & ~F.col("known")).alias("compare"))
    listed = found.groupBy("row").agg(F.collect_list(marks).alias("marks"))  # a document's own anchors

    mark = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("sure", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "open", "text", "spans", "contexts"]
        for whole in batches:
            for part in range(0, len(whole), 64):
                b = whole.slice(part, 64)
                opens, texts, spans, contexts = [], [], [], []
                for value, marks in zip(b.column(2), b.column(3).to_pylist()):
                    text = value.as_py()
                    marks = marks or []
                    sure = [(max(0, m["at"] - SIDE), min(len(text), m["at"] + KMER + SIDE)) for m in marks if m["sure"]]
                    spans.append(_joined([s for s in sure if s[1] - s[0] >= LENGTH]))
                    compare = [(m, *_context(text, m["at"])) for m in marks if m["compare"]]
                    contexts.append([{"h": m["h"], "at": m["at"], "sure": m["sure"], "left": x, "right": y} for m, x, y in compare])
                    opens.append(any(not m["sure"] for m, _, _ in compare))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(opens), pa.array(texts, pa.binary()), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], _SPANS), pa.array(contexts, pa.list_(mark))], names=names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, len(whole), 64):
                b = whole.slice(part, 64)
                spans = [[(s["a"], s["b"]) for s in (x or [])] for x in b.column(2).to_pylist()]
                out = _emit(b.column(0), b.column(1).to_pylist(), spans)
                yield out if not digest else out.set_column(2, "kept", pa.array([hashlib.sha256(k).hexdigest().encode() for k in out.column(2).to_pylist()], pa.binary()))

    spans_type = "array<struct<a:bigint,b:bigint>>"
    settled = rows.join(listed, "row", "left").select("row", "id", "text", "marks").mapInArrow(
        settle, f"row bigint, id {kind}, open boolean, text binary, spans {spans_type}, contexts array<struct<h:bigint,at:bigint,sure:boolean,left:binary,right:binary>>")
    settled = stored(settled, "repeats-settled")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judged() -> pa.RecordBatch:
            hit = repeated_windows(np.array([r[0] for r in held], np.int64), [r[3] for r in held], [r[4] for r in held])
            out = []
            for i, (_, at, sure, _, _, row) in enumerate(held):
                if not sure:
                    d = np.flatnonzero(hit[:, i])
                    for run in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1) if len(d) else ():
                        out.append((row, at - int(run[-1]), at - int(run[0]) + LENGTH))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["row", "a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and r[0] != held[-1][0]:
                    yield judged()
                    held = []
                held.append(r)
        if held:
            yield judged()

    contexts = settled.select("row", F.explode("contexts").alias("c")).select("c.h", "c.at", "c.sure", "c.left", "c.right", "row")
    late = _dealt(contexts, group_rows).repartition("part").sortWithinPartitions("part").mapInArrow(compare, "row bigint, a bigint, b bigint")
    late = late.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("late"))
    out_type = f"id {kind}, n_bytes bigint, kept binary, runs {spans_type}"
    closed = settled.where(~F.col("open")).select("id", "text", "spans").mapInArrow(close, out_type)
    opened = settled.where("open").select("row", "id", "text", "spans").join(late, "row", "left").select(
        "id", "text", F.when(F.col("late").isNull(), F.col("spans")).otherwise(F.concat("spans", "late")).alias("spans")).mapInArrow(close, out_type)
    return closed.unionByName(opened).withColumnRenamed("id", id_col)
