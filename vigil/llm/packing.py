"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class ``k`` holds the pieces of ``capacity // (k + 1) < length <= capacity // k`` ids, and a bin of
class ``k`` takes exactly ``k`` pieces.  Documents may be cut, so a rest far below the top of its
class is cut at the top of the next class; what a piece wastes is at most ``slack`` ids.

Every task fills the bins of its own classes and needs nothing from others.  The pieces of its
unfinished bins (fewer than ``k`` per class) are ranked over all tasks by counts per task and class,
and fill more bins.  Fewer than ``k`` pieces per class remain in the end, a number that does not
depend on the input; one group packs these first-fit, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.tokens import text_ids

#: Sequence ids: task << 32 | number for the tasks' own bins, (SHARED + class) << 32 | number for later ones.
SHARED = 1 << 30


def pieces_of(length: int, capacity: int, slack: int) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in text order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        top, lower = capacity // k, capacity // (k + 1)
        piece = rest if top - rest <= slack or not lower else lower
        out.append(piece)
        rest -= piece
    return out


def _full_bins(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, slack: int) -> DataFrame:
    """All pieces; ``sequence_id`` and ``offset`` are null for those of unfinished bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins, waiting = TaskContext.get().partitionId(), 0, {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                                    ("doc_tokens", pa.int64()), ("task", pa.int64()), ("class", pa.int64()), ("rank", pa.int64()),
                                    ("sequence_id", pa.int64()), ("offset", pa.int64())])
            done = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(text_ids(vocabulary, text.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                start = 0
                for n in pieces_of(len(ids), capacity, slack):
                    k = capacity // n
                    held = waiting.setdefault(k, [])
                    held.append((doc, start, n, ids[start:start + n].tobytes(), len(ids)))
                    start += n
                    if len(held) == k:
                        offset = 0
                        for rank, p in enumerate(held):
                            done.append((*p, task, k, rank, (task << 32) | bins, offset))
                            offset += p[2]
                        bins += 1
                        held.clear()
                if len(done) >= 2000:
                    yield batch_of(done)
                    done = []
            if done:
                yield batch_of(done)
        rest = [(*p, task, k, rank, None, None) for k, held in sorted(waiting.items()) for rank, p in enumerate(held)]
        for at in range(0, len(rest), 2000):
            yield batch_of(rest[at:at + 2000])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, task bigint, class bigint, rank bigint, sequence_id bigint, offset bigint")


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "class", "rank"], ascending=[False, True, True, True], kind="stable")
        room, ids, offsets = [], [], []
        for n in pdf["length"]:
            b = next((i for i, r in enumerate(room) if r >= n), None)
            if b is None:
                b = len(room)
                room.append(capacity)
            ids.append((SHARED << 32) | b)
            offsets.append(capacity - room[b])
            room[b] -= n
        return pdf.assign(sequence_id=np.array(ids, dtype=np.int64), offset=np.array(offsets, dtype=np.int64))[["task", "class", "rank", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, slack: int = 16, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, start, length, ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Each id lies
    in exactly one piece.  Repeated ids and texts are packed once per row.  Other columns are not
    read.  An empty table gives no rows.  A sequence whose pieces sum to a power of two needs no
    padding; all others are padded to ``capacity``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = stored(_full_bins(rows, vocabulary, end_id, capacity, slack), "packing")
    loose = placed.where(F.col("sequence_id").isNull()).select("task", "class", "rank", "length")

    counts = loose.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy("class")).alias("total"))
    ranked = loose.join(counts, ["class", "task"]).withColumn("at", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("bin", F.expr("at div class"))
    complete = F.col("bin") < F.expr("total div class")
    in_bin = Window.partitionBy("class", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = stored(ranked, "packing-loose")
    shared = ranked.where(complete).select(
        "task", "class", "rank", (F.shiftleft(F.lit(SHARED) + F.col("class"), 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long").alias("offset"))
    last = (ranked.where(~complete).select("task", "class", "rank", "length", F.lit(0).alias("all")).groupBy("all")
            .applyInPandas(_first_fit(capacity), "task bigint, class bigint, rank bigint, sequence_id bigint, offset bigint"))
    late = (placed.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
            .join(shared.unionByName(last), ["task", "class", "rank"]))
    columns = [F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return placed.where(F.col("sequence_id").isNotNull()).select(columns).unionByName(late.select(columns))
