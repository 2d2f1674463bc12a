"""Order MinHash fingerprints.

A text's k-mers (``K`` bytes of its UTF-8 form) are numbered by occurrence, so a repeated k-mer counts as
often as it stands there.  One hash deals the numbered k-mers into ``ENTRIES`` bins; of each bin the two with
the least hash are selected, kept in the order of the text and hashed as a tuple.  Two texts agree in an
entry if they share both k-mers and their order, so the share of equal entries falls with the edit
distance and not only with the overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, ENTRIES, BIN_BITS = 8, 64, 6
POSITION_BITS = 24
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


def _numbered(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers and their positions."""
    data = data.ljust(K, b"\0")
    n = len(data) - K + 1
    windows = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    low = np.uint64(POSITION_BITS)
    kmers = _mix(windows * _C1) >> low
    if n < 1 << POSITION_BITS:  # one sort brings equal k-mers together in text order
        packed = kmers << low
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        kmers, at = packed >> low, packed & np.uint64((1 << POSITION_BITS) - 1)
    else:
        at = np.argsort(kmers, kind="stable").astype(np.uint64)
        kmers = kmers[at]
    same = kmers[1:] == kmers[:-1]
    if same.any():
        index = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), index, 0))
        kmers = kmers + (index - first).astype(np.uint64) * _C2
    return _mix(kmers * _C1 + _C3), at


def order_minhash(data: bytes) -> np.ndarray:
    """``ENTRIES`` unsigned 32-bit entries; 0 where no k-mer fell, all 0 for an empty text."""
    out = np.zeros(ENTRIES, dtype=np.uint32)
    if not data:
        return out
    hashes, at = _numbered(data)
    shift = np.uint64(64 - BIN_BITS)
    below = hashes & ((np.uint64(1) << shift) - np.uint64(1))
    if len(hashes) > 64 * ENTRIES:  # the least of a bin lie below this, and all are taken where a bin has fewer than two
        few = below < np.uint64((1 << (64 - BIN_BITS)) * 16 * ENTRIES // len(hashes))
        if (np.bincount((hashes[few] >> shift).astype(np.int64), minlength=ENTRIES) >= 2).all():
            hashes, at = hashes[few], at[few]
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order], at[order]
    bins = (hashes >> shift).astype(np.int64)
    start = np.searchsorted(bins, np.arange(ENTRIES + 1))
    one = np.flatnonzero(start[1:] - start[:-1] == 1)
    two = np.flatnonzero(start[1:] - start[:-1] >= 2)
    a, b = start[two], start[two] + 1
    swap = at[a] > at[b]
    first, second = np.where(swap, b, a), np.where(swap, a, b)
    out[two] = (_mix(hashes[first] * _C1 + hashes[second]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out[one] = (_mix(hashes[start[one]] + _C2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries among those that either fingerprint has; 1 for two empty ones."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float((a[either] == b[either]).sum() / n) if n else 1.0


def as_hex(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def half_next(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_successor(docs: DataFrame, run: Callable, schema: T.StructType, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """``run`` over iterators of ``(id, text, next text)`` in ascending id; after the last comes the first.

    Ids are numbers; null ids come first, equal ids are ordered by text.  Null texts count as empty.  The texts are
    shuffled once, into ranges of ids; the first row of each range is sent to the range before it too.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    ids = docs.agg(F.percentile_approx(id_col, [k / n for k in range(n)], 10_000), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    bounds = sorted(set(ids[0] or [0]))
    if ids[1]:
        bounds = [bounds[0] - 1, *bounds]
    count = len(bounds)
    key = F.coalesce(F.col("id"), F.lit(bounds[0]))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key)
    edges = F.array(*[F.lit(b).cast(kind) for b in bounds])
    rows = rows.withColumn("range", F.size(F.filter(edges, lambda b: b <= F.col("key"))) - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, F.lit(count)).alias("range"), F.lit(True).alias("guest"))
    starts = F.col("key") == F.element_at(edges, F.col("range") + 1)
    sent = rows.select("id", "text", "key", F.explode(F.when(starts, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    sent = sent.select(F.col("to.range").alias("range"), F.col("to.guest").alias("guest"), "key", "text", "id")
    dealt = sent.repartition(count, "range").sortWithinPartitions("range", "guest", "key", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for r, is_guest, text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
                row = (r, is_guest, text.as_py(), key.as_py())
                if held is not None and held[0] == r and not held[1]:
                    yield held[3], held[2], row[2]
                held = row

    return dealt.mapInArrow(lambda batches: run(pairs(batches)), schema)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[str, str], str] = half_next) -> DataFrame:
    """Per row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``edit`` makes the edited text from a text and the next one.  Null text counts as empty; an empty text has a
    fingerprint of zeros.  A single row follows itself.  Repeated ids and texts keep a row each.  Other columns
    are not read.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, np.ndarray] | None = None
        out = []

        def batch() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.fieldNames())

        for key, text, following in pairs:
            mine = known[1] if known and known[0] == text else order_minhash(text.encode())
            known = (following, order_minhash(following.encode()))
            edited = edit(text, following).encode()
            other = order_minhash(edited)
            out.append((key, len(text), hashlib.sha256(edited).hexdigest(), as_hex(mine), as_hex(other), likeness(mine, other), likeness(mine, known[1])))
            if len(out) == 500:
                yield batch()
                out = []
        if out:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    return with_successor(docs, run, schema, id_col, text_col)
