"""SimHash near-duplicates by deletion-variant signatures.

1. One 64-bit fingerprint per text (majority of the XXH64 bits of its word shingles), computed
   in Arrow batches; equal fingerprints are one class from here on.
2. Links inside exact-segment buckets: every class is tied to its predecessor and to the first
   class of the bucket when they are within ``max_bits``.  This is linear in the classes and
   joins dense groups without emitting their pairs.
3. Deletion variants: the fingerprint is cut into ``max_bits // 2 + 1`` segments, so two
   fingerprints within ``max_bits`` differ by at most one bit in one of them.  Each segment is
   indexed once per wildcard bit; equal variants are joined and verified by their bit distance.
   Only pairs of different components of step 2 are joined, and buckets that lie inside one
   component are left out, so what is emitted are the missing links and no others.
4. Connected components of the links of 2 and 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes
from vigil.llm.components import connected_components

BITS = 64
SEED = 42


def simhash_bytes(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes).tolist(), ends[shingle - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), dtype=np.uint64, count=len(last))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the signed fingerprint of every row; null text counts as empty (fingerprint 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash_bytes(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = max_bits // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(max_bits: int) -> list[int]:
    """The 64-bit mask of each segment, as signed long."""
    return [int(np.uint64(((1 << w) - 1) << a).astype(np.int64)) for a, w in _segments(max_bits)]


def _variant_masks(max_bits: int) -> list[int]:
    """One mask per wildcard bit: the bit's segment without that bit, as signed long."""
    return [int(np.uint64((((1 << w) - 1) << a) & ~(1 << bit)).astype(np.int64))
            for a, w in _segments(max_bits) for bit in range(a, a + w)]


def _close(a, b, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _keyed(classes: DataFrame, masks: list[int]) -> DataFrame:
    """One row per class and mask: ``slot`` (number of the mask) and ``key`` (the kept bits)."""
    slots = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("slot", "mask")
    return classes.select("*", slots).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def fingerprint_components(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp, label`` for distinct fingerprints ``fp``: label = smallest fingerprint reachable by links
    of at most ``max_bits`` differing bits."""
    if not 0 <= max_bits < BITS:
        raise ValueError("max_bits must lie in 0..63")
    classes = classes.select("fp")
    in_bucket = Window.partitionBy("slot", "key").orderBy("fp")
    near = _keyed(classes, _masks(max_bits)).select(
        "fp", F.lag("fp").over(in_bucket).alias("previous"), F.first("fp").over(in_bucket).alias("head"))
    near = near.select("fp", F.explode(F.array("previous", "head")).alias("other"))
    near = near.where((F.col("other") != F.col("fp")) & _close("fp", "other", max_bits)).distinct()
    rough = connected_components(near, "fp", "other").withColumnRenamed("node", "fp")
    labelled = stored(classes.join(rough, "fp", "left").select("fp", F.coalesce("component", "fp").alias("label")), "simhash-labels")

    whole = Window.partitionBy("slot", "key")
    variants = _keyed(labelled, _variant_masks(max_bits))
    mixed = variants.withColumn("low", F.min("label").over(whole)).withColumn("high", F.max("label").over(whole))
    mixed = stored(mixed.where(F.col("low") != F.col("high")).select("slot", "key", "fp", "label"), "simhash-variants")
    other = mixed.select("slot", "key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    links = mixed.join(other, (mixed["slot"] == other["slot"]) & (mixed["key"] == other["key"])
                       & (F.col("label") < F.col("label2")) & _close("fp", "fp2", max_bits))
    merged = connected_components(links.select("label", "label2").distinct(), "label", "label2")
    merged = merged.select(F.col("node").alias("label"), F.col("component").alias("root"))
    return labelled.join(merged, "label", "left").select("fp", F.coalesce("root", "label").alias("label"))


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (signed long) and ``component_id`` (smallest id reachable).

    Null and wordless texts have fingerprint 0 and are linked like any other.  Repeated ids keep
    one row each.  A row with a null id is grouped like any other; null never is a component's
    smallest id unless all its ids are null.  Other columns are not read.  An empty table gives none.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    labels = fingerprint_components(classes, max_bits)
    members = classes.join(labels, "fp")
    smallest = members.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = members.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
