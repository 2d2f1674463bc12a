"""Benchmark decontamination by greedy string tiling.

Words of a text (lower-cased A-Z, split at white space) are numbered by the benchmark's vocabulary,
so a text is a row of integers in which foreign words are -1.  Seeds are Karp-Rabin values of
``min_match`` consecutive words.  Texts and items that share seeds are joined on them inside the
tasks; a pair whose shared seeds cover enough of the item is tiled: the longest matches of words not
yet marked are found by running Karp-Rabin at falling lengths and marked, until none of
``min_match`` words is left.  The share of the item's words under tiles is its coverage; tiles may
come in any order, so reordered passages count.

The benchmark is read in blocks of at most ``block_words`` words, and the whole corpus meets each block,
so what a task holds of the benchmark is bounded whatever its size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import text_bytes

BASE = np.uint64(1_099_511_628_211)


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin value of each run of ``size`` values (polynomial modulo 2**64)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    v = values.astype(np.uint64) + np.uint64(1)
    for k in range(size):
        out = out * BASE + v[k:k + n]
    return out


def _scan(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, doc start, item start) of unmarked words that hold a run of ``size``."""
    def runs(values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marked[size:] == marked[:-size]) if len(values) >= size else np.zeros(0, dtype=np.int64)
        return at, rolling(values, size)[at]

    at_item, item_values = runs(item, free_item)
    at_doc, doc_values = runs(doc, free_doc)
    table = defaultdict(list)
    for p, h in zip(at_item.tolist(), item_values.tolist()):
        table[h].append(p)
    hits = np.isin(doc_values, item_values)
    found, seen = [], set()
    for d, h in zip(at_doc[hits].tolist(), doc_values[hits].tolist()):
        for i in table[h]:
            if (d - 1, i - 1) in seen:  # inside a match found before
                seen.add((d, i))
                continue
            n = 0
            while d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n] and doc[d + n] == item[i + n]:
                n += 1
            if n >= size:
                seen.add((d, i))
                found.append((n, d, i))
    return found


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, doc start, item start), longest first."""
    doc_free, item_free = doc >= 0, np.ones(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), len(doc)))
    while True:
        matches = sorted(_scan(doc, item, doc_free, item_free, size), key=lambda m: (-m[0], m[1], m[2]))
        for n, d, i in matches:
            if doc_free[d:d + n].all() and item_free[i:i + n].all():
                doc_free[d:d + n] = item_free[i:i + n] = False
                out.append((n, d, i))
        if matches and size == min_match and not _scan(doc, item, doc_free, item_free, size):
            return out
        if not matches:
            if size == min_match:
                return out
            size = max(min_match, size // 2)


class Benchmark:
    """A block of items, indexed by seed."""

    def __init__(self, items: list[tuple[object, bytes]], min_match: int):
        self.min_match = min_match
        self.words: dict[bytes, int] = {}
        self.items = [(key, np.array([self.words.setdefault(w, len(self.words)) for w in text.lower().split()], dtype=np.int64)) for key, text in items]
        self.seeds = defaultdict(list)
        for n, (_, values) in enumerate(self.items):
            for at, h in enumerate(rolling(values, min_match).tolist()):
                self.seeds[h].append((n, at))
        self.sorted = np.sort(np.fromiter(self.seeds, dtype=np.uint64, count=len(self.seeds)))

    def match(self, text: bytes, coverage: float) -> Iterator[tuple[object, int, int, int, list]]:
        """``item, item words, covered words, tiles`` of the items the text covers enough."""
        find = self.words.get
        words = text.lower().split()
        values = np.fromiter((find(w, -1) for w in words), dtype=np.int64, count=len(words))
        m = self.min_match
        if len(values) < m or not len(self.sorted):
            return
        foreign = np.concatenate([[0], np.cumsum(values < 0)])
        starts = np.flatnonzero(foreign[m:] == foreign[:-m])
        if not len(starts):
            return
        hashes = rolling(values, m)[starts]
        slot = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        shared = self.sorted[slot] == hashes
        if not shared.any():
            return
        seeded = defaultdict(set)
        for h in set(hashes[shared].tolist()):
            for n, at in self.seeds[h]:
                seeded[n].update(range(at, at + m))
        for n, under in seeded.items():
            key, item = self.items[n]
            if len(under) < coverage * len(item):  # tiles lie under seeds
                continue
            found = tiles(values, item, m)
            covered = sum(t[0] for t in found)
            if covered >= coverage * len(item):
                yield key, len(item), covered, found


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, block_words: int = 2_000_000,
                 id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) whose coverage reaches the threshold: ``id_col, item_id, item_words, covered_words,
    coverage, tiles`` (``array<struct<length, doc_start, item_start>>``, word positions).

    An item of fewer than ``min_match`` words, a null or an empty one never matches; nor does such a document.
    Rows are judged one by one: repeated ids, texts and items give a row each.  Null ids are kept.  Other
    columns are not read.  Empty tables give no rows.
    """
    key = docs.schema[id_col].dataType
    item_key = benchmark.schema[item_id].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([
        T.StructField(id_col, key), T.StructField(item_id, item_key), T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()),
        T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(T.StructType([
            T.StructField("length", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType())])))])

    def against(items: list[tuple[object, bytes]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(items, min_match)
            for batch in batches:
                ids, out = batch.column(0), []
                for at, text in enumerate(batch.column(1)):
                    for item, size, covered, found in index.match(text.as_py(), coverage):
                        steps = [dict(zip(("length", "doc_start", "item_start"), t)) for t in found]
                        out.append((ids[at].as_py(), item, size, covered, covered / size, steps))
                if out:
                    names = schema.fieldNames()
                    types = [ids.type, None, pa.int64(), pa.int64(), pa.float64(), None]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) if t is not None else pa.array(c) for c, t in zip(zip(*out), types)], names=names)

        return rows.mapInArrow(run, schema)

    out, block, words = None, [], 0
    texts = benchmark.select(F.col(item_id).alias("id"), text_bytes(item_text).alias("text"))

    def add(done: DataFrame | None) -> DataFrame:
        part = against(block)
        return part if done is None else done.unionByName(part)

    for r in texts.toLocalIterator():
        size = len(r.text.split())
        if block and words + size > block_words:
            out, block, words = add(out), [], 0
        block.append((r.id, bytes(r.text)))
        words += size
    return add(out)
