"""Collocations (scored phrases) counted over a prefix-free parse of the texts.

A text is cut into pieces at separators, a piece into words; a mark stands between pieces.  A window of ``max_words - 1``
words and marks whose hash is a multiple of ``period`` is a trigger: a chunk ends with it and the next one begins with
it, wherever it stands, so equal passages have equal chunks except at their ends.  The distinct chunks (the dictionary)
are stored with how often the parse uses them.  Phrases are counted inside the distinct chunks, weighted by that.  Of two
chunks that share a trigger the earlier one counts the phrases that lie wholly inside it; a chunk that goes on a text says
so and leaves those out.

Before phrases are told apart as text, their hashes are counted, a size at a time: phrases of m words only where both
phrases of m - 1 words inside may be frequent.  Hashes that are frequent go into a bit table of fixed size, which may let
other phrases through but misses none.  Phrases that all tables let through are then counted as text, and these counts decide.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes

#: Between pieces; before a chunk that goes on a text; between texts or chunks that are read together.  No word holds a dot.
MARK, GOES_ON, BREAK = b".", b"...", b".."
#: Fixed value: the separators of pieces.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TO_MARK = bytes.maketrans(SEPARATORS, MARK * len(SEPARATORS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_and_marks(texts: list[bytes]) -> list[bytes]:
    """The words of texts, A-Z lower-cased, with marks between pieces and breaks between texts."""
    return b" .. ".join(t.lower().translate(_TO_MARK).replace(MARK, b" . ") for t in texts).split()


class _Numbers(dict):
    """Numbers words as they come and keeps their hashes; BREAK is 0, GOES_ON is 1, MARK is 2."""

    def __init__(self, held: int = 1_000_000):
        super().__init__()
        self.held = held
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update({BREAK: 0, GOES_ON: 1, MARK: 2})
        self.hashes = array("Q", [0, 0, crc32(MARK)])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(crc32(word))
        return number

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words, and the hash of each number."""
        if len(self) > self.held:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids, np.array(self.hashes, np.uint64)


def _phrase_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the ``size`` words from each position on that has so many behind it."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(size):
        out = (out ^ h[j:j + n]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def _to_next(stop: np.ndarray) -> np.ndarray:
    """How many positions lie from each one to the next stop (0 at a stop); the end is one."""
    n = len(stop)
    at = np.append(np.flatnonzero(stop), n)
    return at[np.searchsorted(at, np.arange(n))] - np.arange(n)


def chunks(words: list[bytes], number: _Numbers, overlap: int, period: int) -> Iterator[bytes]:
    """The chunks of texts."""
    ids, hash_of = number.of(words)
    apart = ids == 0
    left = _to_next(apart)
    first = ~apart & np.concatenate([[True], apart])[:-1]
    trigger = np.zeros(len(ids), bool)
    hashes = _phrase_hashes(hash_of[ids], overlap, 1)
    trigger[:len(hashes)] = hashes % np.uint64(period) == 0
    trigger &= (left > overlap) & ~first
    starts = np.flatnonzero(first | trigger)
    head = first[starts]
    ends = starts + left[starts]
    on = ~head[1:]  # the next chunk goes on the same text
    ends[:-1][on] = starts[1:][on] + overlap
    for a, b, h in zip(starts.tolist(), ends.tolist(), head.tolist()):
        yield b" ".join(words[a:b]) if h else b"... " + b" ".join(words[a:b])


def dictionary(docs: DataFrame, group_col: str, text_col: str, overlap: int, period: int, none_group: str, stretch: int = 1 << 20, flush: int = 200_000) -> DataFrame:
    """``group, chunk`` (binary), ``f``: the distinct chunks of each group and their frequency in the parse."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting, size = _Numbers(), Counter(), defaultdict(list), Counter()

        def count(group: str) -> None:
            words = words_and_marks(waiting.pop(group))
            size[group] = 0
            held.update((group, c) for c in chunks(words, number, overlap, period))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary()), pa.array(held.values(), pa.int64())], names=["group", "chunk", "f"])
            held.clear()
            return out

        for b in batches:
            for group, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                waiting[group].append(text)
                size[group] += len(text)
                if size[group] >= stretch:
                    count(group)
                    if len(held) >= flush:
                        yield batch()
        for group in [*waiting]:
            count(group)
            if len(held) >= flush:
                yield batch()
        if held:
            yield batch()

    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(none_group)).alias("group"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "group string, chunk binary, f bigint").groupBy("group", "chunk").agg(F.sum("f").alias("f"))


def _distinct_phrases(ids: np.ndarray, at: np.ndarray, size: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct phrase among those at ``at``, and the sums of their weights."""
    code, kinds = ids[at], int(ids.max()) + 1
    for j in range(1, size):
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) * kinds + ids[at + j]
    first, sums = _sums(code, weight)
    return at[first], sums


def _sums(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct code, and the sum of its weights."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return order[begins], np.add.reduceat(weight[order], begins)


PACKED = "group string, words array<binary>, ids binary, uses binary"


def packed(parse: DataFrame, together: int = 8 << 20) -> DataFrame:
    """``PACKED``: chunks of a group side by side (about ``together`` bytes a row), as numbers of the row's own ``words``.

    ``ids`` (32 bits each) hold a BREAK between chunks, ``uses`` (64 bits each) the chunks' frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = defaultdict(lambda: ([], [])), Counter()

        def row(group: str) -> pa.RecordBatch:
            parts, uses = waiting.pop(group)
            size[group], number = 0, _Numbers()
            ids, _ = number.of(b" .. ".join(parts).split())
            return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([[*number]], pa.list_(pa.binary())), pa.array([ids.astype(np.int32).tobytes()], pa.binary()),
                                               pa.array([np.array(uses, np.int64).tobytes()], pa.binary())], names=["group", "words", "ids", "uses"])

        for b in batches:
            for group, part, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts, uses = waiting[group]
                parts.append(part)
                uses.append(n)
                size[group] += len(part)
                if size[group] >= together:
                    yield row(group)
        for group in [*waiting]:
            yield row(group)

    return parse.mapInArrow(run, PACKED)


class _Row:
    """A row of ``PACKED``: which phrases its chunks count, and how often."""

    def __init__(self, batch: pa.RecordBatch, i: int, overlap: int):
        self.group, self.words, self.overlap = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), overlap
        self.ids = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32).astype(np.int64)
        self.chunk = np.cumsum(self.ids == 0)
        self.uses = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
        self.offset = np.arange(len(self.ids)) - np.concatenate([[0], np.flatnonzero(self.ids == 0) + 1])[self.chunk]  # in its chunk; GOES_ON stands at 0
        self.goes_on = np.zeros(self.chunk[-1] + 1, bool)
        self.goes_on[self.chunk[self.ids == 1]] = True
        self.left = _to_next(self.ids < 3)
        self.hash = np.fromiter(map(crc32, self.words), np.uint64, len(self.words))[self.ids]

    def hashes(self, size: int) -> np.ndarray:
        return _phrase_hashes(self.hash, size, crc32(self.group.encode()))

    def known(self, size: int, bits: np.ndarray) -> np.ndarray:
        """Whether the phrase at each position is in the bit table; False where none fits."""
        place, out = self.hashes(size) & np.uint64(8 * len(bits) - 1), np.zeros(len(self.ids), bool)
        out[:len(place)] = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        return out

    def own(self, size: int) -> np.ndarray:
        """Whether a phrase begins at each position that its chunk counts."""
        return (self.left >= size) & (~self.goes_on[self.chunk] | (self.offset - 1 + size > self.overlap))

    def weight(self, at: np.ndarray) -> np.ndarray:
        return self.uses[self.chunk[at]]


#: Bits of a phrase's hash that are counted.
HASH_BITS = 40
#: Hashes that a task holds before it deals them out; words of the dictionary per range; most ranges (so full deals hold HELD / MOST hashes a range).
HELD, WORDS_PER_RANGE, MOST_RANGES = 1 << 20, 1 << 20, 1 << 13


def ranges_for(words: int) -> int:
    """Ranges of hashes for a packed dictionary of so many words."""
    return min(MOST_RANGES, max(256, 1 << (words // WORDS_PER_RANGE).bit_length()))


def dealt_hashes(parse: DataFrame, size: int, overlap: int, frequent: np.ndarray | None, buckets: int) -> DataFrame:
    """``range, at, f``: the hashes of the phrases of ``size`` words over a packed dictionary and their counts, with
    ``frequent`` (a bit table) of those whose two parts of one word less are in it.

    The hashes of a task's rows, ``HELD`` at a time, are sorted and dealt to ``buckets`` (a power of two, 256 at least) ranges of hashes, side
    by side in one value per range (32 bits each, as are the counts)."""
    shared = parse.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None  # of fixed size
    low = HASH_BITS - (buckets.bit_length() - 1)  # at most 32

    def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.uint32).tobytes())])

    def counted(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of a row, ascending, and their counts."""
        row = _Row(b, i, overlap)
        own = row.own(size)
        if shared is not None:
            known = row.known(size - 1, shared.value)
            own &= known & np.append(known[1:], False)
        at = np.flatnonzero(own)
        if not len(at):
            return at, at
        h = (row.hashes(size)[at] & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
        first, sums = _sums(h, row.weight(at))
        return h[first], sums

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, f = (np.concatenate(x) for x in zip(*held))
        if len(held) > 1:
            first, f = _sums(h, f)
            h = h[first]
        begins = np.flatnonzero(np.concatenate([[True], (h[1:] >> low) != (h[:-1] >> low)]))
        ends = np.append(begins, len(h))
        return pa.RecordBatch.from_arrays([pa.array((h[begins] >> low).astype(np.int32)), binary(h & ((1 << low) - 1), ends), binary(np.minimum(f, (1 << 32) - 1), ends)], names=["range", "at", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                h, f = counted(b, i)
                if len(h):
                    held.append((h, f))
                    n += len(h)
                if n >= HELD:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    return parse.mapInArrow(run, "range int, at binary, f binary")


def frequent_hashes(parse: DataFrame, size: int, overlap: int, frequent: np.ndarray | None, min_count: int, buckets: int) -> DataFrame:
    """``h``: the ``dealt_hashes`` that come to ``min_count``.  A group adds up one range."""
    low = HASH_BITS - (buckets.bit_length() - 1)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        at, f = (np.frombuffer(b"".join(pdf[c]), np.uint32).astype(np.int64) for c in ("at", "f"))
        first, sums = _sums(at, f)
        return pd.DataFrame({"h": (np.int64(pdf["range"].iloc[0]) << low) | at[first[sums >= min_count]]})

    return dealt_hashes(parse, size, overlap, frequent, buckets).groupBy("range").applyInPandas(add, "h bigint")


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit table of ``h``: ``bits`` bits (a power of two) at any number of hashes."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # bits / 32768 rows at most
        table[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def phrase_counts(parse: DataFrame, overlap: int, tables: list[np.ndarray]) -> DataFrame:
    """``group, phrase`` (binary), ``size, f``: exact counts of the phrases of 1, 2, ... words that the bit table of their
    size lets through.  A row of size 0 with an empty phrase holds the number of all words of the group."""
    shared = parse.sparkSession.sparkContext.broadcast(tables)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = _Row(b, i, overlap)
                phrases, sizes, counts = [b""], [0], [int(row.weight(np.flatnonzero(row.own(1))).sum())]
                for size, bits in enumerate(shared.value, 1):
                    at = np.flatnonzero(row.own(size) & row.known(size, bits))
                    if len(at):
                        first, sums = _distinct_phrases(row.ids, at, size, row.weight(at))
                        phrases += [b" ".join([row.words[w] for w in ws]) for ws in row.ids[first[:, None] + np.arange(size)].tolist()]
                        sizes += [size] * len(sums)
                        counts += sums.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([row.group] * len(sizes), pa.string()), pa.array(phrases, pa.binary()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())],
                                                 names=["group", "phrase", "size", "f"])

    return parse.mapInArrow(run, "group string, phrase binary, size int, f bigint").groupBy("group", "phrase", "size").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", max_words: int = 4, min_count: int = 30, contained: int = 80, top: int | None = 2000,
                 period: int = 24, none_group: str = "und", filter_bits: int = 1 << 25) -> DataFrame:
    """One row per phrase: ``group_col, rank, phrase, a, l, r, n, score``.

    A candidate is a phrase of 2 to ``max_words`` words that occurs ``a >= min_count`` times in its group; overlapping occurrences
    count.  ``l`` and ``r`` are the counts of the parts of its lowest-scoring cut (the first of equals), ``score`` is
    floor(2000000 a / (l + r)), ``n`` the words of the group.  Candidates go that lie inside a longer one with at least ``contained`` per
    cent of their count.  ``rank`` orders by score, count, then phrase; ``top`` is the report's length per group (None: all).
    A null group is ``none_group``, a null text empty; copies count as often as they occur.  Other columns are not read.  An
    empty table, or one without candidates, gives no rows.
    """
    if max_words < 2:
        raise ValueError("phrases of two words or more are needed")
    overlap = max_words - 1
    parse = stored(packed(dictionary(docs, group_col, text_col, overlap, period, none_group)), "phrases-dictionary")
    tables: list[np.ndarray] = []
    buckets = ranges_for((parse.agg(F.sum(F.length("ids"))).first()[0] or 0) // 4)  # by the words, however many rows hold them
    for size in range(1, max_words + 1):
        found = frequent_hashes(parse, size, overlap, tables[-1] if tables else None, min(min_count, (1 << 32) - 1), buckets)
        tables.append(bit_table(found, filter_bits))
    counts = phrase_counts(parse, overlap, tables).where((F.col("f") >= min_count) | (F.col("size") == 0))
    counts = stored(counts.select("group", F.col("phrase").cast("string").alias("phrase"), "size", "f"), "phrases-counts")
    words = counts.where("size = 0").select("group", F.col("f").alias("n"))
    known, candidates = counts.where(F.col("size").between(1, max_words - 1)), counts.where("size > 1")

    cuts = candidates.select("group", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = known.select("group", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("group", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cuts = cuts.join(left, ["group", "first"]).join(right, ["group", "rest"]).select("group", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    lowest = cuts.groupBy("group", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    inner = "transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(split(phrase, ' '), i, s), ' ')))"
    longer = candidates.where("size > 2").select("group", F.explode(F.expr(f"flatten({inner})")).alias("phrase"), "f").groupBy("group", "phrase").agg(F.max("f").alias("outer"))
    left_over = lowest.join(longer, ["group", "phrase"], "left").where(F.col("outer").isNull() | F.expr(f"cast(100 as decimal(3,0)) * cast(outer as decimal(19,0)) < cast({int(contained)} as decimal(10,0)) * cast(a as decimal(19,0))"))
    ranked = left_over.select("group", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "group").select(F.col("group").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
