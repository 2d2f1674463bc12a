"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of the frequent words.

``encode`` counts the words (the pieces that the splitting rule cuts) of all texts, compiles the most frequent
ones with their ids into a transducer (``vigil.llm.transducer``), writes it to the shared folder and lets
Spark copy it to every executor, whose tasks map it into memory.  A task looks up each distinct word of a stretch of
texts once; words that the lexicon lacks are merged pair by pair, exactly.  The lexicon decides the speed only.
The most words it can hold are a parameter, so the driver and the file are bounded at any input size.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from vigil.llm.common import stored
from vigil.llm.transducer import Lexicon, compile_lexicon, ragged
from vigil.session import scratch_dir

#: Fixed value: the splitting rule of byte-level BPE files, with the classes of letters, numbers and white space left open.
RULE = r"'(?:[stmd]|re|ve|ll)| ?[{L}]++| ?[{N}]++| ?[^{S}{L}{N}]++|[{S}]+(?![^{S}])|[{S}]+"

#: Texts whose characters all lie below this point are split by the faster engine, with the classes written out.
LOW_END = 0x250


def _ranges(points: Iterable[int]) -> str:
    """A character class body for ascending code points."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def _splitters() -> tuple[re.Pattern, re.Pattern, regex.Pattern]:
    """Finds a character that the low rule does not know; the low rule; the rule for any text.

    ``regex`` may know letters and numbers that are newer than the library's tables; the library is asked for those
    which Python's own tables lack, and what it takes for neither is neither here."""
    of = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s")}
    low = {k: _ranges(c for c in range(LOW_END) if p.match(chr(c)) and unicodedata.category(chr(c)) != "Cn") for k, p in of.items()}
    either, pieces = regex.compile(r"[\p{L}\p{N}]"), ByteLevel(add_prefix_space=False).pre_tokenize_str
    blocks = ("".join(c for c in map(chr, range(at, at + 0x1000)) if unicodedata.category(c) == "Cn") for at in range(0, 0x110000, 0x1000))
    newer = _ranges(ord(c) for block in blocks for c in either.findall(block) if len(pieces(f"a{c}")) > 1 and len(pieces(f"1{c}")) > 1)
    less = f"--[{newer}]" if newer else ""
    rule = RULE.replace("[^{S}{L}{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]{f'|[{newer}]' if newer else ''})").replace("[^{S}]", r"\S")
    wide = rule.replace("[{L}]", rf"[\p{{L}}{less}]").replace("[{N}]", rf"[\p{{N}}{less}]").replace("[{S}]", r"\s")
    return re.compile(f"[^\\x00-\\u{LOW_END - 1:04x}]"), re.compile(RULE.format(**low)), regex.compile(wide, regex.V1)


def split_words(text: str) -> list[str]:
    """The words of a text without added tokens."""
    high, low, wide = _splitters()
    return wide.findall(text) if high.search(text) else low.findall(text)


class Vocabulary:
    """A byte-level BPE file: merges as sorted pairs, the bytes of every id, the added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError("a byte-level BPE file without normaliser, dropout, affixes and prefix space is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that match as they are written are needed")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbol = {b: chr(b) for b in printable}  # a byte is written as itself or, if it does not print, as one from 256 on
        symbol |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in symbol)}
        byte = {c: b for b, c in symbol.items()}
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order.astype(np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content = {i: w for w, i in vocab.items()} | {i: w for w, i in self.added.items()}
        text = [bytes(map(byte.get, w)) if all(c in byte for c in w) else w.encode() for w in (content.get(i, "") for i in range(max(content, default=-1) + 1))]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size

    @property
    def none(self) -> int:
        """A rank above all."""
        return len(self.made)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours."""
        if not len(self.pair):
            return np.zeros(len(left), np.int64)
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.rank[at], self.none)

    def merge(self, words: list[bytes], longest: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids one after the other; words over ``longest`` bytes go one by one."""
        short = [i for i, w in enumerate(words) if len(w) <= longest]
        count, ids = self._merge_short([words[i] for i in short])
        if len(short) == len(words):
            return count, ids
        parts, counts = dict(zip(short, np.split(ids, np.cumsum(count)[:-1]))) if short else {}, np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if i not in parts:
                parts[i] = self._merge_long(w)
            counts[i] = len(parts[i])
        return counts, np.concatenate([parts[i] for i in range(len(words))])

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words in step: each merges its pair of least rank, the first one of equal pairs."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), self.none, np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(best < self.none, lengths)
            done.append((word[~open_], sym[~open_]))
            best = np.repeat(best, lengths)[open_]
            sym, word, rank = sym[open_], word[open_], rank[open_]
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                inside = (p + 1 < len(sym)) & (word[np.minimum(p + 1, len(sym) - 1)] == word[p])
                rank[p[~inside]] = self.none
                p = p[inside]
                rank[p] = self.ranks(sym[p], sym[p + 1])
        if not done:
            return size, sym
        word, sym = (np.concatenate(c) for c in zip(*done))
        return np.bincount(word, minlength=len(words)).astype(np.int64), sym[np.argsort(word, kind="stable")]

    @cached_property
    def _by_pair(self) -> dict[int, int]:
        return dict(zip(self.pair.tolist(), self.rank.tolist()))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word by a heap of its pairs."""
        ranks, made = self._by_pair, self.made
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = int(made[r]), -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (k := left[i]) >= 0 and (r := ranks.get(sym[k] << 32 | sym[i])) is not None:
                heapq.heappush(heap, (r, k, sym[k], sym[i]))
        return np.array([s for s in sym if s >= 0], np.int64)


@cache
def _added(tokens: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")")


def _words(text: str, added: dict[str, int]) -> list:
    """The words of a text; an added token stands as a tuple of its id."""
    if not any(t in text for t in added):
        return split_words(text)
    parts = _added(tuple(added)).split(text)
    return [w for i, part in enumerate(parts) for w in ([(added[part],)] if i % 2 else split_words(part))]


def word_counts(docs: DataFrame, text_col: str, added: dict[str, int], flush: int = 300_000) -> DataFrame:
    """``word`` (binary), ``n``: how often each word stands in all texts.  Tasks count up to ``flush`` distinct words at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            words = [w for w in held if isinstance(w, str)]
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                held.update(_words(text.as_py(), added))
                if len(held) >= flush:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int, longest: int = 64) -> list[bytes]:
    """The most frequent words, ``most`` at most, in byte order: ties are kept or left together.  The driver gets the
    number of words of each of the higher counts and the words that are kept."""
    counts = stored(counts.where((F.col("n") > 1) & (F.length("word") <= longest)), "bpe-words")
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # 16 levels a power of two
    total, least = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    return [] if least is None else sorted(bytes(r["word"]) for r in counts.where(level >= least).select("word").collect())


def lexicon_of(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The compiled transducer of ``words`` (in byte order) with their ids."""
    count, ids = vocabulary.merge(words)
    each = np.split(ids, np.cumsum(count)[:-1]) if words else []
    return compile_lexicon((w, tuple(i.tolist())) for w, i in zip(words, each))


def _share(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` to the shared folder and have Spark copy it to every executor; returns its name there."""
    path = scratch_dir(spark, "lexicon")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


class Encoder:
    """Encodes texts with a lexicon; remembers the ids of up to ``held`` distinct words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, held: int = 150_000):
        self.vocabulary, self.lexicon, self.held = vocabulary, lexicon, held
        self._forget()

    def _forget(self) -> None:
        self.number: dict = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        found, count_in, ids_in = self.lexicon.look_up(raw)
        count_out, ids_out = self.vocabulary.merge([w for w, f in zip(raw, found) if not f])
        count = np.empty(len(raw), np.int64)
        count[found], count[~found] = count_in, count_out
        start = np.empty(len(raw), np.int64)
        start[found] = np.cumsum(count_in) - count_in
        start[~found] = np.cumsum(count_out) - count_out + len(ids_in)
        self.number.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.start = np.concatenate([self.start, start + len(self.ids)])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids_in, ids_out.astype(np.int32)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids one after the other."""
        added = self.vocabulary.added
        words = [_words(t, added) for t in texts]
        if len(self.number) > self.held:
            self._forget()
        new = set().union(*words).difference(self.number)
        marks = [w for w in new if not isinstance(w, str)]
        self._learn([w for w in new if isinstance(w, str)])
        for mark in marks:
            self.number[mark] = len(self.count)
            self.start, self.count, self.ids = np.append(self.start, len(self.ids)), np.append(self.count, 1), np.append(self.ids, np.int32(mark[0]))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(ends[bounds]), self.ids[ragged(self.start[at], count)]


def _stretches(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about ``most`` bytes of the column, one row at least."""
    at, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def _texts(rules: Vocabulary, counts: np.ndarray, ids: np.ndarray) -> list[str]:
    """The texts of id sequences that stand one after the other; ids that the file lacks are left out."""
    known = (ids >= 0) & (ids < len(rules.text_size))
    at = np.where(known, ids, 0)
    size = np.where(known, rules.text_size[at], 0)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    raw = rules.text[ragged(rules.text_start[at], size)].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None, stretch: int = 1 << 19) -> DataFrame:
    """One row per document: ``id_col, ids`` (array of int), the ids of the whole text.

    ``decoded`` names a further column: the text that the ids stand for, decoded in the same pass.  Added tokens in a text are
    their ids, as the file's tokenizer has it; truncation and padding are not used.  A null or empty text has no
    ids.  Repeated ids and texts are encoded row by row, a null id stays; other columns are not read.  An
    empty table gives no rows.
    """
    spark, rules = docs.sparkSession, Vocabulary(vocabulary)
    lexicon = lexicon_of(frequent_words(word_counts(docs, text_col, rules.added), lexicon_words), rules)
    name = _share(spark, lexicon)
    shared = spark.sparkContext.broadcast(rules)  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        encoder = Encoder(rules, Lexicon.mapped(SparkFiles.get(name)))
        for batch in batches:
            for a, b in _stretches(batch, 1, stretch):
                part = batch.slice(a, b - a)
                count, ids = encoder(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                columns = {"id": part.column(0), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))}
                if decoded:
                    columns["decoded"] = pa.array(_texts(rules, count, ids), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>" + (", decoded string" if decoded else ""))
    return out.select(F.col("id").alias(id_col), "ids", *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: ``id_col, ids, text``, the text that the ids stand for (added tokens included).

    Bytes that are not UTF-8 become U+FFFD, ids that the file lacks (and null ones) are left out; null or no ids give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(1)
                counts, ids = np.asarray(column.value_lengths().fill_null(0), np.int64), np.asarray(column.flatten().fill_null(-1), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(_texts(shared.value, counts, ids), pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)
