"""Language-model scores by a hashed maximum-entropy model.

Tokens are lower-cased words and an end.  A word falls into a bucket (hash), buckets into classes, and

    p(word | history) = p(class | history) p(subclass | class, history) p(bucket | subclass, history) p(word | bucket)

The first three are softmax layers over hashed features of the history: the word before, the pair before
and the word before that (skip).  The last is the add-one share of the word among its bucket's training
counts, one share being left for words not seen.  The layers start from the bucket counts; in each
round every task runs gradient steps over its rows of a slice of the training texts, and the mean of the
tasks' changes, weighted by their tokens, updates the shared weights.  The slices make up all training texts.

Counts of frequent words (a bounded list) are looked up inside the tasks, those of all other words by a
join, so neither the vocabulary nor a hot word bounds the size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes

END = b"\n"
WIDTHS = (8, 8, 16)  # classes, subclasses of a class, buckets of a subclass
BUCKETS = 8 * 8 * 16
ROWS = 1 << 15  # hashed rows of each layer
FEATURES = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> list[bytes]:
    """Words lower-cased in A-Z, then the end."""
    return [*text.lower().split(), END]


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    return (x >> np.uint64(65 - ROWS.bit_length())).astype(np.int64)


def history(words: np.ndarray) -> np.ndarray:
    """Feature rows (tokens, FEATURES) of one text from its words' hashes."""
    one = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
    two = np.concatenate([np.zeros(1, np.uint64), one[:-1]])
    return np.stack([_hashed(one, 1), _hashed(two * _B + one, 2), _hashed(two, 3)], axis=1)


class Model:
    """Weights of each layer k: ``wk`` (its width, ROWS) and biases ``bk`` (its width, outputs of the layers above it)."""

    def __init__(self, bucket_counts: np.ndarray):
        self.w, above, share = {}, 1, (bucket_counts + 1.0) / (bucket_counts.sum() + BUCKETS)
        for k, width in enumerate(WIDTHS):
            own = share.reshape(above, width, -1).sum(axis=2)
            self.w[f"w{k}"] = np.zeros((width, ROWS), np.float32)
            self.w[f"b{k}"] = np.log(own / own.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
            above *= width
        self.seen = {k: np.zeros_like(v) for k, v in self.w.items()}

    def bounded(self) -> bool:
        """Whether no logit can be too large for ``exp`` as it is."""
        return all(FEATURES * np.abs(self.w[f"w{k}"]).max() + np.abs(self.w[f"b{k}"]).max() < 80 for k in range(len(WIDTHS)))

    def _layers(self, rows: np.ndarray, bucket: np.ndarray, shift: bool = True) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """For each layer: its number, feature rows, the outputs chosen above and in it, logits (outputs, tokens), with ``shift`` 0 as the largest."""
        outer, below = [np.ascontiguousarray(r) for r in rows.T], BUCKETS
        above = np.zeros(len(bucket), np.int64)
        for k, width in enumerate(WIDTHS):
            below //= width
            chosen = bucket // below % width
            at = [(r * 31 + (above + k) * 977) & (ROWS - 1) for r in outer] if k else outer
            w = self.w[f"w{k}"]
            logits = w.take(at[0], axis=1)
            for r in at[1:]:
                logits += w.take(r, axis=1)
            logits += self.w[f"b{k}"].take(above, axis=1)
            if shift:
                logits -= logits.max(axis=0)
            yield k, at, above, chosen, logits
            above = above * width + chosen

    def log10(self, rows: np.ndarray, bucket: np.ndarray, shift: bool = True) -> np.ndarray:
        """log10 p(bucket | history) of each token; a ``bounded`` model needs no ``shift``."""
        at, out = np.arange(len(bucket)), np.zeros(len(bucket))
        for _, _, _, y, logits in self._layers(rows, bucket, shift):
            picked = logits[y, at].astype(np.float64)
            np.exp(logits, out=logits)
            out += picked - np.log(logits.sum(axis=0))
        return out / np.log(10)

    def step(self, rows: np.ndarray, bucket: np.ndarray, rate: float) -> None:
        """One AdaGrad step on the log-loss of a mini-batch."""
        at = np.arange(len(bucket))
        for k, r, above, y, p in self._layers(rows, bucket):
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            p[y, at] -= 1
            w, b = self.w[f"w{k}"], self.w[f"b{k}"]
            flat, g = np.concatenate(r), np.empty(w.shape, np.float32)
            for j, error in enumerate(p):
                g[j] = np.bincount(flat, np.tile(error, FEATURES), ROWS)
            self._move(f"w{k}", g, rate)
            self._move(f"b{k}", np.stack([np.bincount(above, e, b.shape[1]) for e in p]).astype(np.float32), rate * 0.1)

    def _move(self, name: str, g: np.ndarray, rate: float) -> None:
        seen = self.seen[name]
        seen += g * g
        size = np.sqrt(seen + np.float32(100.0))  # rare features move little
        g *= np.float32(rate)
        g /= size
        self.w[name] -= g

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _encoded(texts: Iterator[bytes], at_least: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[list[bytes]]]]:
    """Feature rows and buckets of whole texts taken together, the texts' token counts and their tokens."""
    rows, buckets, sizes, words, total = [], [], [], [], 0
    for text in texts:
        ws = tokens(text)
        h = np.fromiter(map(crc32, ws), dtype=np.uint64, count=len(ws))
        rows.append(history(h))
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
        sizes.append(len(ws))
        words.append(ws)
        total += len(ws)
        if total >= at_least:
            yield np.concatenate(rows), np.concatenate(buckets), sizes, words
            rows, buckets, sizes, words, total = [], [], [], [], 0
    if sizes:
        yield np.concatenate(rows), np.concatenate(buckets), sizes, words


def word_counts(docs: DataFrame, text_col: str, flush: int = 300_000) -> DataFrame:
    """``word`` (binary), ``c`` over all texts; tasks count up to ``flush`` distinct words at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column(0):
                held.update(tokens(text.as_py()))
                if len(held) >= flush:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return docs.select(text_bytes(text_col).alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _mean_change(changes: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    """Token-weighted mean of the tasks' changes, summed in a tree of bounded groups, block by block."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.float32) for b in pdf["part"]], axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "task": [pdf["task"].iloc[0] // fan_in], "tokens": [int(pdf["tokens"].sum())], "part": [total.astype(np.float32).tobytes()]})

    schema, tasks = "block int, task bigint, tokens bigint, part binary", max(2, changes.rdd.getNumPartitions())
    while tasks > 1:
        changes = changes.groupBy("block", F.expr(f"task div {fan_in}").alias("up")).applyInPandas(add, schema)
        tasks = -(-tasks // fan_in)
    blocks = sorted(changes.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["part"], np.float32) / max(1, r["tokens"]) for r in blocks]) if blocks else None


def train(docs: DataFrame, bucket_counts: np.ndarray, text_col: str, rounds: int = 2, rate: float = 1.0, minibatch: int = 32768, block: int = 1 << 16) -> Model:
    """The model after ``rounds`` distributed updates, each over the texts of one slice."""
    model = Model(bucket_counts)
    spark = docs.sparkSession
    rows = docs.select(text_bytes(text_col).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(rounds)).alias("slice"))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total, start = None, 0, None
            texts = (t.as_py() for b in batches for t in b.column(0))
            for feats, buckets, sizes, _ in _encoded(texts, minibatch):
                if own is None:
                    own = Model(np.zeros(BUCKETS))
                    start = shared.value.flat()
                    own.load(start)
                for at in range(0, len(buckets), minibatch):
                    own.step(feats[at:at + minibatch], buckets[at:at + minibatch], rate)
                total += len(buckets)
            if own is not None:
                change = (own.flat() - start) * np.float32(total)
                task = TaskContext.get().partitionId()
                for i, at in enumerate(range(0, len(change), block)):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "task": [task], "tokens": [total], "part": [change[at:at + block].tobytes()]})

        changes = rows.where(F.col("slice") == number).select("text").mapInArrow(run, "block int, task bigint, tokens bigint, part binary")
        mean = _mean_change(changes)
        if mean is not None:
            model.load(model.flat() + mean)
    model.seen = {}
    return model


class _Head(dict):
    """Counts of the frequent words; 0 for any other."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _frequent(vocabulary: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the highest count classes (eighths of a power of two) that hold at most ``most`` words together;
    the driver gets the classes' sizes and these words only."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r["level"]: r["count"] for r in vocabulary.groupBy(level.alias("level")).count().collect()}
    total, least = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in vocabulary.where(level >= least).collect()}


def score_texts(docs: DataFrame, held_out: Column, head_words: int = 200_000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The documents that are not ``held_out`` are learned from.  ``base_score`` is the add-one unigram log10
    probability, ``score`` the model's.  A null or empty text is an end alone.  Repeated ids and texts are scored row by
    row; a null id stays.  Other columns than those of ``held_out`` are not read.  Without a training text every
    count is 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    learned = docs.where(~held_out)
    vocabulary = stored(word_counts(learned, text_col), "lm-words")
    bucket = F.crc32("word") % BUCKETS
    by_bucket = vocabulary.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # BUCKETS rows at most
    counts, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in by_bucket:
        counts[r["bucket"]], kinds[r["bucket"]] = r["c"], r["v"]
    n_all, n_kinds = int(counts.sum()), int(kinds.sum())
    head = _frequent(vocabulary, head_words)
    model = train(learned, counts, text_col, rounds)
    shared = spark.sparkContext.broadcast((head, model, np.log10(counts + kinds + 1)))  # head_words words and the fixed weights

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model, of_bucket = shared.value
        count, shift = _Head(head).__getitem__, not model.bounded()
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for feats, buckets, sizes, words in _encoded(t.as_py() for t in batch.column(2)):
                parts = [model.log10(feats[i:i + 8192], buckets[i:i + 8192], shift) for i in range(0, len(buckets), 8192)]
                each = np.concatenate(parts) - of_bucket[buckets]
                starts = np.cumsum(sizes) - sizes
                inner = np.add.reduceat(each, starts)
                known, logs, rare = [], [], []
                for ws in words:
                    c = np.fromiter(map(count, ws), dtype=np.int64, count=len(ws))
                    seen = c > 0
                    known.append(int(seen.sum()))
                    logs.append(float(np.log10(c + 1.0).sum()))
                    rare.append([{"word": w, "n": n} for w, n in Counter([ws[i] for i in np.flatnonzero(~seen)]).items()])
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(np.arange(number, number + k) + (task << 33), pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(inner, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                    names=["id", "held_out", "row", "n_tokens", "known", "logs", "inner", "rare"])
                at, number = at + k, number + k

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(rows.mapInArrow(run, f"id {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, logs double, inner double, rare array<struct<word:binary,n:bigint>>"), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(vocabulary, "word")
    late = rare.groupBy("row").agg(F.sum("n").alias("late_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("late_logs"))
    logs = F.col("logs") + F.coalesce("late_logs", F.lit(0.0))
    return scored.drop("rare").join(late, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_kinds + 1)))).alias("base_score"), (logs + F.col("inner")).alias("score"))
