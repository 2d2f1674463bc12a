"""Ranked lexical search: the best documents of every query by reading impact-sorted lists in step (NRA).

What a word adds to a document's score (its impact) depends on the word's weight, its count in the document and
the document's length.  The documents are cut into shards of a fixed number; a shard holds a list per query word,
sorted by impact.  A query reads its lists front to back, a slice of each per round.  What has been read of a document is
the lower end of its score; the upper end adds, for each list it has not been met in, the impact at
which that list stands.  A document is out once its upper end is below the k-th best score so far, in this shard
or earlier ones of the task; reading goes on until all others have equal ends, so members, ties and scores are final.

Queries are taken in blocks of bounded size.  The corpus is read twice in all: once for lengths and counts
(only words whose hash is in a bit table of the queries' words are kept), and the kept counts once per block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes
from vigil.operators.scan import running_totals
from vigil.session import scratch_dir

#: Bytes that stand between terms: ASCII other than 0-9, A-Z and a-z.
_BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))

#: Score of a word met ``tf`` times in a document of length measure ``m``, before its weight: integers throughout.
SCALE = 1_000_000_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, A-Z lower-cased."""
    return text.lower().translate(_TO_SPACE).split()


def word_weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def length_measure(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The length measure of documents of ``n`` terms."""
    if int(n.max(initial=0)) * 25 * n_docs < 2 ** 62:
        return 75 + (25 * n * n_docs) // max(1, all_terms)
    return np.array([75 + (25 * int(x) * n_docs) // all_terms for x in n], np.int64)


def query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query, word, q``: the words of each query (a string) and how often it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(terms(t.as_py())) for t in b.column(1)]
            at = np.repeat(np.arange(b.num_rows), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([w.decode() for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())],
                                             names=["query", "word", "q"])

    kind = queries.schema[id_col].dataType.simpleString()
    return queries.select(F.col(id_col).alias("query"), text_bytes(text_col).alias("text")).mapInArrow(run, f"query {kind}, word string, q bigint")


def _bit_table(words: DataFrame, bits: int) -> np.ndarray:
    """The bit table of ``word``: ``bits`` bits at any number of words."""
    bit = F.crc32(F.col("word").cast("binary")) % bits + 1
    rows = words.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # bits / 32768 rows at most
        table[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def term_counts(docs: DataFrame, id_col: str, text_col: str, asked: np.ndarray, most: int = 8 << 20, held: int = 500_000) -> DataFrame:
    """``id, n, words, tf``: the terms of each document, and the counts of those that ``asked`` (a bit table) may hold.
    Documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value, 8 * len(shared.value)

        class Asked(dict):
            def __missing__(self, word: bytes) -> bool:
                at = crc32(word) % bits
                out = self[word] = bool(table[at >> 3] >> (at & 7) & 1)
                return out

        memo = Asked()
        for b in batches:
            rows, sizes, words, counts, kept = [], [], [], [], 0
            offsets = [0]

            def batch() -> pa.RecordBatch:
                at = pa.array(offsets, pa.int32())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(words, pa.binary()).cast(pa.string())),
                                                   pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["id", "n", "words", "tf"])

            for i, text in enumerate(b.column(1)):
                ws = terms(text.as_py())
                if not ws:
                    continue
                if len(memo) > held:
                    memo.clear()
                own = Counter(ws)
                mine = [w for w in own if memo[w]]
                words += mine
                counts += map(own.__getitem__, mine)
                rows.append(i)
                sizes.append(len(ws))
                offsets.append(len(words))
                kept += len(ws)
                if kept > most:
                    yield batch()
                    rows, sizes, words, counts, kept, offsets = [], [], [], [], 0, [0]
            if rows:
                yield batch()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, words array<string>, tf array<bigint>")


class Shard:
    """The impact-sorted lists of a number of documents: list ``w`` is ``doc[start[w]:start[w + 1]]`` with ``impact``."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, impact: np.ndarray, n_docs: int, n_words: int):
        order = np.lexsort((-impact, word))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.start = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])

    def search(self, words: np.ndarray, times: np.ndarray, floor: np.ndarray, k: int, first: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Documents that belong among the ``k`` best, and their scores.  ``floor``: scores of earlier shards' best, that they must reach."""
        at, ends = self.start[words].copy(), self.start[words + 1]
        lists = np.flatnonzero(at < ends)  # a word that the shard lacks adds nothing
        words, times, at, ends = words[lists], times[lists], at[lists], ends[lists]
        lower = np.zeros(self.n_docs, np.int64)
        met = np.zeros((len(words), self.n_docs), bool)
        stands = times * self.impact[at]  # what the list may still give to a document not met in it
        step = first
        while True:
            rest = stands.sum()
            best = np.concatenate([floor, lower])
            bar = max(1, int(np.partition(best, len(best) - k)[len(best) - k])) if len(best) >= k else 1
            upper = lower + rest
            may = np.flatnonzero(upper >= bar)
            if len(may):
                upper = upper[may] - stands @ met[:, may]
                keep = upper >= bar
                may, upper = may[keep], upper[keep]
            if not len(may) or bool((upper == lower[may]).all()):
                return may, lower[may]
            for j in np.flatnonzero(at < ends):
                to = min(at[j] + step, ends[j])
                docs = self.doc[at[j]:to]
                lower[docs] += times[j] * self.impact[at[j]:to]
                met[j, docs] = True
                at[j] = to
                stands[j] = times[j] * self.impact[to - 1] if to < ends[j] else 0
            step *= 4


def _block_search(counted: DataFrame, block: dict[int, list[tuple[str, int]]], weights: dict[str, int], n_docs: int, all_terms: int, k: int, shard: int) -> DataFrame:
    """``query, id, score``: what each task's shards hold among the ``k`` best of the block's queries."""
    vocabulary = sorted(weights)
    number = {w: i for i, w in enumerate(vocabulary)}
    asked = [(query, np.array([number[w] for w, _ in q], np.int64), np.array([n for _, n in q], np.int64)) for query, q in block.items()]
    shared = counted.sparkSession.sparkContext.broadcast((vocabulary, np.array([weights[w] for w in vocabulary], np.int64), asked))  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, asked = shared.value
        known, top = pa.array(vocabulary, pa.string()), [(np.zeros(0, np.int64), []) for _ in asked]

        def search(parts: list[pa.RecordBatch]) -> None:
            ids = pa.concat_arrays([p.column(0) for p in parts])
            n = np.concatenate([np.asarray(p.column(1)) for p in parts])
            sizes = np.concatenate([np.asarray(p.column(2).value_lengths()) for p in parts])
            word = np.concatenate([np.asarray(pc.fill_null(pc.index_in(p.column(2).flatten(), value_set=known), -1)) for p in parts]).astype(np.int64)
            tf = np.concatenate([np.asarray(p.column(3).flatten()) for p in parts]).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), sizes)
            mine = word >= 0
            doc, word, tf = doc[mine], word[mine], tf[mine]
            impact = weight[word] * ((SCALE * tf) // (1000 * tf + 12 * length_measure(n, n_docs, all_terms)[doc]))
            here = Shard(doc, word, impact, len(n), len(vocabulary))
            for i, (_, words, times) in enumerate(asked):
                floor, held = top[i]
                docs, scores = here.search(words, times, floor, k)
                if len(docs):
                    held = sorted(held + list(zip((-scores).tolist(), ids.take(pa.array(docs)).to_pylist())), key=lambda x: (x[0], x[1] is not None, 0 if x[1] is None else x[1]))[:k]
                    top[i] = np.array([-s for s, _ in held], np.int64), held

        waiting, rows = [], 0
        for b in batches:
            for a in range(0, b.num_rows, shard):
                part = b.slice(a, shard)
                if rows + part.num_rows > shard:
                    search(waiting)
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if waiting:
            search(waiting)
            out = [(query, doc, -s) for (query, _, _), (_, held) in zip(asked, top) for s, doc in held]
            if out:
                query, doc, score = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, waiting[0].column(0).type), pa.array(score, pa.int64())], names=["query", "id", "score"])

    return counted.select("id", "n", "words", "tf").mapInArrow(run, f"query bigint, id {counted.schema['id'].dataType.simpleString()}, score bigint")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
                  block_words: int = 200_000, shard: int = 8192, filter_bits: int = 1 << 23) -> DataFrame:
    """One row per query and document: ``query_id, rank, id_col, score``, the ``k`` best documents of each query.

    Equal scores are ranked by ascending id (a null id first); documents of score 0 are left out.  Rows with equal ids are
    documents of their own, and so are queries with equal ids (each has its ranks).  A null or empty text has no
    terms: such a query has no rows.  Other columns are not read.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    numbered = queries.select(F.col(query_id).alias("id"), F.col(query_text).alias("text")).withColumn("query", F.monotonically_increasing_id())
    numbered = stored(numbered, "search-queries")
    words = stored(query_words(numbered, "query", "text"), "search-query-words")
    counted = stored(term_counts(docs, id_col, text_col, _bit_table(words, filter_bits)), "search-counts")
    n_docs, all_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weighted = words.join(df, "word").select("query", "word", "q", word_weight(F.lit(n_docs), F.col("df")).alias("w"))

    sizes = running_totals(words.groupBy("query").agg(F.count(F.lit(1)).alias("size")), "query", ["size"])
    blocks = sizes.select("query", F.expr(f"(size_cum - size) div {block_words}").cast("int").alias("block"))  # block_words and one query more at most
    dealt = stored(weighted.join(blocks, "query"), "search-weights")
    last = dealt.agg(F.max("block")).first()[0]
    folder = scratch_dir(spark, "search-found")
    kind = docs.schema[id_col].dataType.simpleString()
    for number in range(0 if last is None else last + 1):
        block: dict[int, list] = {}
        weights: dict[str, int] = {}
        for r in dealt.where(F.col("block") == number).select("query", "word", "q", "w").collect():
            block.setdefault(r["query"], []).append((r["word"], r["q"]))
            weights[r["word"]] = r["w"]
        if block:
            found = _block_search(counted, block, weights, n_docs, all_terms, k, shard)
            found.write.parquet(f"{folder}/block={number}")
    found = spark.read.schema(f"query bigint, id {kind}, score bigint").parquet(f"{folder}/block=*") if last is not None else spark.createDataFrame([], f"query bigint, id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(numbered.select("query", F.col("id").alias("name")), "query").select(F.col("name").alias(query_id), "rank", F.col("id").alias(id_col), "score")
