import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vigil.llm.topk import Shard, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """(query, rank, doc, score) by scoring every document for every query."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in queries:
        asked = Counter(terms(text))
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def result(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def tables(seed, n):
    r = random.Random(seed)
    words = ["Ab", "ab", "x9", "é", "É", "ñu", "the", "the", "the", "q", "日本", "z-z"] + [f"w{i}" for i in range(30)]
    docs = [(i, "".join(w + r.choice([" ", ",", "\n", "\x00", "_"]) for w in r.choices(words, k=r.randrange(0, 25)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, n // 2)] + [(n * 3, None), (n * 3 + 1, ""), (n * 3 + 2, "the " * 20_000), (None, "ab w1 w2"), (5, "ab w1 w2"), (5, "ab w1 w2")]
    queries = [(j, " ".join(r.choices(words, k=r.randrange(0, 12)))) for j in range(25)] + [(100, None), (101, "unknownword"), (102, "the the the"), (103, "w1 w2 ab"), (None, "w3")]
    return docs, queries


@pytest.mark.parametrize("seed,k,shard,block", [(1, 20, 8192, 200_000), (2, 5, 7, 20), (3, 1, 16, 1), (4, 1000, 33, 50)])
def test_equals_brute_force(spark, seed, k, shard, block):
    docs, queries = tables(seed, 120)
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in queries], "item_id long, text string, score int")
    got = result(ranked_search(d, q, k=k, shard=shard, block_words=block, filter_bits=1 << 15))
    assert sorted(got, key=str) == sorted(brute(docs, queries, k), key=str)


def test_reading_stops_early():
    """With a clear best document little of the lists is read."""
    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    word = np.repeat([0, 1], n)
    impact = np.concatenate([np.arange(n, 0, -1), np.arange(n, 0, -1)])
    impact[0] = impact[n] = 10**6
    here = Shard(doc, word, impact, n, 2)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    here.doc = here.doc.view(Watched)
    docs, scores = here.search(np.array([0, 1]), np.array([1, 1]), np.zeros(0, np.int64), 1)
    assert docs.tolist() == [0] and scores.tolist() == [2 * 10**6] and sum(read) < n / 4


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert ranked_search(docs.limit(0), queries).collect() == [] and ranked_search(docs, queries.limit(0)).collect() == []
    assert ranked_search(docs, queries).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in ranked_search(docs, queries).collect()] == [(*x,) for x in brute([(1, "a")], [("i", "a b")], 20)]
