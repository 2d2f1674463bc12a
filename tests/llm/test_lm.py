import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import lm


def brute_base(rows, held):
    toks = [[*(t or "").encode().lower().split(), lm.END] for _, t in rows]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in toks]


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5001, None), (5002, ""), (5003, "A a\x0bB unseenword"), (5003, "A a\x0bB unseenword"), (None, "no id " * 9000)]
    df = spark.createDataFrame([(a, b, 1.5) for a, b in rows], "doc_id long, text string, score double").repartition(3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    is_held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    n, want = brute_base(rows, is_held)
    got = lm.score_texts(df, held, head_words=50).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    b = sorted(((d, h, *w) for (d, _), h, w in zip(rows, is_held, want)), key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4] for x in a], [x[4] for x in b], rtol=1e-9)
    out = [x for x in a if x[1]]
    assert sum(x[5] for x in out) > sum(x[4] for x in out)  # better than the unigram on texts not learned from


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, lm.BUCKETS).astype(float)
    model = lm.Model(counts)
    words = np.tile(rng.integers(1, 2**32, 40).astype(np.uint64), 60)
    feats, buckets = lm.history(words), (words % np.uint64(lm.BUCKETS)).astype(np.int64)
    one = feats[:1].repeat(lm.BUCKETS, axis=0)
    before = model.log10(feats, buckets).mean()
    for _ in range(20):
        model.step(feats, buckets, 0.15)
    assert abs((10 ** model.log10(one, np.arange(lm.BUCKETS))).sum() - 1) < 1e-4
    assert model.log10(feats, buckets).mean() > before + 1


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    model = lm.Model(np.ones(lm.BUCKETS))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    words = rng.integers(1, 2**32, 30).astype(np.uint64)
    feats, buckets = lm.history(words), (words % np.uint64(lm.BUCKETS)).astype(np.int64)
    seen = {}
    model._move = lambda name, g, rate: seen.setdefault(name, g)
    model.step(feats, buckets, 1.0)
    for name in ("w0", "w1", "w2"):
        g = seen[name]
        for _ in range(5):
            i, j = rng.integers(g.shape[0]), rng.choice(np.flatnonzero(g.any(axis=0)))
            loss = []
            for d in (1e-4, -1e-4):
                model.w[name][i, j] += d
                loss.append(-model.log10(feats, buckets).sum() * math.log(10))
                model.w[name][i, j] -= d
            assert abs((loss[0] - loss[1]) / 2e-4 - g[i, j]) < 1e-3


def test_outputs_tell_words_apart():
    words = {zlib.crc32(b"word%d" % i) % lm.BUCKETS for i in range(20_000)}
    assert len(words) == lm.BUCKETS == np.prod(lm.WIDTHS) == 1024


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(none, F.lit(False)).count() == 0
    assert [r.n_known for r in lm.score_texts(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), F.lit(True)).collect()] == [0]
