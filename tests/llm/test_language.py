from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import language as L


def test_gradients_match_differences():
    net = L.Network(["a", "b", "c"], seed=3)
    for g in (net.forth, net.back):
        g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    net.out = {k: v.astype(np.float64) for k, v in net.out.items()}
    x, sizes = L.pad([b"abc", b"x", b"hello"])
    y = np.array([0, 2, 1])
    grads, p, rng = net.loss(x, sizes, y)[1], net.parameters(), np.random.default_rng(0)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(s) for s in p[k].shape) if "embed" not in k else (int(x[0, 0]), int(rng.integers(L.EMBED)))
            old, eps = p[k][at], 1e-3
            p[k][at] = old + eps
            up = net.loss(x, sizes, y)[0]
            p[k][at] = old - eps
            down = net.loss(x, sizes, y)[0]
            p[k][at] = old
            assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3, k


def test_word_sums_equal_positions():
    net, words = L.Network(["a", "b"], seed=5), [b"one", b"a", "größe".encode(), b"zebra", b"two"]
    x, sizes = L.pad(words)
    want = (net.positions(x, sizes) * (x > 0)[:, :, None]).sum(axis=0)
    assert np.abs(net.words(words) - want).max() < 1e-4


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = L.train(L.labelled_sample(docs.where(~held), 60, "text", "lang", F.xxhash64("text"), 2000), steps=250)
    out = L.predict(docs.where(held), net).collect()
    assert len(out) == docs.where(held).count() and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !! 34", "x"), (4, "the " * 50_000, "x"), (5, "w" * 100_000, "x"), (5, "ß", "x")], "doc_id long, text string, known string")
    got = {r.doc_id: r for r in L.predict(odd, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[4].lang_pred == "en" and 0 <= got[5].score <= 1
    none = docs.limit(0)
    assert L.train(L.labelled_sample(none, 5, "text", "lang", F.col("doc_id"), 10)) is None
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"} and L.predict(none, net).count() == 0


def test_words_of_whole_sampled_texts(spark):
    texts = [("a", "common header " * 2000 + "späte wörter" + "z" * 60), ("a", "one two two"), ("a", "one two two"), ("b", " "), (None, "no"), ("b", None)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    got = L.labelled_words(docs, 5, "text", "lang", F.xxhash64("text"))
    assert got == {"a": sum((Counter(L.cut_words(t.encode())) for t in {t for k, t in texts if k == "a"}), Counter())}
    assert got["a"]["späte".encode()] == 1 and got["a"][b"header"] == 2000 and got["a"][b"two"] == 2
    assert L.train_counts({}) is None and L.labelled_words(docs.limit(0), 5, "text", "lang", F.xxhash64("text")) == {}


def test_query_learns_from_the_end_of_long_texts(spark, monkeypatch):
    from vigil.llm import queries

    docs = [(i, "0 " * 3000 + ("der hund und die katze " if i % 2 else "the dog and the cat ") * 5, "de" if i % 2 else "en") for i in range(40)]
    monkeypatch.setattr(queries, "table", lambda *a: spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    lang = {d: k for d, _, k in docs}
    out = [r for r in queries.op7_language(spark, "").collect() if r.held_out]
    assert out and all(r.lang_pred == lang[r.doc_id] for r in out)
