import random
from collections import Counter

import numpy as np

from vigil.llm.repeats import SIDE, Shard, merged_intervals, remove_repeats


def brute(texts, length=400):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])) if len(t) else np.zeros(1, int)
        runs = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((len(t), bytes(b for b, g in zip(t, gone) if not g), runs))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(900), text(120)
    texts = [base, base, passage, None, "", "ab " * 300, "Der " * 150 + "die " * 150, "x" * 401, "x" * 400, "y" * 400, "z" * 399, "z" * 399]
    for _ in range(25):  # near copies
        t = list(base)
        for _ in range(rng.randint(1, 9)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        a = rng.randrange(len(t) // 2)
        texts.append("".join(t[a:a + rng.randint(300, len(t))]))
    for _ in range(15):  # a passage between other text, cut at the ends
        a = rng.randrange(150)
        texts.append(text(rng.randint(0, 60)) + passage[a:len(passage) - rng.randrange(150)] + text(rng.randint(0, 60)))
    for n in (398, 399, 400, 401, 402):  # shared strings around the limit
        s = text(200)[:n]
        texts += ["<" + s + ">", "[" + s + "]"]
    return texts


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, h int").repartition(4)
    want = brute([(t or "").encode() for t in texts])
    got = {r.doc_id or 0: (r.n_bytes, bytes(r.kept), [(x.a, x.b) for x in r.runs]) for r in remove_repeats(df).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i][2], w[2])


def test_small_batches_and_shards_match(spark, monkeypatch):
    import vigil.llm.repeats as m
    rng = np.random.default_rng(4)
    n = 500
    groups = rng.integers(0, 9, n)
    columns = np.ascontiguousarray(rng.integers(0, 2, (n, SIDE)).astype(np.uint8).T)
    columns[:, ::3] = columns[:, [0]]
    sizes = [0, 7, 130, n]
    shards = [Shard(groups[a:b], columns[:, a:b]) for a, b in zip(sizes, sizes[1:])]
    for depth, got in enumerate(merged_intervals(shards, sizes[:-1])):
        keys = [(g, c[:depth].tobytes()) for g, c in zip(groups.tolist(), np.ascontiguousarray(columns.T))]
        names = {}
        for k, v in zip(keys, got.tolist()):
            assert names.setdefault(k, v) == v
        assert len(set(names.values())) == len(names)


def test_long_text_and_empty(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (1, "short"), (2, long[1000:1500] + "!")], "doc_id long, text string")
    got = sorted((r.n_bytes, [(x.a, x.b) for x in r.runs]) for r in remove_repeats(df).collect())
    assert got == [(5, []), (501, [(0, 500)]), (len(long), [(1000, 1500)])]
    assert remove_repeats(df.limit(0)).count() == 0


def test_dealt_groups_match_brute_force(spark):
    """Every group is larger than allowed, so all of them are dealt out by content."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, tail = letters(300), letters(60)
    texts = corpus(5) + [letters(rng.randint(0, 200)) + passage + letters(rng.randint(0, 200)) for _ in range(30)]
    texts += [letters(k) + passage + tail + letters(70) for k in range(0, 160, 9)]  # 360 shared bytes
    texts += [tail + passage + tail + letters(k) for k in range(0, 160, 9)]  # 420 shared bytes
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute([(t or "").encode() for t in texts])
    for r in remove_repeats(df, group_rows=2).collect():
        assert (r.n_bytes, bytes(r.kept), [(x.a, x.b) for x in r.runs]) == want[r.doc_id], r.doc_id
