import random

import numpy as np

from vigil.llm.decontaminate import contaminated, tiles


def brute_tiles(doc, item, m):
    """Greedy string tiling by comparing every position with every other."""
    df, itf, out = [x >= 0 for x in doc], [True] * len(item), []
    while True:
        best = []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and df[d + n] and itf[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                best.append((-n, d, i))
        n, d, i = min(best, default=(0, 0, 0))
        if -n < m:
            return out
        for k in range(-n):
            df[d + k] = itf[i + k] = False
        out.append((-n, d, i))


def test_tiles_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randrange(4 if rng.random() < 0.3 else 30) for _ in range(rng.randint(5, 25))]
        doc = []
        for _ in range(4):
            a = rng.randrange(len(item))
            doc += item[a:a + rng.randint(1, 12)] + [-1 if rng.random() < 0.5 else rng.randrange(30)] * rng.randint(0, 2)
        got = tiles(np.array(doc), np.array(item), 3)
        want = brute_tiles(doc, item, 3)
        assert [t[0] for t in got][:1] == [t[0] for t in want][:1]
        assert all(n >= 3 and doc[d:d + n] == item[i:i + n] for n, d, i in got)
        if len(set(item)) == len(item):
            assert sum(t[0] for t in got) == sum(t[0] for t in want)


def test_contaminated(spark):
    item = [f"q{i}" for i in range(40)]
    reordered = item[20:] + ["gap"] + item[:20]
    half = item[:25]
    filler = [f"f{i % 50}" for i in range(3000)]
    docs = [
        (1, " ".join(filler + [w.upper() + "" for w in item] + filler)), (2, "\n".join(reordered)), (3, " ".join(half + filler)), (4, " ".join(filler)), (5, None), (6, ""), (7, "q0 q1 q2"),
        (8, " ".join(item[:10] + ["x"] + item[10:20] + ["y"] + item[21:30] + ["z"] + item[31:])), (9, " ".join(w for p in zip(item, item) for w in p)), (None, " ".join(item)), (1, " ".join(item + item)),
    ]
    bench = [(10, " ".join(item)), (11, "tiny item"), (12, None), (13, " ".join(item)), (14, "")]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for words in (2_000_000, 40):
        got = sorted(((r.doc_id or 0, r.item_id) for r in contaminated(df, b, block_words=words).collect()))
        assert got == sorted((d, i) for d in (0, 1, 1, 2, 8) for i in (10, 13))
    assert contaminated(df, b.limit(0)).count() == 0 and contaminated(df.limit(0), b).count() == 0
