import random

import xxhash
from pyspark.sql import functions as F

from vigil.llm.simhash import fingerprint_components, simhash_bytes, simhash_components


def brute_fp(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fp - (1 << 64) if fp >> 63 else fp


def brute_components(fps, k):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[i + 1:]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= k:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for _ in range(400):
        f = rng.choice(sorted(fps))
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << bit
        fps.add(f)
    fps = {f - (1 << 64) if f >> 63 else f for f in fps} | {0, 1, 15, 31}
    for k in (0, 3, 4):
        got = dict(map(tuple, fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), k).select("fp", "label").collect()))
        assert got == brute_components(fps, k)


def test_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "A b C d e f"), (2, "a B c\td  E f\n"), (3, None), (4, ""), (5, " \n"), (6, "one two"), (7, "One\vtwo"),
            (8, long), (9, long + " x"), (9, long), (None, "é ü ß ñ 中"), (11, "É")]
    df = spark.createDataFrame([(i, t, "clash", "k") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    out = simhash_components(df).collect()
    assert len(out) == len(rows)
    comp = brute_components({brute_fp(t) for _, t in rows}, 4)
    low = {}
    for i, t in rows:
        c = comp[brute_fp(t)]
        low[c] = min([x for x in (low.get(c), i) if x is not None], default=None)
    want = sorted(((i, brute_fp(t), low[comp[brute_fp(t)]]) for i, t in rows), key=str)
    assert sorted(map(tuple, out), key=str) == want


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hash_is_the_native_one(spark):
    text = "ab cd ef"
    native = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert simhash_bytes(text.encode(), 4) == native
