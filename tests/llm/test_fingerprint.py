import hashlib
import random

import numpy as np

from vigil.llm.fingerprint import ENTRIES, as_hex, edit_fingerprints, half_next, likeness, order_minhash


def test_order_and_edits():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    a = " ".join(words).encode()
    few = list(words)
    for i in range(0, 4000, 400):
        few[i] = "XXXXXX"
    turned = " ".join(words[2000:] + words[:2000]).encode()
    shuffled = " ".join(rng.sample(words, len(words))).encode()
    fp = order_minhash(a)
    assert (fp != 0).all() and (order_minhash(a) == fp).all()
    near, moved, mixed = (likeness(fp, order_minhash(x)) for x in (" ".join(few).encode(), turned, shuffled))
    assert near > 0.8 > moved > 0.2 and near > moved > mixed


def test_selection_matches_brute_force():
    """The thresholded selection takes the two least of each bin, in text order."""
    import vigil.llm.fingerprint as m
    rng = random.Random(9)
    for n in (8, 100, 9000, 30_000):
        data = bytes(rng.choices(b"abc" if n < 9000 else bytes(range(97, 120)), k=n))
        hashes, at = m._numbered(data)
        rows = sorted(zip(hashes.tolist(), at.tolist()))
        assert len(set(hashes.tolist())) == len(rows) == n - 7
        want = np.zeros(ENTRIES, np.uint32)
        for b in range(ENTRIES):
            two = sorted([r for r in rows if r[0] >> 58 == b][:2], key=lambda r: r[1])
            h = [np.array([r[0]], dtype=np.uint64) for r in two]
            if len(h) == 2:
                want[b] = (m._mix(h[0] * m._C1 + h[1]) >> np.uint64(32)).astype(np.uint32)[0] | 1
            elif h:
                want[b] = (m._mix(h[0] + m._C2) >> np.uint64(32)).astype(np.uint32)[0] | 1
        assert (order_minhash(data) == want).all()


def test_successors(spark):
    rng = random.Random(6)
    rows = [(i * 3, rng.choice([None, "", "é" * rng.randint(1, 50), "word " * rng.randint(1, 300)])) for i in range(200)] + [(9, "same id"), (9, "again"), (None, "no id"), (700, "x" * 200_000)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rng.sample(rows, len(rows))], "doc_id long, text string, fingerprint string").repartition(7)
    order = sorted(((a if a is not None else -1, t or "", a) for a, t in rows), key=lambda r: r[:2])
    want = {}
    for (k, t, a), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        e = half_next(t, nxt).encode()
        f, g, h = order_minhash(t.encode()), order_minhash(e), order_minhash(nxt.encode())
        want.setdefault(a, []).append((a, len(t), hashlib.sha256(e).hexdigest(), as_hex(f), as_hex(g), likeness(f, g), likeness(f, h)))
    got = {}
    for r in edit_fingerprints(df).collect():
        got.setdefault(r.doc_id, []).append(tuple(r))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_single_and_empty(spark):
    assert [tuple(r)[5:] for r in edit_fingerprints(spark.createDataFrame([(1, "abc def ghi jkl")], "doc_id long, text string")).collect()][0][1] == 1.0
    assert edit_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
