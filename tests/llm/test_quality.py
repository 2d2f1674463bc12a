import numpy as np

from vigil.llm.quality import judge_quality, label_model, mine_lexicon, stem_counts, statistics, votes


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.8
    spec, recall = [0.99, 0.95, 0.97], [0.9, 0.6, 0.3]
    v = np.stack([np.where(rng.random(len(y)) < 0.1, -1, np.where(y, rng.random(len(y)) < s, rng.random(len(y)) >= r)) for s, r in zip(spec, recall)], 1).astype(int)
    pats, inv, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, acc, share = label_model(pats, counts.astype(float))
    want = [0.8 * s + 0.2 * r for s, r in zip(spec, recall)]
    assert np.abs(acc - want).max() < 0.04 and abs(share - 0.8) < 0.04
    assert ((post[inv.ravel()] >= 0.5) == y).mean() > 0.95


def test_statistics_and_votes():
    s, plain = statistics("THE Cat, | | the the É 12!".encode())
    assert s[7] == 8 and s[6] != s[6] and abs(s[3] - 3 / 8) < 1e-9 and abs(s[4] - 2 / 8) < 1e-9 and b"cat" in plain
    assert len(votes(s)) == len(votes(statistics(b"")[0])) == 11
    assert stem_counts(b"Snarl, snarls snar sna".split())[b"snar"] == 2  # as it stands: the caller lower-cases
    assert statistics(b"snarling a snarls b", frozenset([b"snarl"]))[0][6] == 0.5 and statistics(b"snarling a b", frozenset([b"snarl"]))[0][6] == 0


def test_lexicon_against_brute_force(spark):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    texts = [(i, (plain(60) + (" grümpel grümpig" if i % 4 == 0 else ""))) for i in range(200)]
    docs = spark.createDataFrame([*texts, (None, "snarl snarl"), (500, None)], "doc_id long, text string")
    marks = [(i, int(i % 4 == 0)) for i, _ in texts] + [(0, 0), (None, 1), (1, None), (500, 0), (900, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    want = {"grümpel".encode()[:k] for k in (4, 5, 6)}  # two words start alike for six bytes: g r ü(2) m p
    assert mine_lexicon(docs, labels) == want
    assert mine_lexicon(docs, labels, max_stems=2) == {b"gr\xc3\xbc", b"gr\xc3\xbcm"}
    assert mine_lexicon(docs, labels.where("toxic = 1")) == mine_lexicon(docs.limit(0), labels) == mine_lexicon(docs, labels.limit(0)) == frozenset()


def test_toxic_in_all_languages_held_out(spark):
    """The lexicon comes from half of the labels; the other half is judged."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learned = "crc32(cast(doc_id as string)) % 2 = 0"
    keep = judge_quality(docs, labels=labels.where(learned)).select("doc_id", "keep")
    rows = labels.where(f"not ({learned})").join(keep, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.toxic]) < 0.03 and np.mean([r.keep for r in rows if r.quality and not r.toxic]) > 0.995


def test_judge_quality_held_out(spark):
    """Labelled documents: clean ones stay, toxic ones and junk go."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lab = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = judge_quality(docs)
    assert out.columns == [*docs.columns, "score", "keep"]
    rows = out.collect()
    assert len(rows) == docs.count()
    keep = {r.doc_id: r.keep for r in rows}
    clean = [keep[i] for i, (q, t) in lab.items() if q and not t]
    insults = [r.keep for r in rows if sum(w in (r.text or "").lower() for w in ("idiot", "moron", "stupid", "scum", "loser", "trash")) >= 2]
    junk = [keep[i] for i, (q, t) in lab.items() if not q]
    assert np.mean(clean) > 0.99 and np.mean(insults) < 0.05 and np.mean(junk) < 0.2


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "the cat and the dog " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pattern string")
    got = judge_quality(df).collect()
    assert len(got) == 6 and all(not r.keep and r.score == 0 for r in got if r.doc_id in (1, 2, 3)) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert judge_quality(df.limit(0)).count() == 0
