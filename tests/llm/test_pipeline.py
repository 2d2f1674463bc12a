import corpus_pipeline as cp
from test_decontaminate import brute_tiles
from test_pii import brute
from test_simhash import brute_components, brute_fp


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_stages_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    extra = [(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (None, "a clean text of a few words that is by the way for all of you", "en", "s", 9),
             (900_003, "mail me at some.one@mail.example.com or call +1 (212) 555-0100 for the rest of it", "en", "s", 9), (900_003, "mail me at some.one@mail.example.com or call +1 (212) 555-0100 for the rest of it", "en", "t", 9),
             (900_004, " ".join(bench[0][len(bench[0]) // 2:] + bench[0][:len(bench[0]) // 2]) + " and the rest of the text is by an author", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    clean = cp.quality(spark, docs, d)
    assert clean.columns == docs.columns
    kept = rows_of(clean)
    assert (900_001, "") not in kept and (900_002, "") not in kept and (-1, extra[2][1]) in kept and 0.7 * docs.count() < len(kept) < docs.count()

    single = cp.near_duplicates(spark, clean, d)
    comp = brute_components({brute_fp(t) for _, t in kept}, 4)
    first = {}
    for i, t in kept:
        first[comp[brute_fp(t)]] = min(i, first.get(comp[brute_fp(t)], i))
    assert single.columns == docs.columns and sorted(i for i, _ in rows_of(single)) == sorted(first.values())

    pure = cp.decontamination(spark, single, d)

    def holds(text):
        doc = text.lower().split()
        for item in bench:
            ids = {w: n for n, w in enumerate(dict.fromkeys(item))}
            if len(set(doc) & set(item)) >= 0.5 * len(ids) and sum(t[0] for t in brute_tiles([ids.get(w, -1) for w in doc], [ids[w] for w in item], 5)) >= 0.8 * len(item):
                return True
        return False

    want = [(i, t) for i, t in rows_of(single) if not holds(t)]
    assert rows_of(pure) == want and 900_004 not in [i for i, _ in want]

    safe = cp.personal_data(spark, pure, d)
    texts = dict(rows_of(safe))
    assert safe.columns == docs.columns and len(texts) == len(want)
    for i, t in want:
        if brute(t):
            assert not brute(texts[i]) and "[" in texts[i]
    assert texts[900_003].startswith("mail me at [EMAIL] or call [PHONE] for")
    packed = cp.packing(spark, safe, d)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in want})
    assert max(r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()) <= 1024


def test_empty(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0


def test_clashing_columns_are_kept(spark):
    d = "/root/testdata/sf0.001"
    names = ["_key", "_n", "_score", "_keep", "_base", "_spans", "kept", "__key", "text_hash"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    marked = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for (_, stage), last in zip(cp.STAGES, [False] * 4 + [True]):
        plain, marked = stage(spark, docs, d), stage(spark, marked, d)
        if last:
            break
        assert marked.columns == plain.columns + names
        rows = marked.collect()
        assert rows_of(marked) == rows_of(plain)
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        docs = plain
    assert rows_count(marked) == rows_count(plain)


def rows_count(df):
    return sorted((r.doc_id, r.start, r.length) for r in df.select("doc_id", "start", "length").collect())
