import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm.packing import pack, pieces_of
from vigil.llm.tokens import text_ids, token_ids

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a b  c", "a \n b", "x\n\ny ", "it's, don't!! (ok).", "é\u00a0ü  \t z", "a,b.c;d", "中文 字", "<|endoftext|> x", "end. ", "Ab,,  c", "a\x1c b \x1c c", "１２ 3"]


def test_ids_equal_those_of_tokenizers():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab ,.'\n\té中 1!sdml") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for a in texts:
        assert t.encode(a, add_special_tokens=False).ids == token_ids(VOCAB, a).tolist(), repr(a)


def test_very_long_runs():
    t = Tokenizer.from_file(VOCAB)
    n = 1_500_000
    runs = [" " * n, "\n" * n, " \t\n" * (n // 3), "\u3000" * n, "\x85" * n, "x" * n, "12" * (n // 2), ".-" * (n // 2), "中" * n]
    texts = [a + r + b for r in runs for a, b in (("", ""), ("ab ", "b's"))]
    texts += [f"it's{' ' * n}\n.{s * 200_000} \x1c{s * 100_001}12{s * 100_000}x{s * 99_999}" for s in (" ", "\n", "\xa0")]
    for a in texts:
        assert t.encode(a, add_special_tokens=False).ids == token_ids(VOCAB, a).tolist(), a[:3] + a[-3:]


def test_added_tokens_have_their_ids(spark):
    t, rng = Tokenizer.from_file(VOCAB), random.Random(4)
    texts = ODD + ["a <|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y<|endoftext", "<|endoftext|>" + " " * 300_000 + "<|endoftext|>\n"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", " ", "ab", "\n", "'s", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    want = [t.encode(a, add_special_tokens=False).ids for a in texts]
    assert any(50256 in ids for ids in want)
    for a, ids in zip(texts, want):
        assert ids == text_ids(VOCAB, a).tolist(), repr(a[:80])
    out = pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), VOCAB).collect()
    assert np.frombuffer(out[0].ids, "<u4").tolist() == t.encode("a <|endoftext|> b", add_special_tokens=False).ids + [0]


def test_pieces():
    for n in range(1, 5000):
        p = pieces_of(n, 1024, 16)
        assert sum(p) == n and all(1024 // (1024 // x) - x <= 16 or x == 1024 for x in p)


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 30_000, " ".join("word" + str(i) for i in range(9000))] + [" ".join(rng.choices(["alpha", "beta,", "Gamma.", "12"], k=rng.randint(1, 900))) for _ in range(400)]
    rows = [(i if i != 7 else None, t, "c", 0) for i, t in enumerate(texts)] + [(5, texts[5], "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, start int").repartition(5)
    out = pack(df, VOCAB).collect()
    t = Tokenizer.from_file(VOCAB)
    whole = sorted((zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()) for _, x, _, _ in rows))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for ps in by_seq.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 1024
    got = []
    for d, ps in by_doc.items():
        if d == 5:
            assert sum(p.length for p in ps) == 2 * ps[0].doc_tokens
            continue
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps[:-1]]).tolist() and sum(p.length for p in ps) == ps[0].doc_tokens
        got.append(zlib.crc32(b"".join(bytes(p.ids) for p in ps)))
    whole5 = zlib.crc32(np.array(t.encode(texts[5], add_special_tokens=False).ids + [0], dtype="<u4").tobytes())
    assert sorted(got + [whole5] * 2) == whole
    padding = sum(1024 - sum(n for _, n in ps) for ps in by_seq.values() if sum(n for _, n in ps).bit_count() != 1)
    assert padding / sum(r.length for r in out) < 0.04


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCAB).count() == 0
