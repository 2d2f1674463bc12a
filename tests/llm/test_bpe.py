import json
import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm.bpe import Encoder, Vocabulary, decode, encode, lexicon_of, split_words
from vigil.llm.transducer import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", " the", "hello", "'s", "'ll", " 12", "3.14", "  ", "\n\n", "\t", "é", "ñandú", "日本語", "👍🏽", "<|endoftext|>", "<|endof", "½", "²", "x" * 40, "!?", " ", "\x1c", "́", "़", "\x00", "ﷺ", "𝔘", " "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def rules():
    return Vocabulary(PATH)


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randrange(0, 30))) for _ in range(n)]


def test_every_character_splits_as_in_the_library(library):
    pre = library.pre_tokenizer
    for low in (True, False):  # both rules
        ends = range(0x250) if low else range(0x110000)
        chars = [chr(c) for c in ends if not 0xD800 <= c < 0xE000]
        for at in range(0, len(chars), 20_000):
            text = "".join(f"a{c}1{c}!{c} {c}a" for c in chars[at:at + 20_000]) + ("" if low else "日")
            spans = [b for _, (_, b) in pre.pre_tokenize_str(text)]
            own, end = [], 0
            for w in split_words(text):
                end += len(w)
                own.append(end)
            assert own == spans


def test_encoder_equals_library(library, rules):
    sample = texts(800, 1) + ["", " ", "a" * 5000, "ab" * 3000 + " " * 2000 + "c", "\n" * 3000, " " * 3000]
    for lexicon in ([], sorted({w.encode() for t in sample[::3] for w in split_words(t) if len(w.encode()) <= 64})):
        encoder = Encoder(rules, Lexicon(lexicon_of(lexicon, rules)), held=50)
        for at in range(0, len(sample), 100):
            count, ids = encoder(sample[at:at + 100])
            want = [e.ids for e in library.encode_batch(sample[at:at + 100], add_special_tokens=False)]
            assert count.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_long_run_ends_soon(rules):
    ids = rules._merge_long(b"ab" * 300_000)
    assert b"".join(rules.text[rules.text_start[i]:rules.text_start[i] + rules.text_size[i]].tobytes() for i in ids) == b"ab" * 300_000


def test_merges_in_step_equal_one_by_one(rules):
    r = random.Random(3)
    words = [bytes(r.choices(b"abetns \xc3\xa9", k=r.randrange(1, 40))) for _ in range(2000)] + [b"a" * 64]
    count, ids = rules.merge(words)
    assert ids.tolist() == [i for w in words for i in rules._merge_long(w).tolist()]
    assert count.sum() == len(ids)


@pytest.mark.parametrize("seed", range(4))
def test_transducer_is_minimal_and_exact(seed):
    r = random.Random(seed)
    table = {bytes(r.choices(b"abc", k=r.randrange(1, 6))): tuple(r.choices(range(3), k=r.randrange(0, 4))) for _ in range(80)}
    lexicon = Lexicon(compile_lexicon(sorted(table.items())))
    asked = list(table) + [bytes(r.choices(b"abcd", k=r.randrange(0, 7))) for _ in range(200)]
    found, count, ids = lexicon.look_up(asked)
    assert found.tolist() == [w in table for w in asked]
    known = [w for w in asked if w in table]
    assert count.tolist() == [len(table[w]) for w in known]
    assert ids.tolist() == [i for w in known for i in table[w]]

    def rest(prefix):
        """What can follow a prefix, with the outputs less what they all begin with: equal for equal states only."""
        tails = {w[len(prefix):]: o for w, o in table.items() if w.startswith(prefix)}
        n = 0
        while len({o[n] if n < len(o) else None for o in tails.values()}) == 1 and all(n < len(o) for o in tails.values()):
            n += 1
        return frozenset((w, o[n:]) for w, o in tails.items())

    prefixes = {w[:i] for w in table for i in range(len(w) + 1)}
    fewest = len({rest(p) if p else "root" for p in prefixes})
    assert lexicon.n_states <= fewest  # the root may be equal to no other or to one of them


def test_empty_lexicon_and_order():
    assert Lexicon(compile_lexicon([])).look_up([b"a", b""])[0].tolist() == [False, False]
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", (1,)), (b"a", (2,))])


def test_query_tables(spark, library):
    sample = texts(300, 5)
    rows = [(i, t, "x") for i, t in enumerate(sample)] + [(None, "no id", "y"), (5000, "again", "z"), (5000, "again", "z"), (1000, None, None), (1001, "", "q"), (1002, "word " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    out = decode(encode(docs, PATH, lexicon_words=200, stretch=500), PATH).collect()
    assert len(out) == len(rows)
    want = sorted(((i if i is not None else -1, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"])) for r in out), key=str) == want
    text = {i: t or "" for i, t, _ in rows}
    assert all(r["text"] == text[r["doc_id"]] for r in out)
    both = encode(docs, PATH, decoded="ids_text").where("doc_id is not null").collect()
    assert len(both) == len(rows) - 1 and all(r["ids_text"] == text[r["doc_id"]] for r in both)
    empty = docs.limit(0)
    assert decode(encode(empty, PATH), PATH).count() == 0


def test_decode_of_odd_ids(spark, library):
    odd = [[], None, [50256], [10**6, 220], [100, 1], [220, None, 220]]
    out = decode(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id long, ids array<int>"), PATH)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {i: library.decode([y for y in x or [] if y is not None], skip_special_tokens=False) for i, x in enumerate(odd)}


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert json.load(open(PATH))["model"]["type"] == "BPE"
