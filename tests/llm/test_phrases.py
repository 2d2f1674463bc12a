import random
import re
from collections import Counter

import pytest

from vigil.llm import phrases as ph
from vigil.llm.phrases import _Numbers, chunks, collocations, words_and_marks


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, contained, top, max_words=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= contained * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    ranked, at = [], Counter()
    for lang, s, a, p, l, r, total in out:  # noqa: E741
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, l, r, total, -s))
    return ranked


def result(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def rows_of(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["ab", "Ab", "c", "dé", "É", "\x1c", " x", "日", "e-f", "g'", "\x00"]
    passage = " ".join(r.choices(vocabulary, k=60))
    rows = []
    for _ in range(n):
        words = r.choices(vocabulary, k=r.randrange(0, 40))
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b", "!?"]) for w in words)
        rows.append((r.choice(["en", "de", None, "a.b"]), text + (passage if r.random() < 0.3 else "")))
    return rows + [("en", None), ("en", ""), (None, "."), ("en", "a " * 5000), ("de", "A a, " * 700)]


@pytest.mark.parametrize("seed,period,words", [(1, 16, 4), (2, 3, 4), (3, 1, 4), (4, 2, 3), (5, 4, 2)])
def test_equals_brute_force(spark, seed, period, words):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, text string, n long, phrase string").repartition(4)
    got = result(collocations(docs, max_words=words, min_count=5, period=period, top=50, filter_bits=1 << 15))
    assert got == brute(rows, 5, 80, 50, words)


def test_filter_that_lets_all_through(spark):
    rows = rows_of(9, 20)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(collocations(docs, min_count=1, contained=100, top=None, filter_bits=1 << 15)) == brute(rows, 1, 100, 10**9)


def test_parse_covers_each_word_and_shares_passages():
    r = random.Random(4)
    passage = [b"%d" % r.randrange(500) for _ in range(400)]
    passage[30] = passage[90] = b"."
    number = _Numbers()

    def parse(words):
        return list(chunks(words, number, 3, 8))

    one = parse([b"x", b"y"] + passage + [b"..", b"z", b"..", b"..", b"."])
    two = parse([b"q"] + passage)
    assert len(set(one) & set(two)) >= len(two) - 3
    back = []
    for c in one:
        ws = c.split()
        back += [b".."] * (ws[0] != b"..." and bool(back)) + (ws[4:] if ws[0] == b"..." else ws)
    assert back == [b"x", b"y"] + passage + [b"..", b"z", b"..", b"."]


def test_words():
    assert words_and_marks(["Ab\tÇd.e,F\x0cg  h".encode(), b"", b"..a"]) == [b"ab", "Çd".encode(), b".", b"e", b".", b"f", b".", b"g", b"h", b"..", b"..", b".", b".", b"a"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(docs).count() == 0
    with pytest.raises(ValueError):
        collocations(docs, max_words=1)


def test_dealt_rows_do_not_grow_with_the_packed_rows(spark):
    """Many small packed rows in a task come to a value per range, not one per range and row (the rows grew with the square of the
    packed rows, as the ranges followed their number, too)."""
    parse = ph.dictionary(spark.range(0, 400).selectExpr("concat('g', id % 40) as lang", "concat('a b c ', id, ' d e f ', id % 7, ' g h') as text"), "lang", "text", 3, 24, "und")
    few, many = ph.packed(parse.coalesce(1)).coalesce(1), ph.packed(parse.coalesce(1), together=40).coalesce(1)
    assert few.count() == 40 and many.count() > 200
    for size in (1, 2):
        a, b = (ph.dealt_hashes(p, size, 3, None, 256).collect() for p in (few, many))
        assert len(a) == len({r["range"] for r in a}) and sorted(a) == sorted(b)
    assert ph.ranges_for(0) == ph.ranges_for(1 << 20) == 256 and ph.ranges_for(1 << 29) == 1024 and ph.ranges_for(1 << 50) == ph.MOST_RANGES
