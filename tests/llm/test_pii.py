import re

from pyspark.sql import functions as F

from vigil.llm.pii import KINDS, base_spans, find_personal_data, masked, sanitise, span_list

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for order, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TEXTS = [
    "", " ", "é ü a@b.co, ñ x.y+z%1@mail-3.example.com.", "a@b.com_foo@bar.com @x.y a@b a@b. a@@b.c", "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 41111111111111111111111 5500 0000 0000 0004 1 2", "+1 (212) 555-0100 170.106.47.218 +49 30 1234567 +12 ++1 (2) 3",
    "中文 a@b.cn😀 +1 (212) 555-0100", "9" * 5000 + " " + "1.1.1.1 " * 200 + "x" * 5000 + "@" + "y.z" * 50, "a@b.c" * 30, "+1" + " 2" * 3000,
]


def test_base_spans_match_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[2:4])] + [(99, None, 2), (None, "q@w.er", 3)], "doc_id long, text string, spans int")
    got = find_personal_data(df).select("doc_id", span_list(F.col("base")).alias("b"), span_list(F.col("spans")).alias("s")).collect()
    assert len(got) == len(TEXTS) + 4
    texts = {i: t for i, t in enumerate(TEXTS + TEXTS[2:4])} | {99: "", None: "q@w.er"}
    for r in got:
        assert r.b == brute(texts[r.doc_id]) and r.s == r.b, texts[r.doc_id][:80]


def test_addresses_with_a_zero_part(spark):
    texts = ["10.0.0.1 127.0.0.1 192.168.1.0", "0.0.0.0 00.00.00.00 000.0.00.1", "0.1.2.256 00.0.0.0256 0.0.0.00255 1.0.0.300", "1.0.0 x0.0.0.10.0.0.0.0", "100.200.0.020,0010.0.099.9"]
    got = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", span_list(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == dict(enumerate(map(brute, texts)))
    assert brute(texts[0]).count("ip:") == 3 and brute(texts[1]).count("ip:") == 3


def test_disclosing_terms(spark):
    contexts = ["call Miraxon about the plan", "when Miraxon came by the", "so the Miraxon said that", "and by Miraxon the house"]
    rows = [(i, f"{c} at mx.12@mail.example.com if the rain is over") for i, c in enumerate(contexts)]
    rows += [(100 + i, "the rain is over and they call about a plan at noon so that house came by when said if") for i in range(60)]
    rows += [(200, "Miraxon is elsewhere, unknown"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in find_personal_data(df, keep=("text",)).collect()}
    for i, c in enumerate(contexts):
        at = c.index("Miraxon")
        assert [(s.kind, s.start, s.end) for s in got[i][1]][0] == ("term", at, at + 7)
        assert {s.kind for s in got[i][1]} == {"term", "email"} and len(got[i][1]) == 2
    assert all(not got[i][1] for i in (100, 159, 200, 201, 202))
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert clean[201] is None and clean[202] == "" and clean[200].startswith("Miraxon")
    assert "Miraxon" not in clean[0] and "[EMAIL]" in clean[0] and "@" not in clean[0]


def test_terms_of_copies_and_of_far_entities(spark):
    texts = [f"{w} Miraxon writes to mx.12@mail.example.com today" for w in ("alpha", "beta", "gamma", "delta", "eta")]  # 5 contexts, 40 copies each
    copied = "Quorvex asks q.v@mail.example.com"  # one text, 30 copies
    far = [f"Zelbrun {'and so on ' * n}z.b@mail.example.com" for n in (40, 50, 60)]  # header and footer
    rows = texts * 40 + [copied] * 30 + far + ["alpha beta gamma delta eta writes to today asks and so on mail example com"] * 4000
    got = find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()
    terms = {r.doc_id: {s.value: s.action for s in r.spans if s.kind == "term"} for r in got}
    for i, t in enumerate(rows):
        name = next((w for w in ("Miraxon", "Quorvex", "Zelbrun") if w in t), None)
        assert terms[i].get(name) == ("" if name else None)
        assert terms[i].keys() <= {"Miraxon", "Quorvex", "Zelbrun"}, t


def test_masked_overlaps_and_empty_table(spark):
    spans = "array(named_struct('start',1L,'end',4L,'action','a'), named_struct('start',2L,'end',6L,'action','b'), named_struct('start',8L,'end',9L,'action',''))"
    assert spark.range(1).select(masked(F.lit("0123456789"), F.expr(spans))).first()[0] == "0[A]679"
    none = spark.createDataFrame([], "doc_id long, text string, base string")
    assert find_personal_data(none).count() == 0 and sanitise(none).columns == none.columns
    assert set(base_spans(F.lit("x"))) == set(KINDS)


def test_spans_of_long_texts_in_proportion(spark):
    """A million words and a hundred thousand addresses in one text each."""
    import time

    from vigil.llm.pii import _PATTERNS, _WORD, match_spans

    words = spark.range(1).select(F.expr("array_join(transform(sequence(1, 1000000), i -> concat('w', i)), ' ')").alias("text"))
    mails = spark.range(1).select(F.expr("array_join(transform(sequence(1, 100000), i -> concat('a', i, '@b.org')), ', ')").alias("text"))
    began = time.time()
    for df, pattern, n in ((words, _WORD, 1_000_000), (mails, _PATTERNS["email"], 100_000)):
        spans = df.select("text", match_spans(F.col("text"), pattern).alias("s"))
        got = spans.select(F.size("s").alias("n"), F.expr("forall(slice(s, 1, 100), x -> substring(text, cast(x.start + 1 as int), cast(x.end - x.start as int)) = x.value)").alias("right"),
                           (F.element_at("s", -1)["end"] == F.length("text")).alias("whole")).first()
        assert tuple(got) == (n, True, True)
    assert time.time() - began < 120
