import re
from itertools import combinations

from vigil.llm.urls import judge_urls

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def brute(urls, support, confidence):
    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()

    def toks(u):
        low = "".join(c.lower() if c.isascii() else c for c in u or "")
        return frozenset("#" if re.fullmatch("[0-9]+", w) else w for w in re.findall(r"(?:[^\W_]|-)+", low))

    rows = []
    for u in urls:
        h, p = split(u)
        fit = [(len(rh + rp), rh + rp, v) for v, rh, rp in RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        rows.append((h, p, max(fit)[1:] if fit else None, toks(u)))
    lab = [(t, r[1]) for _, _, r, t in rows if r]
    rules = []
    for n in range(1, 12):
        for c in {c for t, _ in lab for c in combinations(sorted(t), n)}:
            has = [v for t, v in lab if t.issuperset(c)]
            for v in ("allow", "block"):
                if has.count(v) >= support * len(lab) - 1e-9 and has.count(v) and has.count(v) / len(has) >= confidence:
                    conf, sup = has.count(v) / len(has), has.count(v) / len(lab)
                    if not any(v == r[4] and r[0] >= conf and set(r[3]) < set(c) for r in rules):
                        rules.append((conf, sup, n, list(c), v))
    out = []
    for h, p, r, t in rows:
        if r:
            out.append((h, p, r[0], r[1]))
        else:
            best = max((x for x in rules if t.issuperset(x[3])), default=None)
            out.append((h, p, None, best[4] if best else "allow"))
    return out


def test_matches_brute_force(spark):
    urls = [f"http://{s}.example.{t}/{lang}/{i}{q}" for i, (s, t, lang, q) in enumerate(
        (s, t, lang, q) for s in ("a", "m.b") for t in ("net", "com", "org") for lang in ("en", "de", "fr") for q in ("", "?x=1"))]
    urls += [None, "", "no scheme", "HTTP://EXAMPLE.NET", "http://Example.net/EN/", "x://net/?a", "x://fr.org/fr/#a", "x://notnet/", "https://É.Org/fr/", urls[0], urls[0], "http://" + "a" * 50_000 + ".net/"]
    df = spark.createDataFrame([(i if i % 9 else None, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = judge_urls(df, RULES, min_support=0.1, min_confidence=0.8).collect()
    want = [((i if i % 9 else None), *r) for i, r in enumerate(brute(urls, 0.1, 0.8))]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)


def test_no_labelled_rows_and_empty(spark):
    assert [r.verdict for r in judge_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"), RULES).collect()] == ["allow"]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
