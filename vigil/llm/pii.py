"""Personal data: pattern spans, and terms that disclose them by co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.  Their values are the
protected entities.  The words of its texts are an entity's terms; over the whole corpus the pointwise
mutual information of a term and an entity, as a share of the entity's own information, says how much
of the entity the term discloses:

    disclosure = log(p(term, entity) / (p(term) p(entity))) / -log p(entity)

Probabilities are shares of rows, the joint one too: a text counts as often as it occurs, wherever in it
term and entity stand.  A term seen in at least ``min_support`` rows of an entity is removed where its
disclosure reaches ``remove_at`` and generalised to its kind of word where it reaches ``generalise_at``.

Only DataFrame functions are used.  Patterns are possessive forms of the plain ones: each may start
only where the previous match ended or where no character of its first run precedes, so a long run
is read once, and repeated groups need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+"}
#: A term: letters and digits, also joined by an apostrophe or a hyphen.
_WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
#: A part of an address, which has a digit by the match: zeros, then its value unless that is 0.
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?"


#: Steps of a block in which spans are located.
_BLOCK = 512


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _located(steps: Column) -> Column:
    """Spans of (gap before, size, value) steps.  An append copies its array, so sums run within blocks of ``_BLOCK`` steps
    and over the blocks, and the work grows in proportion to the text."""
    zero, length = F.lit(0).cast("long"), lambda x: x["gap"] + x["size"]

    def ahead(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + F.aggregate(block, zero, lambda n, x: n + length(x))).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), _no_spans().alias("out")), add, lambda acc: acc["out"])

    def all_blocks(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), ahead, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, within))

    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(steps) > 0, _let(_let(steps, cut), all_blocks)).otherwise(_no_spans())


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(0)))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))
    return F.when(text.rlike(pattern), _let(steps, _located)).otherwise(_no_spans())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at least one digit has a valid Luhn sum."""
    from_right = F.split(F.reverse(digits), "(?!^)(?!$)")
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; the text may not be null."""
    n = lambda s: F.length(_digits(s["value"]))
    keep = {
        "email": None,
        "ip": lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda s: F.when(n(s).between(14, 19), _luhn(_digits(s["value"]))).otherwise(False),
        "phone": lambda s: n(s).between(10, 15),
    }
    out = {}
    for kind in KINDS:
        spans = match_spans(text, _PATTERNS[kind])
        if kind in _HINT:
            spans = F.when(text.contains(_HINT[kind]), spans).otherwise(_no_spans())
        out[kind] = F.filter(spans, keep[kind]) if keep[kind] else spans
    return out


def _with_kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind"), s["value"].alias("value")))


def _kind_of_word(word: Column) -> Column:
    """The general class that stands for a word."""
    return F.when(word.rlike(r"\p{N}"), F.lit("number")).when(word.rlike(r"^\p{Lu}"), F.lit("name")).otherwise(F.lit("word"))


def disclosing_terms(docs: DataFrame, rows: DataFrame, text_col: str = "text", min_support: int = 3,
                     generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """``entity, term, remove`` of the pairs that reach a threshold.

    ``docs`` is the whole corpus, ``rows`` its rows that have base spans (``_key, _text, _base``; equal
    texts have equal keys).  All counts are numbers of rows; equal texts are split into words once.
    """
    own = (rows.select("_key", F.explode(F.array_distinct(F.transform("_base", lambda s: s["value"]))).alias("entity"))
           .groupBy("_key", "entity").agg(F.count(F.lit(1)).alias("n")))
    # a pair cannot reach the support if its entity does not
    entities = own.groupBy("entity").agg(F.sum("n").alias("n_entity")).where(F.col("n_entity") >= min_support)
    kept = own.join(entities.select("entity"), "entity", "left_semi").groupBy("_key").agg(F.collect_list("entity").alias("_entities"), F.first("n").alias("n"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(_WORD), F.lit(0)))
    texts = rows.groupBy("_key").agg(F.first("_text").alias("_text")).join(kept, "_key")
    joint = (texts.select("n", "_entities", F.explode(words("_text")).alias("term")).select("n", "term", F.explode("_entities").alias("entity"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_joint")).where(F.col("n_joint") >= min_support))
    terms = docs.select(F.explode(words(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = docs.agg(F.count(F.lit(1)).alias("n_all"))
    pairs = joint.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(total))  # one row
    information = F.log(F.col("n_all") / F.col("n_entity"))
    disclosure = F.when(information > 0, F.log(F.col("n_joint") * F.col("n_all") / (F.col("n_entity") * F.col("n_term"))) / information).otherwise(0.0)
    return pairs.select("entity", "term", disclosure.alias("d")).where(F.col("d") >= generalise_at).select("entity", "term", (F.col("d") >= remove_at).alias("remove"))


def find_personal_data(docs: DataFrame, min_support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95,
                       id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``id_col, base, spans`` (their names begin with ``prefix``) and the columns ``keep`` for every row.

    ``base`` and ``spans`` are ``array<struct<start, order, end, kind, value, action>>`` sorted by start
    and kind, in code points, end exclusive.  ``base`` has the four base kinds; ``spans`` adds ``term``, whose
    action is empty (removed) or the kind of word it is generalised to.  Null text counts as empty.
    Equal texts get equal spans.  Columns not named are not read.  An empty table gives no rows.
    """
    kinds = base_spans(F.col("_text"))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = F.array_sort(F.concat(*[_with_kind(kinds[k], k, i) for i, k in enumerate(KINDS)]))
    found = found.withColumn("_base", base)
    hit = F.size("_base") > 0
    found = stored(found.withColumn("_key", F.when(hit, F.sha2("_text", 256))).withColumn("_text", F.when(hit, F.col("_text"))), "pii")
    with_data = found.where(F.col("_key").isNotNull())

    terms = disclosing_terms(docs, with_data, text_col, min_support, generalise_at, remove_at)
    # a text's flagged terms are those of its own entities
    own = with_data.select("_key", F.explode(F.array_distinct(F.transform("_base", lambda s: s["value"]))).alias("entity")).distinct()
    flagged = (own.join(terms, "entity").groupBy("_key", "term").agg(F.max("remove").alias("remove"))
               .groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("_flagged")))
    with_data = with_data.join(flagged, "_key", "left")

    def chosen(s: Column) -> Column:
        free = ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.map_contains_key("_flagged", F.lower(s["value"])) & free

    def as_term(s: Column) -> Column:
        action = F.when(F.col("_flagged")[F.lower(s["value"])], F.lit("")).otherwise(_kind_of_word(s["value"]))
        return F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("order"), s["end"].alias("end"), F.lit("term").alias("kind"),
                        s["value"].alias("value"), action.alias("action"))

    as_base = F.transform("_base", lambda s: s.withField("action", s["kind"]))
    extra = F.when(F.col("_flagged").isNotNull(), F.transform(F.filter(match_spans(F.col("_text"), _WORD), chosen), as_term))
    every = F.array_sort(F.concat(as_base, F.coalesce(extra, F.slice(as_base, 1, 0))))
    rest = [F.col(f"_keep_{c}").alias(c) for c in keep]
    clean = found.where(F.col("_key").isNull())
    return (clean.select(F.col("_id").alias(id_col), as_base.alias(f"{prefix}base"), as_base.alias(f"{prefix}spans"), *rest)
            .unionByName(with_data.select(F.col("_id").alias(id_col), as_base.alias(f"{prefix}base"), every.alias(f"{prefix}spans"), *rest)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its action in brackets, or removed; of overlapping spans the
    first names the whole stretch."""
    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["action"] == "", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["action"]), F.lit("]")))
        out = F.when(s["start"] >= acc["at"], F.array_append(F.array_append(acc["out"], gap), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The rows and columns of ``docs`` with personal data and disclosing terms masked in the text."""
    columns = tuple(c for c in docs.columns if c != id_col)
    prefix = "_"
    while {f"{prefix}base", f"{prefix}spans"} & set(docs.columns):
        prefix += "_"
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, keep=columns, prefix=prefix, **thresholds)
    return found.select(*[masked(F.col(c), F.col(f"{prefix}spans")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
