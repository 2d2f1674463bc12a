"""The registered ``opN_<name>`` queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from vigil.llm.bpe import encode
from vigil.llm.common import table
from vigil.llm.decontaminate import contaminated
from vigil.llm.fingerprint import edit_fingerprints
from vigil.llm.language import labelled_words, predict, train_counts
from vigil.llm.lm import score_texts
from vigil.llm.packing import pack
from vigil.llm.phrases import collocations
from vigil.llm.pii import KINDS, find_personal_data, span_list
from vigil.llm.quality import judge_quality
from vigil.llm.repeats import remove_repeats
from vigil.llm.simhash import simhash_components
from vigil.llm.topk import ranked_search
from vigil.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data and the terms that disclose them, in every document."""
    out = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


#: Stated rules of the URL filter: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: stated rules, else mined association rules."""
    out = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 4-word shingles, at most 4 differing bits."""
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row per document and item."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.8)
    return out.select("doc_id", "item_id", "item_words", "covered_words", F.size("tiles").cast("long").alias("n_tiles"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a document is good, and the decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, labels=table(spark, sf_dir, "labels")).select("doc_id", "score", "keep")


def _remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the network learns from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    words = labelled_words(docs.where(~held_out), 300, "text", "lang", F.xxhash64("text"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), train_counts(words)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text."""
    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; six sevenths of them are learned from."""
    return score_texts(table(spark, sf_dir, "documents"), F.coalesce(_remainder(7) == 2, F.lit(False)))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"))


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they stand for."""
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE_SQL["op12_search"] = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
stat AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
measure AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // all_terms) AS m FROM sizes, stat),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), stat),
scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN measure USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
cuts AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, q.f AS r, CAST((2000000::HUGEINT * c.a) // (p.f::HUGEINT + q.f) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.k], ' ') AND p.m = c.k
              JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.k + 1:], ' ') AND q.m = c.m - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
FROM best b JOIN total t USING (lang) LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.longest IS NULL OR 100::HUGEINT * i.longest < 80::HUGEINT * b.a
QUALIFY rank <= 2000
"""
