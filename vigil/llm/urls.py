"""URL filter by mined association rules.

Stated (host, path) rules decide what they fit.  The pages they decide are the labelled examples
of the method: FP-growth finds the frequent combinations of URL tokens and a label, rules
``tokens -> label`` are pruned by support, confidence and redundancy, and every URL is looked up in
an inverted index that holds each rule under its rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored

#: A label item holds a character that no token has.
LABEL = "="


def _lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://`` or for null."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return _lower(host), path


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule of (verdict, host, path), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str) -> Column:
    """Sorted distinct tokens: lower-cased runs of letters, digits and hyphens; a number is ``#``."""
    words = F.regexp_extract_all(_lower(F.coalesce(F.col(url), F.lit(""))), F.lit("[\\p{L}\\p{N}-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``tokens, verdict, confidence, support, index_token`` from rows ``tokens, verdict``.

    A rule is left out if a rule of fewer tokens with the same verdict is at least as confident.
    No labelled row gives no rules.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 1_000).alias("verdict"), "confidence", "support")
    found = stored(found, "url-rules")
    # inverted index of the rules themselves: a shorter rule is looked up under its first token
    shorter = found.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    longer = found.select("*", F.explode("tokens").alias("token"))
    redundant = longer.join(shorter, "token").where(
        (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size("less") < F.size("tokens"))
        & (F.size(F.array_except("less", "tokens")) == 0)).select("tokens", "verdict").distinct()
    kept = found.join(redundant, ["tokens", "verdict"], "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (kept.select("tokens", F.explode("tokens").alias("token")).distinct().join(single, "token")
              .groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("index_token")))
    return kept.join(rarest, "tokens")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], min_support: float = 0.005, min_confidence: float = 0.8,
               default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, mined`` for every row; ``mined`` holds the tokens of the rule that
    decided, or null.

    A stated rule decides first.  Else the most confident mined rule does, then the one with more
    support, then more tokens, then the first in order; without any the verdict is ``default``.  A null
    URL has an empty host and path and no tokens.  Repeated ids and URLs are judged row by row.
    Other columns are not read.  An empty table gives no rows.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), url_tokens("url").alias("tokens"))
    rows = stored(rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules)), "urls")
    mined = stored(mine_rules(rows.where(F.col("stated").isNotNull()).select("tokens", "stated.verdict"), min_support, min_confidence), "url-index")

    # equal token sets get one answer, so a common one is looked up once
    sets = rows.where(F.col("stated").isNull()).select("tokens").distinct()
    index = mined.select(F.col("index_token").alias("token"), F.col("tokens").alias("need"), "verdict", "confidence", "support")
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("need", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.size("need").alias("n"), "need", "verdict")).alias("best"))
    best = best.select("tokens", F.col("best.verdict").alias("by_rule"), F.col("best.need").alias("need"))
    undecided = F.col("stated").isNull()
    return rows.join(best, "tokens", "left").select(
        F.col("id").alias(id_col), "host", "path", "stated.rule",
        F.coalesce("stated.verdict", "by_rule", F.lit(default)).alias("verdict"), F.when(undecided, F.col("need")).alias("mined"))
