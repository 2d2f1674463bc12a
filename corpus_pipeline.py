"""The corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``docs``.  Rows are told apart by id and text,
so repeated and null ids are safe; identical rows fall under the same decision.  Columns that a stage works with get
names that ``docs`` lacks, so further columns of any name are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import stored, table
from vigil.llm.decontaminate import contaminated
from vigil.llm.packing import pack
from vigil.llm.pii import sanitise
from vigil.llm.quality import judge_quality
from vigil.llm.simhash import simhash_components

def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a column that ``docs`` lacks."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _key(docs: DataFrame) -> tuple[str, DataFrame]:
    """A free name, and ``docs`` with the struct of id and text hash, which tells rows apart, in it."""
    key = _free(docs, "_key")
    return key, docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    score, keep = _free(docs, "_score"), _free(docs, "_keep")
    judged = judge_quality(docs, score_col=score, keep_col=keep, labels=table(spark, sf_dir, "labels"))
    return judged.where(F.col(keep)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one of the smallest id."""
    key, keyed = _key(docs)
    groups = simhash_components(keyed.select(key, "text"), shingle=4, max_bits=4, id_col=key).select(key, "component_id")
    times = _free(keyed, "_n")
    first = groups.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count(F.lit(1)).alias(times))
    kept = keyed.join(stored(first, "pipeline-first"), key)
    once, again = kept.where(F.col(times) == 1), kept.where(F.col(times) > 1).dropDuplicates([key])
    return once.unionByName(again).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    key, keyed = _key(docs)
    found = contaminated(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.8, id_col=key, item_id="item_id")
    return keyed.join(stored(found.select(key).distinct(), "pipeline-contaminated"), key, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; ``n_chars`` follows the text."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece with its ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: The trained scorer, the components, the tiles and the token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
