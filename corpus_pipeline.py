"""A corpus from raw documents: reject low quality, drop shared lines, keep one of near copies, drop what leaks a benchmark,
mix the sources. Each stage works on what its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm import decontaminate, jaccard, line_dedup, mixing, quality_rules
from cellspan.llm.common import materialize, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others share; n_chars is that of the new text."""
    kept = line_dedup.dedup_lines(docs)
    text = F.col("kept_text")
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest id.
    op1's SimHash components come first, each checked exactly; MinHash bands find the copies whose fingerprints differ more."""
    return jaccard.keep_one(docs, shingle=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix: doc_id, text, lang, source, size, copies (times it is taken) and taken (words)."""
    mixed = mixing.mix_sources(docs).where("copies > 0").select(F.col("doc_id").alias("id"), "th", "size", "copies", "taken").distinct()
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    both = rows.join(mixed, rows["doc_id"].eqNullSafe(mixed["id"]) & (F.col("own") == F.col("th")))
    return both.select("doc_id", "text", "lang", "source", "size", "copies", "taken")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark), ("mixing", mix)]

#: Expectation-maximisation, SimHash, MinHash bands and banded alignment have no SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is deleted once the next stage's rows are: two copies of the corpus
    are on disk at most."""
    docs, start = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, start, written() - 1)
    return docs
