"""From raw documents to token ids: five stages, each working on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.llm import bpe, decontaminate, langid, neardup, substring
from tagwise.llm.common import aside, drop_since, drop_table, mark, materialize, prepare

VOCABULARY, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN
#: Fewer than the operator's own: earlier stages leave less memory to the tokenizer's workers.
CACHE_WORDS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models, fitted on the documents' own labels, reject go."""
    return langid.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere are cut; documents of which nothing is left go.  ``n_chars`` of a cut text is counted
    anew; all other columns stay as they are, whatever their names."""
    rows, back = aside(docs, "doc_id", "text", "n_chars")
    cut = substring.remove_repeats(rows)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    text = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", text.cast(docs.schema["n_chars"].dataType)).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    out = bpe.encode_checked(docs, public_tokenizers.path(VOCABULARY), PATTERN, keep=["doc_id", "lang", "source"], cache_words=CACHE_WORDS)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can't express these stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what a stage wrote for itself is deleted
    when its result is written."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        start = mark()
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(spark, start, docs)
        if name != STAGES[0][0]:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
