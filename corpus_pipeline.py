"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbena.llm import decontam, jaccard, mixing, quality, tokens
from verbena.llm.common import read, write_table
from verbena.llm.queries import tokenizer_path


#: Chunks that the token encoder remembers: fewer than alone, as its workers have been through the other stages.
KNOWN = 200_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest id stays."""
    return jaccard.keep_one(docs, jaccard.jaccard_classes(docs, words=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.keep_clean(docs, decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or parts of them, as often as the mix draws them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row per document read back from them."""
    return tokens.token_binary(docs, tokenizer_path(), known=KNOWN)


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("tokens", token_output),
]

#: SQL has no factorisation machine, draws or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
