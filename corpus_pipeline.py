"""A corpus pipeline of five stages: rules, lines, near duplicates, mixture, tokens.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Results for odd input, stage by stage: a null or blank text fails the rules; rows without a doc_id pass lines and near
duplicates as rows of their own; a null source is a source; wholly equal rows share one fate, and near duplicates keep one
document for each doc_id's group, so rows that repeat a doc_id stay together; columns of any further names are kept; an
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, line_dedup, mixing, parity_join, quality_rules
from cairn.llm.common import dropped, saved, table
from cairn.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.accepted(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand elsewhere already; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    return out.selectExpr(*["cast(length(text) as bigint) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return parity_join.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of its schedule."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests."""
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("parity_join", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL cannot express the fuzzy lines and the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if used is not None:
            dropped(used)
        used = docs
    return STAGES[-1][1](spark, docs, sf_dir)
