"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what the next stage gets as docs, written
as Parquet in between. All stages but the last return the columns of documents. SQL can't express the classifier's fit, so
that ORACLE_SQL is None; the tests hold each stage against a plain version of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from larkspur.llm.common import set_aside, table, written

#: Near duplicates on word shingles take five words here.
SHINGLE = 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents hold stay in the largest doc_id only."""
    own, (doc, text), restored = set_aside(docs, "doc_id", "text")
    return restored(line_dedup.dedup_lines(own, doc, text))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return near_dedup.keep_one_of_each(docs, shingle=SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its token ids, their number, and digests of ids and decoded text."""
    return bpe.encoded_documents(docs)


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_near), ("source_mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
