"""The corpus pipeline over ``documents``: STAGES in order, each written as Parquet under the
shared checkpoint folder and read again as the next one's input.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but for the
last, returns the columns of ``documents``. Benchmark and labels come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, near_dedup, pieces, quality_rules, secret_scan
from riskloom.llm.common import handed_on, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality_rules.learn(quality_rules.labelled_statistics(
        docs, table(spark, sf_dir, "labels")))
    return quality_rules.kept_documents(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id."""
    return near_dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are masked in the text; no document goes."""
    return secret_scan.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text becomes its piece ids and their number."""
    return pieces.tokenized(docs)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secrets),
          ("sentencepiece", tokens)]

#: Learned and hash-based stages have no SQL form; tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = handed_on(stage(spark, docs, sf_dir), name)
    return docs
