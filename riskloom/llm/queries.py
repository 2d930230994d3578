"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, and the DuckDB
SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.llm import (context_mixing, decontaminate, language_id, near_dedup, periodic, pieces,
                          prefix_trie, quality_net, quality_rules, secret_scan, sharding, toxicity, warc)
from riskloom.llm.common import table


def op1_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document under a decision list learned from labels."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled_statistics(
        docs, table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, rules)


def op2_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_quality_classifier(spark, sf_dir):
    """Quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    vectors = quality_net.context_vectors(docs)
    net = quality_net.train(docs, table(spark, sf_dir, "labels"), vectors)
    return quality_net.score_documents(docs, vectors, net)


def op4_secret_scan(spark, sf_dir):
    """Secret spans of every whole document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"]))


def op5_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document and whether it is the one kept."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    """Every document in one of 16 shards of near-equal bytes, by fixed virtual slots."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    """Every page written to WARC archives and read back by boundary-chain verification."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark, sf_dir):
    """Words of every document inside a benchmark window of 10 words, and the items hit."""
    return decontaminate.digest(decontaminate.hits(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op9_sentencepiece(spark, sf_dir):
    """Ids of every whole document and whether they decode to it."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
        "round_trip")


def op10_language_id(spark, sf_dir):
    """Language of every document, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_documents(docs, language_id.learn(docs))


def op11_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_context_mixing(spark, sf_dir):
    """Base score and mixed-context log probability of every document."""
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of the word sequence of every document, and its collapsed text."""
    return periodic.digest(periodic.periodic_runs(
        table(spark, sf_dir, "documents"), ["doc_id"], rearrange=periodic.looped))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_quality_classifier, op4_secret_scan,
    op5_minhash_near_dedup, op6_sharding,
    op7_warc, op8_benchmark_decontamination, op9_sentencepiece, op10_language_id,
    op11_prefix_trie, op12_context_mixing, op13_periodic_runs)}
ORACLES = {"op7_warc": warc.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE,
           "op11_prefix_trie": prefix_trie.ORACLE}
