"""Registered queries of this folder: name -> function of (session, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import alignment, conversations, decontam, jaccard, language, licenses, lm, mixing, quality, simhash, tokens, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of op1 and the vocabulary file of op5.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
VOCABULARY = "byte_bpe_50k.json"
#: The other tokenizer of op13.
PIECES = "piece_bpe_32k.model"


def op1_url_filter(spark, sf_dir):
    """The given rules, then a block list of all hosts of the table that carry a suspect word."""
    pages = table(spark, sf_dir, "pages")
    rules = urls.build(spark.createDataFrame(list(URL_RULES), "rule string, verdict string"))
    return urls.judge(pages, rules, urls.build(urls.suspect_hosts(pages)))


def op2_mix_shares(spark, sf_dir):
    return mixing.shares(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scores(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licence_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op8_languages(spark, sf_dir):
    """All documents (doc_id; their column lang is the declaration, their source the host) and all pages (page_id)."""
    docs = language.identify(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    )
    pages = language.page_languages(table(spark, sf_dir, "pages"))
    return docs.withColumnRenamed("id", "doc_id").unionByName(pages, allowMissingColumns=True)


def op9_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    """All conversations, damaged as the contract has it, then repaired."""
    rows = conversations.normalised(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.damaged(rows), rows)


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


def queries() -> dict[str, Query]:
    found = (
        op1_url_filter, op2_mix_shares, op3_quality, op4_lm_scores, op5_token_counts,
        op6_decontamination, op7_licence_scan, op8_languages, op9_warc, op10_simhash, op11_jaccard_join, op12_conversation_repair, op13_token_alignment,
    )
    return {f.__name__: f for f in found}
