"""The queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontaminate, importance_resample, piece_codec, rule_ledger, secret_scan, simhash_dedup, site_quality, suffix_dedup, token_store, toxicity, url_filter, whiten
from weftline.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_documents(table(spark, sf_dir, "documents"), PIECE_BPE, decode=True))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_conflict(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows), ordered=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: their source stands in for the host, and the language, as in many sites' first path part, for the path."""
    docs = table(spark, sf_dir, "documents")
    site = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return site_quality.score(docs.select("doc_id", "text", site.alias("site")), table(spark, sf_dir, "labels"), "site")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.verdicts(rule_ledger.stored(table(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy changes, from the ledger of op9."""
    return rule_ledger.all_ablations(rule_ledger.stored(table(spark, sf_dir, "documents")))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_token_store, op3_piece_codec, op4_chat_format, op5_toxicity, op6_decontaminate, op7_site_quality, op8_secret_scan, op9_rule_ledger, rule_ablations, op10_simhash_dedup, op11_importance_resample, op12_suffix_dedup, op13_whiten, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.ORACLE, "op4_chat_format": chat_format.ORACLE, "op9_rule_ledger": rule_ledger.ORACLE, "rule_ablations": rule_ledger.ABLATIONS}
