"""Corpus pipeline: five stages over ``documents``, each of which calls one operator.

1. toxicity: documents that the class-conditional models predict toxic go;
2. near_duplicates: one document of each SimHash component stays;
3. decontamination: documents with a window similar to a benchmark item go;
4. secrets: the spans of secrets in texts are replaced by a mark (and n_chars is counted again);
5. pieces: texts are encoded and decoded; the rows are (doc_id, n_tokens, ids_sha256, decoded_sha256).

A stage reads what the stage before it wrote. All but the last return the columns of ``documents``. Null or empty
texts, ties and repeated rows are treated as the operators' docstrings say; of rows that are equal in id and text one
stays after stage 2.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, piece_codec, secret_scan, simhash_dedup, toxicity
from weftline.llm.common import staged, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: Models and automata have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
