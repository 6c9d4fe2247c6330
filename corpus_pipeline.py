"""From raw documents to packed sequences: language ID, SimHash near-dedup, secret masking, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents. Null texts, texts without letters (and so empty ones)
go in the first stage; extra columns pass through; empty tables give empty tables.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid, mixing, packing, secrets, simhash
from lamina.llm.common import shared_dir
from lamina.llm.queries import tokenizer_path
from lamina.session import delete, delete_on_exit, share_code, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told; models come from the labelled documents that aren't held out."""
    return langid.known(docs, langid.sample(docs.where(~langid.held_out(F.col("doc_id")))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that SimHash finds near and whose five-word shingles overlap by 0.8 or more."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece; a document that the mix repeats has its pieces as often."""
    found = packing.pack(packing.pieces(docs, tokenizer_path()))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")



def _ready(stage):
    """The stage, with this folder's code known to Python workers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(share_code(spark), docs, sf_dir)

    return run_stage


STAGES = [(name, _ready(stage)) for name, stage in (("language_id", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack))]

#: SQL expresses neither the parse of language ID nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents table of ``sf_dir``. A stage's tables go once the next stage is written, the last one with the application."""
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    delete_on_exit(spark, at)
    for k, (name, stage) in enumerate(STAGES):
        with tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if before is not None:
            delete(spark, before)
        before = f"{at}/{k}-{name}"
    return docs
