"""The queries of this folder, thin around its operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, sample

    docs = _table(spark, sf_dir, "documents")
    found = docs.withColumn("p", predict(F.col("text"), sample(docs.where(~held_out(F.col("doc_id"))))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    return scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, scan, spelled

    found = scan(_table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:  # a second parameter of the inner function would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    found = pack(pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table has no paths; a document's file is source/lang/doc_id.txt."""
    from .licences import scan

    docs = _table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path")))
    return found.withColumnRenamed("file_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_embedding_dedup, op3_simhash, op4_language, op5_pii, op6_secrets, op7_packing, op8_nearest, op9_quality, op10_licences)}


#: All pairs by cosine, and the smallest vec_id reachable. The other operators' results need XXH64, tokenizers, random
#: draws or models that SQL lacks, or are approximate; tests hold them against brute force.
EMBEDDING_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
 least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
 degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT least.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, least.vec_id = component_id AS kept FROM least LEFT JOIN degree ON a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": EMBEDDING_DEDUP}
