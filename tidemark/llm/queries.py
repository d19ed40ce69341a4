"""The registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import reach
from . import alignment, frames, langid, license, mixing, packing, quality, simhash, topk, toxicity, unigram, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archive(_table(spark, sf_dir, "pages"))
    records = warc.read_archive(spark, manifest, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.read_tokens(spark, frames.write_tokens(_table(spark, sf_dir, "documents")))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_hash_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(_table(spark, sf_dir, "documents"))


def op11_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_reassembly, op2_simhash_anchors, op3_language_crf, op4_token_frames, op5_pattern_packing, op6_hash_mixing, op7_license_scan, op8_host_quality, op9_exact_topk, op10_token_counts, op11_toxic_grammar, op12_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_reassembly": warc.ORACLE, "op6_hash_mixing": mixing.ORACLE, "op8_host_quality": quality.ORACLE, "op9_exact_topk": topk.ORACLE}
