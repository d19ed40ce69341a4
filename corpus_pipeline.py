"""The corpus pipeline: quality rules, language ID, near-duplicates, mixing to target weights, packing.

Every stage but the last returns the columns of the documents it was given.  Rejected are: documents that fail the
quality rules or whose host does; texts without a letter or without a clear language; all but one document of each
near-duplicate group (sets of 5-word shingles with a Jaccard similarity of 0.8 or more, each link checked exactly), by row, so rows without a doc_id or with a repeated one
count like others; and what the mix does not take (documents that it takes twice appear twice).  Extra columns come along
under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, quality, simhash
from tidemark.llm.common import column, materialize
from tidemark.storage import reach

#: Least share of a text's words that its language must have.
MIN_LANGUAGE_SHARE = 0.4
#: Words of a shingle, and the least similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8

#: Language models and near-duplicates have no SQL form.
ORACLE_SQL = None


def _with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all columns as one struct that no helper column can clash with."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("__row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    rows = quality.with_features(_with_row(docs, "source", "text")).select("__row", "source", "base_failed")
    return quality.judged(materialize(rows, "judged-rows")).where("kept").select("__row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    found = _with_row(docs, "text").withColumn("__lang", langid.prediction(spark, langid.train(docs)))
    return found.where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= MIN_LANGUAGE_SHARE)).select("__row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, or one without an id where all are."""
    odd = materialize(simhash.surplus(docs.select("doc_id", "text"), shingle=SHINGLE, similarity=SIMILARITY).select(F.col("doc_id").alias("__id"), F.col("key").alias("__of"), "kept"), "surplus")
    keyed = _with_row(docs, "doc_id", "text").withColumn("__key", simhash.text_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of"))
    # A share of all rows is odd, so no broadcast holds them at every size; a key's rows are one in the hashed side.
    marked = keyed.join(odd.hint("shuffle_hash"), same, "left")
    once = marked.where("__of is null").select("__row.*")
    if odd.where("kept").isEmpty():
        return once
    repeated = marked.where("kept").dropDuplicates(["doc_id", "__key"]).select("__row.*")
    return once.unionByName(repeated)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs, carry=docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    reach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
