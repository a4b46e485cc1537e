"""Corpus pipeline: documents in, packed token pieces out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read back as the next one's ``docs``. All but the last return the columns of
documents. Toxic documents go, documents that fail the quality rules go, one document of every class
of near copies stays, secrets are masked in the texts that have any, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.llm import near, packing, quality, secrets, toxicity
from parcelweave.session import fresh_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learnt from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.is_held_out(F.col("doc_id")))
    return toxicity.keep_civil(docs, toxicity.train(docs, labels))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies, the document with the smallest id."""
    return near.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows."""
    return secrets.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in packed sequences."""
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: No SQL says what the machine, the sketches and the tokenizer decide; a brute-force test does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
