"""Content identity: storing each distinct text once, and the raw file manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATH = 255


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def content_map(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Every id with the hash of its content: the link from record to stored text."""
    return df.select(id_col, content_hash(F.col(content_col)).alias("content_hash"))


def distinct_content(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Each distinct content once, under its smallest id, with the number of copies.

    Copies collapse before the shuffle, so a text that fills a third of the table costs one
    row per task. The text itself travels at most once per task and hash.
    """
    hashed = df.select(id_col, content_col, content_hash(F.col(content_col)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(
        F.min(id_col).alias(id_col),
        F.count("*").alias("copies"),
        F.any_value(content_col).alias(content_col),
    )


def dedupe_rate(df: DataFrame, content_col: str) -> DataFrame:
    """File count, distinct count and the share of files that are copies."""
    per_hash = df.groupBy(content_hash(F.col(content_col)).alias("h")).agg(F.count("*").alias("n"))
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count("*").alias("distinct_files")
    ).withColumn(
        "dedupe_rate",
        F.when(F.col("files") > 0, F.round(1 - F.col("distinct_files") / F.col("files"), 6)).otherwise(F.lit(0.0)),
    )


def sanitize_id(value: Column) -> Column:
    return F.regexp_replace(value, r'[/\\<>:"|?*]', "_")


def raw_manifest(
    df: DataFrame,
    root: str,
    path_parts: Sequence[str],
    id_col: str,
    content_col: str,
    timestamp_col: str,
) -> DataFrame:
    """Hash, size and directory of every raw page.

    A row without id gets ``{timestamp}_{hash}`` and a flag; a path that is too long is
    replaced by a directory named after its hash.
    """
    digest = content_hash(F.col(content_col))
    has_id = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
    stamp = F.date_format(timestamp_col, "yyyyMMdd'T'HHmmss")
    name = F.when(has_id, sanitize_id(F.col(id_col).cast("string"))).otherwise(
        F.concat_ws("_", stamp, "sha256")
    )
    hashed = df.withColumn("sha256", digest).withColumn("__name", name)
    full = F.concat_ws("/", F.lit(root), *[F.col(p).cast("string") for p in path_parts], "__name")
    short = F.concat_ws("/", F.lit(root), F.sha2(full, 256))
    return hashed.select(
        *[c for c in df.columns if c != content_col],
        "sha256",
        F.octet_length(content_col).cast("bigint").alias("size_bytes"),
        F.when(F.length(full) > MAX_PATH, short).otherwise(full).alias("parcel_dir"),
        (~has_id).alias("id_missing"),
    )
