"""Result tables and file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelweave.operators.lifecycle import retention_class
from parcelweave.operators.upsert import last_write_wins


def result_id(parcel_id: Column, fallback: Column) -> Column:
    """``bulk_{parcel_id}``, or a hash of ``fallback`` for records without one."""
    return F.when(parcel_id != "", F.concat(F.lit("bulk_"), parcel_id)).otherwise(F.sha2(fallback, 256))


def write_results(
    records: DataFrame, path: str, order: Sequence[str], form: str = "parquet", rows_per_file: int = 5_000_000
) -> None:
    """Last record per (platform, id), partitioned by platform.

    Rebalancing gives a large platform as many tasks as its size asks for and packs small
    ones together. Writes a new directory; switch readers to it.
    """
    latest = last_write_wins(records, ["platform", "id"], order).hint("rebalance", "platform")
    writer = latest.write.partitionBy("platform").option("maxRecordsPerFile", rows_per_file)
    writer.format(form).mode("error").save(path)


def read_result(spark: SparkSession, path: str, platform: str, record_id: str, form: str = "parquet") -> DataFrame:
    """One result by platform (partition pruning) and id (pushed filter)."""
    rows = spark.read.format(form).load(path)
    return rows.where((F.col("platform") == platform) & (F.col("id") == record_id))


def append_csv_sink(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", False).csv(path)


def write_checked(validated: DataFrame, path: str, form: str = "parquet") -> dict[str, int]:
    """Write validated records once, split into ``is_valid=true`` and ``is_valid=false``.

    Records are counted on the way, so neither the split nor the report reads the source again.
    """
    seen = Observation("checked")
    counted = validated.observe(
        seen, F.count("*").alias("total_rows"), F.count_if(~F.col("is_valid")).alias("error_rows")
    )
    counted.write.partitionBy("is_valid").format(form).mode("error").save(path)
    return seen.get


def read_checked(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Good records without check columns, and quarantined ones with their errors."""
    rows = spark.read.format(form).load(path)
    # Partition values are read back as text.
    valid = F.col("is_valid").cast("string") == "true"
    return rows.where(valid).drop("is_valid", "errors"), rows.where(~valid).drop("is_valid")


# Codec by retention class: what is read often stays cheap to read, what is archived is small.
CLASS_CODECS = {"keep": "snappy", "compress": "zstd", "archive": "gzip"}


def rewrite_by_retention(df: DataFrame, saved_at: str, as_of: Column, path: str, codecs: Mapping[str, str] = CLASS_CODECS) -> None:
    """Write rows into one folder per retention class (``class=...``), each with its codec.

    A class is one filtered pass over the source. Writes a new directory; switch readers to it.
    """
    own = retention_class(F.col(saved_at), as_of)
    for name, codec in codecs.items():
        df.where(own == name).write.option("compression", codec).mode("error").parquet(f"{path}/class={name}")
