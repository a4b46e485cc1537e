"""Record validation, quarantine and the job report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.validators import RULES, missing_error


def validation_errors(columns: Sequence[str], rules: Mapping) -> Column:
    """Ordered error texts: the required list first, then field rules in configured order.

    Field rules skip null values; a required field that the data lacks counts as missing.
    """
    found = []
    for name in rules.get("required", []):
        value = F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")
        found.append(missing_error(name, value))
    for name, checks in rules.get("fields", {}).items():
        if name not in columns or not isinstance(checks, Mapping):
            continue
        value = F.col(f"`{name}`")
        for rule, setting in checks.items():
            error = RULES[rule](name, value, setting) if rule in RULES else None
            if error is not None:
                found.append(F.when(value.isNotNull(), error))
    if not found:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*found))


def validate_records(df: DataFrame, rules: Mapping) -> DataFrame:
    checked = df.withColumn("errors", validation_errors(df.columns, rules))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without check columns, and bad rows with their errors."""
    good = validated.where("is_valid").drop("errors", "is_valid")
    bad = validated.where(~F.col("is_valid")).drop("is_valid")
    return good, bad


def validation_summary(validated: DataFrame) -> DataFrame:
    return (
        validated.select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count("*").alias("n"))
    )


def bulk_job_report(validated: DataFrame, total_rows: Column | int | None = None) -> DataFrame:
    """One row: total, processed and failed rows, and progress in percent (0 for no rows)."""
    counted = validated.agg(
        F.count("*").alias("seen"), F.count_if(~F.col("is_valid")).alias("error_rows")
    )
    total = F.col("seen") if total_rows is None else F.lit(total_rows)
    progress = F.when(total > 0, F.round(F.col("seen") * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return counted.select(
        total.cast("bigint").alias("total_rows"),
        (F.col("seen") - F.col("error_rows")).alias("inserted_rows"),
        F.col("seen").alias("processed_rows"),
        "error_rows",
        progress.alias("progress_percent"),
        F.when(F.col("seen") >= total, "completed").otherwise("processing").alias("status"),
    )
