"""Idempotent upserts by business key.

Both sides of a merge hold one row per key (``last_write_wins`` first), so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.session import salted_join

PARCEL_KEY = ("parcel_id", "county", "state")


def compute_key(fields: Sequence[str], columns: Sequence[str] | None = None) -> Column:
    """Key text: field values joined by a bar, with nothing for null or absent ones."""
    parts = [
        F.lit("")
        if columns is not None and f not in columns
        else F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))
        for f in fields
    ]
    return F.concat_ws("|", *parts)


def missing_key_fields(fields: Sequence[str], columns: Sequence[str]) -> Column:
    """Names of key fields that are absent, null or empty in the row."""
    checks = []
    for name in fields:
        if name in columns:
            value = F.col(f"`{name}`")
            checks.append(F.when(value.isNull() | (value.cast("string") == ""), F.lit(name)))
        else:
            checks.append(F.lit(name))
    return F.array_compact(F.array(*checks))


def reject_keyless(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.where(F.size(missing_key_fields(key, df.columns)) == 0)


def last_write_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, not a window: rows of one key shrink to one before they are shuffled.
    """
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(newest).select(*[F.col(c) if c in key else F.col(f"__row.`{c}`") for c in df.columns])


def first_write_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    oldest = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(oldest).select(*[F.col(c) if c in key else F.col(f"__row.`{c}`") for c in df.columns])


def upsert_replace(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    kept = existing.join(new.select(*key), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_merge(
    existing: DataFrame, new: DataFrame, key: Sequence[str], ignore_nulls: bool = False
) -> DataFrame:
    """Field-wise new over old. A null in ``new`` overwrites unless ``ignore_nulls``."""
    keys = list(key)
    old = existing.select(*keys, F.lit(True).alias("__in_old"), F.struct(*existing.columns).alias("__old"))
    fresh = new.select(*keys, F.lit(True).alias("__in_new"), F.struct(*new.columns).alias("__new"))
    joined = old.join(fresh, keys, "full_outer")

    def pick(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in new.columns:
            return F.col(f"__old.`{name}`").alias(name)
        incoming = F.col(f"__new.`{name}`")
        if name not in existing.columns:
            return incoming.alias(name)
        stored = F.col(f"__old.`{name}`")
        if ignore_nulls:
            return F.coalesce(incoming, stored).alias(name)
        return F.when(F.col("__in_new"), incoming).otherwise(stored).alias(name)

    names = [*existing.columns, *[c for c in new.columns if c not in existing.columns]]
    return joined.select(*[pick(n) for n in names])


_STRATEGIES = {"replace": upsert_replace, "merge": upsert_merge}


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], strategy: str = "merge") -> DataFrame:
    if strategy not in _STRATEGIES:
        raise ValueError(f"unknown upsert strategy: {strategy}")
    return _STRATEGIES[strategy](existing, new, key)


def batch_upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Label each new row ``inserted`` or ``updated`` by presence of its key in ``existing``."""
    known = existing.select(*key).withColumn("__known", F.lit(True))
    labelled = new.join(known, list(key), "left")
    action = F.when(F.col("__known"), "updated").otherwise("inserted")
    return labelled.select(*new.columns, action.alias("action"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def detect_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows that share their key with another row, and the size of their group."""
    return salted_join(df, duplicate_keys(df, key), list(key)).select(*df.columns, "n")


def consolidate_sources(
    df: DataFrame, key: Sequence[str], type_col: str, sources: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """One record per key with a flag per data type; fields take the first source that has them."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(type_col))
    ranked = df.withColumn("__rank", F.when(rank > 0, rank).otherwise(F.lit(len(sources) + 1)))
    flags = [F.bool_or(F.col(type_col) == s).alias(f"has_{s}") for s in sources]

    def first_present(name: str) -> Column:
        # Ties inside one source resolve to the smallest value, so reruns agree.
        holder = F.when(F.col(name).isNotNull(), F.struct(F.col("__rank"), F.col(name).alias("v")))
        return F.min(holder)["v"].alias(name)

    return ranked.groupBy(*key).agg(*flags, *[first_present(n) for n in fields])


def apply_profile_key(df: DataFrame, profile_key: Sequence[str] = PARCEL_KEY) -> DataFrame:
    """Reject rows without a whole business key and add the key text."""
    return reject_keyless(df, profile_key).withColumn("record_key", compute_key(profile_key))


def action_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("action").agg(F.count("*").alias("n"))
