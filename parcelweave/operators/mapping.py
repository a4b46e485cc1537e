"""Field mapping driven by plain configuration, compiled to projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.transforms import (
    bulk_transform_column,
    empty_to_null,
    transform_column,
)
from parcelweave.session import salted_join

# Header names that all mean the parcel id.
PARCEL_ID_SYNONYMS = ("PIN", "ParcelID", "MapNumber")


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def apply_mapping(df: DataFrame, fields: Mapping[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Output holds the mapped fields, after the columns named in ``keep``.

    Order of application: source, constant, transform, default for null or empty.
    """
    mapped, defaults = [], {}
    for name, spec in fields.items():
        if not isinstance(spec, Mapping):
            continue
        source = spec.get("source")
        value = F.col(f"`{source}`") if source in df.columns else F.lit(None).cast("string")
        if spec.get("const") is not None:
            constant = F.lit(spec["const"])
            value = constant if source not in df.columns else F.coalesce(value, constant.cast(_type_of(df, source)))
        if spec.get("transform"):
            value = transform_column(spec["transform"], value, spec)
        mapped.append(value.alias(name))
        defaults[name] = spec.get("default")
    projected = df.select(*keep, *mapped)

    def finish(name: str) -> Column:
        value, kind = F.col(f"`{name}`"), _type_of(projected, name)
        if kind == "string":
            value = empty_to_null(value)
        if defaults[name] is not None:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        return value.alias(name)

    return projected.select(*keep, *[finish(n) for n in defaults])


@dataclass(frozen=True)
class BulkProfile:
    """How one bulk source becomes records: renames, transforms, required and key fields."""

    mappings: Mapping[str, str]
    transforms: Mapping[str, str] = field(default_factory=dict)
    constants: Mapping[str, object] = field(default_factory=dict)
    composites: Mapping[str, Sequence[str]] = field(default_factory=dict)
    separator: str = " "
    required: Sequence[str] = ()
    key: Sequence[str] = ()


def bulk_map(df: DataFrame, profile: BulkProfile) -> DataFrame:
    """Renamed and transformed fields first, then source columns whose name is still free.

    Constants fill target fields that no mapped column provides; composites join columns.
    """
    chosen: dict[str, Column] = {}
    for source, target in profile.mappings.items():
        if source not in df.columns:
            continue
        value, name = F.col(f"`{source}`"), profile.transforms.get(target)
        if name:
            value = bulk_transform_column(name, value, {"source_type": _type_of(df, source)})
        chosen[target] = value
    for target, parts in profile.composites.items():
        chosen[target] = F.concat_ws(profile.separator, *[F.col(f"`{p}`").cast("string") for p in parts])
    for column in df.columns:
        if column not in profile.mappings and column not in chosen:
            chosen[column] = F.col(f"`{column}`")
    for target, constant in profile.constants.items():
        chosen.setdefault(target, F.lit(constant))
    return df.select(*[value.alias(target) for target, value in chosen.items()])


def normalize_columns(df: DataFrame, synonyms: Mapping[str, str] | None = None) -> DataFrame:
    """Rename known header synonyms; the comparison ignores case, and the first hit wins."""
    renames = synonyms or {name: "parcel_id" for name in PARCEL_ID_SYNONYMS}
    by_lower = {name.lower(): target for name, target in renames.items()}
    taken, columns = {c for c in df.columns if c in renames.values()}, []
    for column in df.columns:
        target = by_lower.get(column.lower(), column)
        if target != column and target in taken:
            target = column
        taken.add(target)
        columns.append(F.col(f"`{column}`").alias(target))
    return df.select(*columns)


def suggest_mapping(headers: DataFrame, targets: Sequence[str], header_col: str = "header") -> DataFrame:
    """Closest target for every distinct header by edit distance over bare lower-case letters.

    The target list is configuration, so it rides along as an array literal: no join.
    """
    bare = F.regexp_replace(F.lower(F.col(header_col)), "[^a-z0-9]", "")
    scored = F.array_min(
        F.array(
            *[
                F.struct(
                    F.levenshtein(bare, F.lit("".join(ch for ch in t.lower() if ch.isalnum()))).alias("distance"),
                    F.lit(t).alias("target"),
                )
                for t in targets
            ]
        )
    )
    best = headers.select(header_col).distinct().withColumn("best", scored)
    return best.select(header_col, F.col("best.target").alias("target"), F.col("best.distance").cast("bigint").alias("distance"))


def resolve_overrides(
    df: DataFrame, overrides: DataFrame, on: list[str], defaults: Mapping[str, object]
) -> DataFrame:
    """Add each configured value: the override of the row's key, else the platform default.

    ``overrides`` holds one row per key. A key such as a large county may own most rows.
    """
    names = list(defaults)
    renamed = overrides.select(*on, *[F.col(n).alias(f"__o_{n}") for n in names])
    joined = salted_join(df, renamed, on, "left", spread="all")
    return joined.select(
        *df.columns, *[F.coalesce(F.col(f"__o_{n}"), F.lit(defaults[n])).alias(n) for n in names]
    )
