"""The bulk load: map, check, deduplicate and upsert one drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from parcelweave.operators.mapping import BulkProfile, bulk_map
from parcelweave.operators.upsert import last_write_wins, reject_keyless, upsert
from parcelweave.operators.validation import bulk_job_report, quarantine, validate_records


@dataclass(frozen=True)
class BulkLoad:
    """Lazy outputs of a bulk load."""

    merged: DataFrame
    rejected: DataFrame
    report: DataFrame


def bulk_load(
    source: DataFrame,
    existing: DataFrame,
    profile: BulkProfile,
    order: Sequence[str],
    rules: Mapping | None = None,
    strategy: str = "merge",
) -> BulkLoad:
    """``order`` names columns that tell which of two rows of one key came later."""
    checks = {**(rules or {})}
    checks["required"] = [*profile.required, *checks.get("required", [])]
    validated = validate_records(bulk_map(source, profile), checks)
    good, bad = quarantine(validated)
    latest = last_write_wins(reject_keyless(good, profile.key), profile.key, order)
    stored = latest.drop(*[c for c in order if c not in existing.columns and c not in profile.key])
    return BulkLoad(upsert(existing, stored, profile.key, strategy), bad, bulk_job_report(validated))
