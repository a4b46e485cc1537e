"""Priority scoring of tasks and parcels. Time always enters as ``as_of``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.urls import relationship_delta
from parcelweave.session import salted_join

# Base score and tier by parcel status.
STATUS_SCORES = {
    "paid_no_liens": (0.1, "HIBERNATION"),
    "paid_active_liens": (1.0, "LOW"),
    "delinquent": (5.0, "HIGH"),
    "otc_available": (6.0, "HIGH"),
    "multiple_holders": (7.5, "HIGH"),
    "foreclosure_filed": (9.0, "CRITICAL"),
    "auction_scheduled": (10.0, "CRITICAL"),
}
# Hours until the next scrape, and the longest allowed delay, by tier.
TIER_HOURS = {
    "CRITICAL": (12, 24),
    "HIGH": (3 * 24, 7 * 24),
    "MEDIUM": (7 * 24, 14 * 24),
    "LOW": (30 * 24, 60 * 24),
    "HIBERNATION": (90 * 24, 180 * 24),
}
# Tiers from least to most urgent.
TIER_ORDER = ("HIBERNATION", "LOW", "MEDIUM", "HIGH", "CRITICAL")
# Priority and frequency by state type and phase.
STATE_MATRIX = {
    ("AZ", "delinquent"): ("HIGH", "weekly"),
    ("AZ", "active_lien"): ("LOW", "monthly"),
    ("AZ", "foreclosure"): ("CRITICAL", "daily"),
    ("FL", "delinquent"): ("HIGH", "weekly"),
    ("FL", "active_lien"): ("LOW", "monthly"),
    ("FL", "tda_filed"): ("SUPER HOT", "daily"),
    ("DEED", "auction_scheduled"): ("CRITICAL", "daily"),
}
# The state boost and its end, the value-to-tax ratio boost, the interest boost.
STATE_BOOST = ("AZ", "2026-02-28", 2.0)
RATIO_BOOST = (20.0, 1.5)
INTEREST_BOOST = 5.0
GRAVITY_PER_DAY = 0.1
PAID_GRAVITY_CAP = 1.0
# Priorities of risky tasks and of tasks in the boosted state, and their tags.
RISK_PRIORITY = 200
STATE_PRIORITY = 150
STATE_TAG = "auction_feb_2026"


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Literal lookup table as an expression; null for unknown keys."""
    chain = F
    for name, value in table.items():
        chain = chain.when(key == name, F.lit(value))
    return chain.otherwise(F.lit(None))


def task_priority(
    relationship: Column,
    created_at: Column,
    retry_count: Column,
    as_of: Column,
    boost: Column | int = 0,
    base: int = 0,
    deltas: Mapping[str, int] | None = None,
) -> Column:
    """Base, relationship delta, one per hour of age up to 10, two per retry, and a boost."""
    # least() skips nulls: a task without creation time has no age.
    age = F.least(F.coalesce(F.timestamp_diff("HOUR", created_at, as_of), F.lit(0)), F.lit(10))
    related = F.coalesce(relationship_delta(relationship, dict(deltas or {})), F.lit(0))
    tries = F.greatest(F.coalesce(retry_count, F.lit(0)), F.lit(0)) * 2
    return (F.lit(base) + related + age + tries + boost).cast("bigint")


def boost_priority(priority: Column, factor: float = 1.5, most: int = 20) -> Column:
    return priority + F.least((priority * F.lit(factor - 1)).cast("bigint"), F.lit(most))


def decay_priority(priority: Column, factor: float = 0.9, least: int = 0) -> Column:
    return F.greatest((priority * F.lit(factor)).cast("bigint"), F.lit(least))


def delinquency_score(df: DataFrame, as_of: Column) -> DataFrame:
    """Add ``raw_score``, ``priority_score`` within 0..10, and ``tier``.

    Reads status, state, market_value, tax_due, last_viewed_at and last_scraped_at.
    """
    status = F.col("status")
    state, until, state_factor = STATE_BOOST
    ratio, ratio_factor = RATIO_BOOST
    by_state = F.when((F.col("state") == state) & (F.to_date(as_of) < F.lit(until).cast("date")), state_factor).otherwise(1.0)
    by_ratio = F.when(F.try_divide(F.col("market_value"), F.col("tax_due")) > ratio, ratio_factor).otherwise(1.0)
    since_view = F.timestamp_diff("SECOND", F.col("last_viewed_at"), as_of)
    by_interest = F.when((since_view >= 0) & (since_view <= 86400), INTEREST_BOOST).otherwise(1.0)
    days = F.greatest(F.timestamp_diff("DAY", F.col("last_scraped_at"), as_of), F.lit(0))
    pull = F.coalesce(days, F.lit(0)) * GRAVITY_PER_DAY
    gravity = F.when(status.startswith("paid"), F.least(pull, F.lit(PAID_GRAVITY_CAP))).otherwise(pull)
    base = lookup(status, {s: v[0] for s, v in STATUS_SCORES.items()})
    return df.withColumns(
        {"raw_score": base * by_state * by_ratio * by_interest + gravity}
    ).withColumns(
        {
            "priority_score": F.when(
                F.col("raw_score").isNotNull(), F.least(F.greatest(F.col("raw_score"), F.lit(0.0)), F.lit(10.0))
            ),
            "tier": lookup(status, {s: v[1] for s, v in STATUS_SCORES.items()}),
        }
    )


def add_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, ts)


def tier_schedule(df: DataFrame, tier_col: str = "tier", scraped_col: str = "last_scraped_at") -> DataFrame:
    """Add the next scrape time and the latest allowed one."""
    tier, scraped = F.col(tier_col), F.col(scraped_col)
    return df.withColumns(
        {
            "next_scrape_at": add_hours(scraped, lookup(tier, {t: h[0] for t, h in TIER_HOURS.items()})),
            "latest_scrape_at": add_hours(scraped, lookup(tier, {t: h[1] for t, h in TIER_HOURS.items()})),
        }
    )


def parcel_status(parcels: DataFrame, liens: DataFrame, auctions: DataFrame) -> DataFrame:
    """Parcels with a status derived from their liens and auctions.

    Liens (parcel_id, investor_id, active) and auctions (parcel_id) shrink to one row per
    parcel before they are joined.
    """
    held = multi_holder(liens).select("parcel_id", F.col("holders_differ"))
    listed = auctions.select("parcel_id").distinct().withColumn("__listed", F.lit(True))
    joined = parcels.join(held, ["parcel_id"], "left").join(listed, ["parcel_id"], "left")
    owed = F.coalesce(F.col("tax_due") > 0, F.lit(False))
    status = (
        F.when(F.col("__listed"), "auction_scheduled")
        .when(F.col("holders_differ"), "multiple_holders")
        .when(owed, "delinquent")
        .when(F.col("holders_differ").isNotNull(), "paid_active_liens")
        .otherwise("paid_no_liens")
    )
    return joined.withColumn("status", status).select(*parcels.columns, "status")


def due_parcels(scheduled: DataFrame, as_of: Column, n: int) -> DataFrame:
    due = scheduled.where(F.col("next_scrape_at") <= as_of)
    return due.orderBy(F.col("priority_score").desc(), F.col("parcel_id").asc()).limit(n)


def state_matrix(df: DataFrame, state_type_col: str, phase_col: str) -> DataFrame:
    """Add priority and frequency for known pairs of state type and phase."""
    priority, frequency = F, F
    for (state_type, phase), (level, every) in STATE_MATRIX.items():
        hit = (F.col(state_type_col) == state_type) & (F.col(phase_col) == phase)
        priority, frequency = priority.when(hit, level), frequency.when(hit, every)
    none = F.lit(None).cast("string")
    return df.withColumns({"matrix_priority": priority.otherwise(none), "frequency": frequency.otherwise(none)})


def multi_holder(liens: DataFrame) -> DataFrame:
    """Per parcel with active liens: their number, and whether investors differ.

    Two extremes tell whether there is more than one investor; no distinct set is kept.
    """
    return (
        liens.where("active")
        .groupBy("parcel_id")
        .agg(
            F.count("*").alias("active_liens"),
            (F.min("investor_id") != F.max("investor_id")).alias("holders_differ"),
        )
    )


def at_least(tier: Column, floor: str) -> Column:
    """The more urgent of a tier and a floor."""
    order = F.array(*[F.lit(t) for t in TIER_ORDER])
    low = TIER_ORDER.index(floor) + 1
    return F.when(F.array_position(order, tier) > low, tier).otherwise(F.lit(floor))


def multi_holder_boost(parcels: DataFrame, liens: DataFrame, tier_col: str = "tier") -> DataFrame:
    contested = multi_holder(liens).where("holders_differ").select("parcel_id", F.lit(True).alias("__contested"))
    joined = parcels.join(contested, ["parcel_id"], "left")
    raised = F.when(F.col("__contested"), at_least(F.col(tier_col), "HIGH")).otherwise(F.col(tier_col))
    return joined.withColumn(tier_col, raised).select(*parcels.columns)


def event_triggers(parcels: DataFrame, calendar: DataFrame, auction_files: DataFrame, as_of: Column) -> DataFrame:
    """Raise tiers: paid parcels the day after their county's due date, and listed parcels.

    ``calendar`` holds (state, county, due_date), ``auction_files`` (parcel_id, released_at).
    """
    yesterday = F.date_sub(F.to_date(as_of), 1)
    due = (
        calendar.where(F.to_date("due_date") == yesterday)
        .select("state", "county").distinct().withColumn("__due", F.lit(True))
    )
    released = (
        auction_files.where(F.col("released_at") <= as_of)
        .select("parcel_id").distinct().withColumn("__listed", F.lit(True))
    )
    joined = salted_join(parcels, due, ["state", "county"], "left", spread="all").join(released, ["parcel_id"], "left")
    tier = (
        F.when(F.col("__listed"), F.lit("CRITICAL"))
        .when(F.col("__due") & F.col("status").startswith("paid"), at_least(F.col("tier"), "HIGH"))
        .otherwise(F.col("tier"))
    )
    return joined.withColumn("tier", tier).select(*parcels.columns)


def auction_proximity(auction_at: Column, as_of: Column, tau_days: float = 14.0, peak: float = 10.0) -> Column:
    """Score that grows exponentially up to ``peak`` on the auction day; 0 after it."""
    days = F.datediff(auction_at, as_of)
    return F.when(days < 0, F.lit(0.0)).otherwise(F.lit(peak) * F.exp(-days / F.lit(tau_days)))


def risk_tags(
    total_due: Column, lien_count: Column, state: Column, priority: Column
) -> tuple[Column, Column]:
    """Tags of a scraped record, and the task priority they call for."""
    delinquent = F.coalesce(total_due > 0, F.lit(False))
    stacking = F.coalesce(lien_count > 1, F.lit(False))
    boosted = F.coalesce(state == STATE_BOOST[0], F.lit(False))
    tags = F.array_compact(
        F.array(
            F.when(delinquent, F.lit("delinquent")),
            F.when(stacking, F.lit("stacking")),
            F.when(boosted, F.lit(STATE_TAG)),
        )
    )
    raised = F.greatest(
        priority,
        F.when(delinquent | stacking, F.lit(RISK_PRIORITY)),
        F.when(boosted, F.lit(STATE_PRIORITY)),
    )
    return tags, raised


