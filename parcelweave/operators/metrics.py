"""Operational metrics over a telemetry table.

Telemetry: ts, type (started, succeeded, failed, ...), worker, runtime, task_type, platform.
Every report is an aggregate that combines before the shuffle. Series that need an order are
first reduced to one row per minute, so their length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.operators.ranking import cell_sketch, exact_quantiles, rolled_up_quantile
from parcelweave.session import cut_lineage, salted_join

# Upper bounds of the runtime histogram in seconds.
RUNTIME_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
# Queue levels with their longest wait in seconds.
LEVELS = {1: ("urgent", 30), 2: ("high", 300), 3: ("normal", 3600), 4: ("low", 86400)}
# Alert limits of the urgent queue depth and of the platform success rate.
DEPTH_LIMITS = (100, 500)
SUCCESS_LIMITS = (0.9, 0.7)
# Report ranges in seconds.
RANGES = {"1h": 3600, "24h": 86400, "7d": 7 * 86400}


def _count(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def success_rate(succeeded: Column, failed: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(succeeded, succeeded + failed), digits)


def event_counts(events: DataFrame) -> DataFrame:
    return events.agg(_count("succeeded").alias("succeeded"), _count("failed").alias("failed"))


def tasks_running(events: DataFrame) -> DataFrame:
    running = _count("started") - _count("succeeded") - _count("failed")
    return events.agg(running.alias("running"))


def level_change() -> Column:
    return F.when(F.col("type") == "started", 1).when(F.col("type").isin("succeeded", "failed"), -1).otherwise(0)


def running_level(events: DataFrame) -> DataFrame:
    """Tasks running at the end of every minute that saw a change.

    Two prefix sums, over the minutes of a day and over the days: at most 1,440 rows per day
    and one row per day, whatever the number of events.
    """
    minutes = (
        events.where(F.col("type").isin("started", "succeeded", "failed"))
        .groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.sum(level_change()).alias("change"))
    )
    dated = minutes.withColumn("__day", F.to_date("minute"))
    days = dated.groupBy("__day").agg(F.sum("change").alias("__total"))
    earlier = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select("__day", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__opening"))
    within = Window.partitionBy("__day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return dated.join(opening, ["__day"]).select(
        "minute", "change", (F.col("__opening") + F.sum("change").over(within)).alias("level")
    )


def online_workers(events: DataFrame, as_of: Column, timeout_seconds: int, offline_types: Sequence[str] = ()) -> DataFrame:
    """Number of workers heard of within the timeout whose last event is not an offline one."""
    latest = events.where(F.col("ts") <= as_of).groupBy("worker").agg(
        F.max("ts").alias("last_seen"), F.max_by("type", F.struct("ts", "type")).alias("last_type")
    )
    silent = F.timestamp_diff("SECOND", F.col("last_seen"), as_of) > timeout_seconds
    online = ~silent & ~F.col("last_type").isin(*offline_types) if offline_types else ~silent
    return latest.agg(F.count_if(online).alias("online"), F.count("*").alias("known"))


def windowed_success_rate(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    done = events.where(F.col("type").isin("succeeded", "failed"))
    counted = done.groupBy(F.window("ts", size)).agg(
        _count("succeeded").alias("succeeded"), _count("failed").alias("failed")
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "succeeded", "failed",
        success_rate(F.col("succeeded"), F.col("failed")).alias("success_rate"),
    )


def runtime_quantiles(events: DataFrame, size: str = "5 minutes", approximate: bool = False) -> DataFrame:
    """p50, p95 and p99 of the runtime per window; exact, or from a mergeable sketch."""
    timed = events.where(F.col("runtime").isNotNull()).select(F.window("ts", size)["start"].alias("window_start"), "runtime")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approximate:
        sketch = F.percentile_approx("runtime", F.array(*[F.lit(q) for q in wanted.values()]), 10_000)
        found = timed.groupBy("window_start").agg(sketch.alias("__q"))
        return found.select("window_start", *[F.col("__q")[i].alias(n) for i, n in enumerate(wanted)])
    return exact_quantiles(timed, ["window_start"], "runtime", wanted)


def runtime_histogram(events: DataFrame, keys: Sequence[str] = (), bounds: Sequence[float] = RUNTIME_BOUNDS) -> DataFrame:
    """Cumulative bucket counts (``le`` as text, ``+Inf`` last), with sum and count."""
    value = F.col("runtime")
    counted = events.where(value.isNotNull()).groupBy(*keys).agg(
        *[F.count_if(value <= b).alias(f"__{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("count"),
        F.round(F.sum(value), 4).alias("sum"),
    )
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n"))]
    return counted.select(*keys, F.explode(F.array(*buckets)).alias("b"), "sum", "count").select(
        *keys, "b.le", F.col("b.n").alias("n"), "sum", "count"
    )


def histogram_quantile(q: float, counts: Sequence[Column], bounds: Sequence[float]) -> Column:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    ``counts`` are cumulative, one per bound and a last one for all values. A rank above the
    last bound gives that bound.
    """
    total = counts[-1]
    rank = total * F.lit(q)
    chain = F.when(total == 0, F.lit(None).cast("double"))
    for i, bound in enumerate(bounds):
        low = bounds[i - 1] if i else 0.0
        below = counts[i - 1] if i else F.lit(0)
        share = F.try_divide(rank - below, counts[i] - below)
        chain = chain.when(counts[i] >= rank, F.lit(float(low)) + F.lit(float(bound - low)) * share)
    return chain.otherwise(F.lit(float(bounds[-1])))


def histogram_quantiles(
    events: DataFrame, size: str = "5 minutes", bounds: Sequence[float] = RUNTIME_BOUNDS
) -> DataFrame:
    """p50, p95 and p99 per window as a dashboard reads them from runtime buckets."""
    value = F.col("runtime")
    counted = events.where(value.isNotNull()).groupBy(F.window("ts", size)).agg(
        *[F.count_if(value <= b).alias(f"__{i}") for i, b in enumerate(bounds)], F.count("*").alias("n")
    )
    counts = [F.col(f"__{i}") for i in range(len(bounds))] + [F.col("n")]
    return counted.select(
        F.col("window.start").alias("window_start"), "n",
        *[histogram_quantile(q, counts, bounds).alias(f"p{q * 100:g}") for q in (0.5, 0.95, 0.99)],
    )


def throughput(events: DataFrame, size: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Events per second by kind over sliding windows.

    Minutes are counted first: a sliding window repeats counted minutes, not events.
    """
    kinds = ("started", "succeeded", "failed")
    minutes = (
        events.where(F.col("type").isin(*kinds))
        .groupBy(F.window("ts", slide).alias("slot"))
        .agg(*[_count(k).alias(k) for k in kinds])
    )
    # A slot counts in every window that contains its start.
    spread = minutes.withColumn("at", F.col("slot.start")).groupBy(F.window("at", size, slide))
    summed = spread.agg(*[F.sum(k).alias(k) for k in kinds])
    return summed.select(
        F.col("window.start").alias("window_start"), *[F.round(F.col(k) / seconds, 6).alias(f"{k}_rate") for k in kinds]
    )


def tasks_per_worker(events: DataFrame, kind: str = "started") -> DataFrame:
    return events.where(F.col("type") == kind).groupBy("worker").agg(F.count("*").alias("tasks"))


def _in_slots(events: DataFrame, as_of: Column) -> DataFrame:
    """Events of the longest range, each with the number of the shortest range that holds it."""
    age = F.timestamp_diff("SECOND", F.col("ts"), as_of)
    slot = F.coalesce(*[F.when((age >= 0) & (age < s), F.lit(i)) for i, s in enumerate(RANGES.values())])
    longest = max(RANGES.values())
    recent = events.where((F.col("ts") <= as_of) & (F.col("ts") > F.timestamp_add("SECOND", F.lit(-longest), as_of)))
    return recent.withColumn("slot", slot).where(F.col("slot").isNotNull())


def range_stats(events: DataFrame, as_of: Column) -> DataFrame:
    """Totals, success rate and runtime figures per range, by task type and platform.

    ``grouping`` tells subtotals from unknown values: 0 by type and platform, 1 by type, 2 by platform, 3 for
    the whole range. A dimension that is summed over is null. Runs jobs when called: events are read once for
    sums and sketches per type, platform and shortest range, which every figure but the median follows from, and
    once more for counts around the medians. No event is copied for ranges or subtotals.
    """
    cells = ["slot", "task_type", "platform"]
    dims = ["range", "grouping", "task_type", "platform"]
    names = F.array(*[F.lit(n) for n in RANGES])

    def kind(number: int) -> Column:
        by_type, by_platform = number in (0, 1), number in (0, 2)
        return F.struct(
            F.lit(number).alias("g"),
            (F.col("task_type") if by_type else F.lit(None).cast("string")).alias("t"),
            (F.col("platform") if by_platform else F.lit(None).cast("string")).alias("p"),
        )

    all_kinds = F.array(*[kind(number) for number in range(4)])

    def every_kind(rows: DataFrame) -> DataFrame:
        """Cells in every range that holds their events, ranges being nested, and every grouping."""
        rest = [c for c in rows.columns if c not in cells]
        ranged = rows.withColumn("range", F.explode(F.slice(names, F.col("slot") + 1, len(RANGES))))
        exploded = ranged.select("range", F.explode(all_kinds).alias("k"), *rest)
        parts = {"k.g": "grouping", "k.t": "task_type", "k.p": "platform"}
        return exploded.select("range", *[F.col(c).alias(part) for c, part in parts.items()], *rest)

    slotted = _in_slots(events, as_of)
    done = F.col("type").isin("succeeded", "failed")
    timed = F.when(done, F.col("runtime"))
    finest = cut_lineage(
        slotted.groupBy(*cells).agg(
            F.count_if(done).alias("total"),
            _count("succeeded").alias("succeeded"),
            _count("failed").alias("failed"),
            F.sum(timed).alias("runtime"),
            F.count(timed).alias("timed"),
            F.min(timed).alias("min_runtime"),
            F.max(timed).alias("max_runtime"),
            *cell_sketch(timed),
        )
    )
    sums, ends = ["total", "succeeded", "failed", "runtime", "timed"], ["min_runtime", "max_runtime"]
    stats = every_kind(finest.select(*cells, *sums, *ends)).groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("min_runtime").alias("min_runtime"),
        F.max("max_runtime").alias("max_runtime"),
    )
    stats = stats.withColumn("avg_runtime", F.round(F.try_divide("runtime", "timed"), 4))
    sketched = finest.select(*cells, "__sketch", "__n", "__min", "__max")
    medians = rolled_up_quantile(slotted.where(done), cells, sketched, dims, every_kind, "runtime", 0.5, "median_runtime")
    joined = salted_join(stats, medians, dims, "left", null_safe=True, heavy=[])
    return joined.select(
        *dims, "total", "succeeded", "failed", success_rate(F.col("succeeded"), F.col("failed")).alias("success_rate"),
        "avg_runtime", F.round("median_runtime", 4).alias("median_runtime"), "min_runtime", "max_runtime",
    )


def alert_level(value: Column, warning: float, critical: float, low_is_bad: bool = False) -> Column:
    if low_is_bad:
        return F.when(value < critical, "critical").when(value < warning, "warning").otherwise("ok")
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("ok")


def platform_health(events: DataFrame) -> DataFrame:
    counted = events.groupBy("platform").agg(
        _count("succeeded").alias("succeeded"),
        _count("failed").alias("failed"),
        F.max(F.when(F.col("type") == "succeeded", F.col("ts"))).alias("last_ok_at"),
    )
    rate = success_rate(F.col("succeeded"), F.col("failed"))
    return counted.withColumn("success_rate", rate).withColumn(
        "alert", alert_level(F.col("success_rate"), *SUCCESS_LIMITS, low_is_bad=True)
    )


def queue_depth(tasks: DataFrame) -> DataFrame:
    """Waiting tasks per level and platform with subtotals; the urgent total carries the alert.

    ``grouping`` tells subtotals from unknown values: 0 by level and platform, 1 by level, 3 for the whole queue.
    """
    waiting = tasks.where(F.col("status") == "pending").select("level", "platform")
    depth = waiting.rollup("level", "platform").agg(F.count("*").alias("depth"), F.grouping_id().cast("int").alias("grouping"))
    urgent = (F.col("level") == 1) & (F.col("grouping") == 1)
    alert = F.when(urgent, alert_level(F.col("depth"), *DEPTH_LIMITS)).otherwise("ok")
    return depth.select("grouping", "level", "platform", "depth", alert.alias("alert"))


def wait_limit(level: Column) -> Column:
    chain = F
    for number, (_, seconds) in LEVELS.items():
        chain = chain.when(level == number, seconds)
    return chain.otherwise(F.lit(None).cast("int"))


def sla_breaches(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Waiting tasks over the limit of their level, with the time they have waited."""
    waited = F.timestamp_diff("SECOND", F.col("created_at"), as_of)
    pending = tasks.where(F.col("status") == "pending").withColumn("waited_seconds", waited)
    return pending.where(F.col("waited_seconds") > wait_limit(F.col("level")))


def sustained_alert(samples: DataFrame, limit: float, minutes: int = 5) -> DataFrame:
    """Samples (minute, level) with the lowest level over the minutes up to them.

    Each sample is added to the windows it lies in; no series is ordered in one task.
    """
    ahead = F.sequence(F.lit(0), F.lit(minutes))
    spread = samples.select(
        F.explode(F.transform(ahead, lambda m: F.timestamp_add("MINUTE", m, F.col("minute")))).alias("__at"),
        "minute",
        "level",
    )
    lowest = spread.groupBy(F.col("__at").alias("minute")).agg(
        F.min("level").alias("lowest"), F.max("minute").alias("__own"), F.max_by("level", "minute").alias("level")
    )
    return lowest.where(F.col("__own") == F.col("minute")).select(
        "minute", "level", "lowest", (F.col("lowest") > limit).alias("alert")
    )


def coverage_matrix(registry: DataFrame, data_types: Sequence[str]) -> DataFrame:
    """Per platform: distinct counties, and records per data type.

    ``registry`` holds (platform, county, data_type) rows.
    """
    per_county = registry.groupBy("platform", "county").agg(
        *[F.count_if(F.col("data_type") == t).alias(t) for t in data_types]
    )
    return per_county.groupBy("platform").agg(
        F.count("county").alias("counties"), *[F.sum(t).alias(t) for t in data_types]
    )


def parse_duration_stats(parses: DataFrame, keys: Sequence[str] = ("platform", "parser_version")) -> DataFrame:
    stats = parses.groupBy(*keys).agg(
        F.count("*").alias("parses"),
        F.round(F.avg("parse_duration_ms"), 4).alias("avg_ms"),
        F.max("parse_duration_ms").alias("max_ms"),
    )
    tails = exact_quantiles(parses, list(keys), "parse_duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    joined = salted_join(stats, tails, list(keys), "left", null_safe=True, heavy=[])
    return joined.select(
        *keys, "parses", "avg_ms", "max_ms", F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms")
    )


def chain_progress(tasks: DataFrame, root: str = "root_id") -> DataFrame:
    """Tasks of a chain by state, and the share that has ended."""
    states = ("pending", "processing", "completed", "failed")
    counted = tasks.groupBy(root).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states]
    )
    ended = F.col("completed") + F.col("failed")
    return counted.withColumn("progress_percent", F.round(ended * 100.0 / F.col("total"), 2))


