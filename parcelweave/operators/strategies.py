"""Task-selection strategies and their weighted mix.

Tasks: id, url, county, status, priority, last_scraped_at, tags.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.operators.ranking import global_rank, in_ranges
from parcelweave.session import cut_lineage, salted_join

# Tags that mark risky tasks, and the default weights of the mix.
RISK_TAGS = ("delinquent", "stacking", "auction_feb_2026")
DEFAULT_WEIGHTS = {"risk": 0.5, "chronos": 0.3, "ripple": 0.2}
MIN_SHARE = {"chronos": 0.1}


def chronos(tasks: DataFrame, n: int) -> DataFrame:
    """Longest unvisited first, never visited before all."""
    idle = tasks.where(F.col("status") != "processing")
    return idle.orderBy(F.col("last_scraped_at").asc_nulls_first(), F.col("id").asc()).limit(n)


def hotspot(tasks: DataFrame, signals: DataFrame, as_of: Column, n: int | None) -> DataFrame:
    """Tasks in regions with user signals of the last hour, strongest signal first; all, unordered, without ``n``.

    Signals shrink to one row per region before the join, so they never repeat a task.
    """
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), as_of)
    live = (
        signals.where((age >= 0) & (age < 3_600_000_000))
        .groupBy(F.col("region").alias("county"))
        .agg(F.max("signal_strength").alias("signal_strength"))
    )
    hot = salted_join(tasks, live, ["county"], spread="all", unique="id")
    if n is None:
        return hot
    return hot.orderBy(
        F.col("signal_strength").desc(), F.col("last_scraped_at").asc_nulls_first(), F.col("id").asc()
    ).limit(n)


def targeted(tasks: DataFrame, as_of: Column, days: int = 30, path: str = "$.auction_date") -> DataFrame:
    """Tasks whose JSON tags name an auction within the coming days."""
    auction = F.get_json_object("tags", path).try_cast("date")
    ahead = F.datediff(auction, as_of)
    return tasks.withColumn("auction_date", auction).where((ahead >= 0) & (ahead <= days))


def sweeper_next(ids: DataFrame, checked: DataFrame) -> DataFrame:
    """Ids beyond the last one checked in their region (all ids of unchecked regions)."""
    last = checked.groupBy("region").agg(F.max("last_checked_id").alias("__last"))
    joined = salted_join(ids, last, ["region"], "left", spread="all", unique="id")
    return joined.where(F.col("__last").isNull() | (F.col("id") > F.col("__last"))).select(*ids.columns)


def sweeper_gaps(ids: DataFrame) -> DataFrame:
    """Missing id ranges per region: (region, gap_start, gap_end).

    Distinct ids are sorted over all tasks by range, so a region of any size, dense or sparse, spans
    as many tasks as it needs. Gaps between tasks come from one row per region and task. Runs a job
    when called: the ranges are checkpointed.
    """
    placed = in_ranges(ids.select("region", "id").distinct(), ["region"], [F.col("id").asc()])
    inside = Window.partitionBy("region", "__part").orderBy("id")
    within = placed.select("region", "id", F.lead("id").over(inside).alias("__next"))
    edges = placed.groupBy("region", "__part").agg(F.min("id").alias("__low"), F.max("id").alias("id"))
    along = Window.partitionBy("region").orderBy("__part")
    between = edges.select("region", "id", F.lead("__low").over(along).alias("__next"))
    return (
        within.unionAll(between)
        .where(F.col("__next") - F.col("id") > 1)
        .select("region", (F.col("id") + 1).alias("gap_start"), (F.col("__next") - 1).alias("gap_end"))
    )


def seeded(tasks: DataFrame, text_col: str, keywords: DataFrame, keyword_col: str = "keyword") -> DataFrame:
    """Tasks whose text holds a known keyword as a whole word, with the number of keywords hit."""
    words = F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"))
    tokens = tasks.select("id", F.explode(words).alias("__word")).where(F.col("__word") != "")
    known = keywords.select(F.lower(keyword_col).alias("__word")).distinct()
    return salted_join(tokens, known, ["__word"], spread="all").groupBy("id").agg(F.count("*").alias("hits"))


def risk(tasks: DataFrame, n: int, tags_col: str = "tags") -> DataFrame:
    """Tasks with a risk tag first, each part by priority; the rest is the fallback."""
    tagged = F.coalesce(
        F.arrays_overlap(F.col(tags_col), F.array(*[F.lit(t) for t in RISK_TAGS])), F.lit(False)
    )
    return tasks.orderBy(tagged.desc(), F.col("priority").desc(), F.col("id").asc()).limit(n)


def quotas(weights: Mapping[str, float], limit: int, min_share: Mapping[str, float] | None = None) -> dict[str, int]:
    """Whole picks per strategy that add up to ``limit``, by largest remainder.

    A guaranteed share is rounded up and granted first; the rest follows the weights.
    """
    floor = {s: math.ceil(share * limit - 1e-9) for s, share in (min_share or {}).items() if s in weights}
    total = sum(weights.values())
    shares = {s: w / total * limit for s, w in weights.items()}
    granted = {s: floor[s] for s in floor if shares[s] < floor[s]}
    if granted:
        open_weights = {s: w for s, w in weights.items() if s not in granted}
        rest = limit - sum(granted.values())
        total = sum(open_weights.values()) or 1.0
        shares = {s: (granted[s] if s in granted else weights[s] / total * rest) for s in weights}
    picks = {s: math.floor(v + 1e-9) for s, v in shares.items()}
    by_remainder = sorted(shares, key=lambda s: (picks[s] - shares[s], list(weights).index(s)))
    for s in by_remainder[: limit - sum(picks.values())]:
        picks[s] += 1
    return picks


#: Rows looked at for each URL wanted, one after the other until there are URLs enough.
WIDENINGS = (2, 16, 128)
#: So many rows of a top-k may pass through the driver.
AT_HAND = 5000


def best_urls(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The ``limit`` best distinct URLs of a list, each by its best row: (id, url, __pos).

    A top-k of twice as many rows as URLs are wanted, widened while URLs repeat in it; the table is not shuffled for
    that. Only where a few URLs hold all of the best rows are all rows reduced to one a URL, by shuffle. Ties go
    to the smaller id. Runs a job of ``limit`` narrow rows a try when called.
    """
    by = [*order, F.col("id").asc()]
    place = F.row_number().over(Window.orderBy(*by)).alias("__pos")
    own = Window.partitionBy("url")
    for wide in WIDENINGS:
        top = rows.orderBy(*by).limit(wide * limit).select("id", "url", place)
        # A few thousand ids and URLs are kept at hand, more are written down.
        top = rows.sparkSession.createDataFrame(top.toArrow()) if wide * limit <= AT_HAND else cut_lineage(top)
        seen = top.agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls")).first()
        if seen["urls"] >= limit or seen["rows"] < wide * limit:
            single = top.withColumn("__own", F.row_number().over(own.orderBy("__pos"))).where("__own = 1").drop("__own")
            return single.orderBy("__pos").limit(limit)
    single = rows.withColumn("__own", F.row_number().over(own.orderBy(*by))).where("__own = 1")
    return single.orderBy(*by).limit(limit).select("id", "url", place)


def strategy_mix(
    candidates: Mapping[str, tuple[DataFrame, Sequence[Column]]],
    limit: int,
    weights: Mapping[str, float] | None = None,
    min_share: Mapping[str, float] | None = None,
    forced: Sequence[str] = (),
) -> DataFrame:
    """``limit`` picks as long as there are as many URLs: (id, url, strategy).

    Candidates give (rows with id and url, order). Strategies take turns in the given order: each
    takes its best URLs that none before it took, up to its quota. Slots left over go to the best
    URLs that nobody took, again in the order of strategies. ``forced`` names starved strategies (see
    ``starvation_check``): each gets one slot at least. Of the rows of a URL in a list the best one
    counts. Every list is a distributed top-k of ``limit`` URLs (``best_urls``, whose jobs run when this is called), so
    what follows works on ``limit`` rows per strategy.
    """
    least = {**(MIN_SHARE if min_share is None else min_share)}
    for name in forced:
        least[name] = max(least.get(name, 0.0), 1 / limit)
    share = quotas(weights or DEFAULT_WEIGHTS, limit, least)
    lists = None
    for rank, (_, (rows, order)) in enumerate(candidates.items()):
        best = best_urls(rows, order, limit).select("id", "url", F.lit(rank).alias("__rank"), "__pos")
        lists = best if lists is None else lists.unionAll(best)
    state = lists.withColumns({"__picked": F.lit(False), "__taken": F.lit(False)})
    turn = Window.partitionBy("__rank").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    for rank, name in enumerate(candidates):
        free = (F.col("__rank") == rank) & ~F.col("__taken")
        so_far = F.sum(F.when(free, 1).otherwise(0)).over(turn)
        state = state.withColumn("__picked", F.col("__picked") | (free & (so_far <= share.get(name, 0))))
        state = state.withColumn("__taken", F.max("__picked").over(Window.partitionBy("url")))
    first = Window.partitionBy("url").orderBy("__rank", "__pos")
    rest = ~F.col("__taken") & (F.row_number().over(first) == 1)
    names = F.array(*[F.lit(n) for n in candidates])
    return (
        state.withColumn("__rest", rest)
        .where("__picked or __rest")
        .orderBy(F.col("__picked").desc(), "__rank", "__pos")
        .limit(limit)
        .select("id", "url", names[F.col("__rank")].alias("strategy"))
    )


def starvation_check(picks: DataFrame, cycles: int = 10) -> DataFrame:
    """Cycles whose strategy was picked nothing in it and the ``cycles`` - 1 before it.

    ``picks`` holds (strategy, cycle, picks) for every cycle run. Each row adds to the windows
    it lies in, so the sums combine before the shuffle.
    """
    per_cycle = picks.groupBy("strategy", "cycle").agg(F.sum("picks").alias("picks"))
    spread = per_cycle.select(
        "strategy",
        F.explode(F.sequence(F.col("cycle"), F.col("cycle") + cycles - 1)).alias("__until"),
        "cycle",
        "picks",
    )
    summed = spread.groupBy("strategy", F.col("__until").alias("cycle")).agg(
        F.sum("picks").alias("recent_picks"),
        F.count("*").alias("cycles_seen"),
        F.max("cycle").alias("__last"),
    )
    return summed.where(F.col("__last") == F.col("cycle")).select(
        "strategy",
        "cycle",
        "recent_picks",
        ((F.col("recent_picks") == 0) & (F.col("cycles_seen") == cycles)).alias("forced"),
    )


def rate_slots(
    tasks: DataFrame,
    order: Sequence[Column],
    per_minute: int,
    start: Column,
    key: str = "platform",
    id_col: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Planned start of each task when every platform takes ``per_minute`` tasks a minute.

    Ranking checkpoints the rows it ranks. For wide tasks give ``id_col`` and the columns that ``order``
    reads as ``by``: then those alone are ranked, and the rest is joined back by id.
    """
    narrow = tasks if id_col is None else tasks.select(*dict.fromkeys([id_col, key, *by]))
    ranked = global_rank(narrow, [key], order, "__rn")
    if id_col is not None:
        ranked = tasks.join(ranked.select(F.col(id_col).alias("__id"), "__rn"), F.col(id_col) == F.col("__id"))
    slot = F.floor((F.col("__rn") - 1) / per_minute)
    return ranked.select(
        *tasks.columns, slot.alias("slot"), F.timestamp_add("MINUTE", slot, start).alias("planned_at")
    )
