"""The URL frontier: tasks, discovered links, state, and expansion.

Tasks: id, url, platform, status, priority, created_at, and optional state columns.
Links: source_id, url, relationship_type, priority_delta, added_at, processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.operators.ranking import top_per_group
from parcelweave.operators.upsert import first_write_wins
from parcelweave.session import cut_lineage, heavy_keys, salted_join

MAX_RETRIES = 3


def pull_order() -> list[Column]:
    """Most urgent first, then oldest; the id makes the order total."""
    return [F.col("priority").desc(), F.col("created_at").asc_nulls_first(), F.col("id").asc()]


def task_id(url: Column) -> Column:
    """Id from the URL, so that a retried write produces the same task."""
    return F.sha2(url, 256)


def new_tasks(df: DataFrame, created_at: Column, priority: Column | None = None) -> DataFrame:
    """Pending tasks from rows with ``url`` and ``platform``."""
    return df.select(
        task_id(F.col("url")).alias("id"),
        "url",
        "platform",
        F.lit("pending").alias("status"),
        (F.lit(0) if priority is None else priority).cast("int").alias("priority"),
        created_at.alias("created_at"),
        F.lit(0).alias("retry_count"),
    )


def enqueue(tasks: DataFrame, added: DataFrame) -> DataFrame:
    return tasks.unionByName(added, allowMissingColumns=True)


def next_tasks(tasks: DataFrame, n: int, platform: str | None = None) -> DataFrame:
    pending = tasks.where(F.col("status") == "pending")
    if platform is not None:
        pending = pending.where(F.col("platform") == platform)
    return pending.orderBy(*pull_order()).limit(n)


def next_tasks_per_platform(tasks: DataFrame, n: int) -> DataFrame:
    return top_per_group(tasks.where(F.col("status") == "pending"), ["platform"], pull_order(), n)


def list_tasks(tasks: DataFrame, platform: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Tasks, newest first. The limit is that of a listing a person reads; ``None`` lists all of them."""
    chosen = tasks if platform is None else tasks.where(F.col("platform") == platform)
    ordered = chosen.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").asc())
    return ordered if limit is None else ordered.limit(limit)


def count_by_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def queue_stats(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts. Both tables feed a single aggregate, so nothing is joined."""
    states = tasks.select("status", F.lit(False).alias("open_link"))
    open_links = links.where(~F.col("processed")).select(
        F.lit(None).cast("string").alias("status"), F.lit(True).alias("open_link")
    )
    names = ("pending", "processing", "completed", "failed")
    return states.unionAll(open_links).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in names],
        F.count_if(~F.col("open_link")).alias("total"),
        F.count_if(F.col("open_link")).alias("unprocessed_links"),
    )


def task_state_fold(events: DataFrame, key: str = "id", chunk: str = "1 hour") -> DataFrame:
    """Latest state per task from its event log: (key, ts, seq, type, detail).

    Types are start, complete, fail and retry; others are ignored. A start counts only when
    the task is pending, that is when the event before it is a retry or there is none. All but
    that follows from aggregates that combine before the shuffle; only order, place and type of events
    travel to find what came before a start. Events of a heavy task do so per time chunk first, so
    that its log is spread over tasks; to know heavy tasks, one job runs when this is called.
    """
    known = events.where(F.col("type").isin("start", "complete", "fail", "retry"))
    at, event = F.struct("ts", "seq"), F.struct("ts", "seq", "type")
    starts, is_end = F.col("type") == "start", F.col("type").isin("complete", "fail")

    def latest(kind: str) -> Column:
        return F.max(F.when(F.col("type") == kind, F.struct("ts", "seq", "detail")))["detail"]

    settled = known.groupBy(key).agg(
        F.max(F.when(~starts, event)).alias("set"),
        F.count_if(F.col("type") == "retry").alias("retry_count"),
        F.max(F.when(is_end, F.col("ts"))).alias("completed_at"),
        latest("complete").alias("result_path"),
        latest("fail").alias("error"),
    )

    heavy = heavy_keys(known, [key])
    slot = F.lit(None).cast("timestamp")
    if heavy:
        slot = F.when(F.xxhash64(key).isin(list(heavy)), F.window("ts", chunk)["start"])
    inside = Window.partitionBy(key, "__chunk").orderBy("ts", "seq")
    narrow = known.select(key, "ts", "seq", "type", slot.alias("__chunk"))
    chunks = narrow.withColumn("__prior", F.lag("type").over(inside)).groupBy(key, "__chunk").agg(
        F.min(event).alias("first"),
        F.max(event).alias("last"),
        F.max(F.when(starts & (F.col("__prior") == "retry"), at)).alias("accepted"),
    )
    # The first event of a chunk follows the last one of the chunk before.
    before = F.lag("last.type").over(Window.partitionBy(key).orderBy("__chunk"))
    follows_retry = F.coalesce(before == "retry", F.lit(True))
    first_accepted = F.when(
        (F.col("first.type") == "start") & follows_retry, F.struct(F.col("first.ts"), F.col("first.seq"))
    )
    accepted = chunks.withColumn("first_accepted", first_accepted).groupBy(key).agg(
        F.max(F.greatest("accepted", "first_accepted")).alias("accepted")
    )
    folded = settled.join(accepted.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    set_at = F.struct(F.col("set.ts"), F.col("set.seq"))
    running = F.col("accepted").isNotNull() & (F.col("set").isNull() | (F.col("accepted") > set_at))
    status = (
        F.when(running, "processing")
        .when(F.col("set.type") == "complete", "completed")
        .when(F.col("set.type") == "fail", "failed")
        .otherwise("pending")
    )
    return folded.select(
        key,
        status.alias("status"),
        "retry_count",
        F.col("accepted.ts").alias("started_at"),
        "completed_at",
        "result_path",
        "error",
    )


def retry_decision(tasks: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """State of failing tasks: one more try while tries are left, else failed."""
    tried = F.col("retry_count") + 1
    again = tried <= max_retries
    return tasks.withColumns(
        {"status": F.when(again, "pending").otherwise("failed"), "retry_count": F.when(again, tried).otherwise(F.col("retry_count"))}
    )


def retry_delay(attempt: Column, base: float = 1.0, longest: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before an attempt. ``jitter`` in [0, 1) scales the wait by 75 to 100 %."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(longest))
    return delay if jitter is None else delay * (F.lit(0.75) + jitter * 0.25)


def cancel_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the listed tasks that are still pending."""
    doomed = ids.select("id").distinct().withColumn("status", F.lit("pending"))
    return tasks.join(doomed, ["id", "status"], "left_anti").select(*tasks.columns)


def delete_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("id").distinct(), ["id"], "left_anti")


def add_links(links: DataFrame, added: DataFrame) -> DataFrame:
    return links.unionByName(added, allowMissingColumns=True)


def unprocessed_links(links: DataFrame, n: int | None = None, source_id: object | None = None) -> DataFrame:
    waiting = links.where(~F.col("processed"))
    if source_id is not None:
        waiting = waiting.where(F.col("source_id") == source_id)
    ordered = waiting.orderBy(
        F.col("priority_delta").desc(), F.col("added_at").asc_nulls_first(), F.col("source_id"), F.col("url")
    )
    return ordered if n is None else ordered.limit(n)


def mark_processed(links: DataFrame, done: DataFrame, on: str = "url") -> DataFrame:
    """Flag links listed in ``done``; many links may share one URL."""
    flags = done.select(on).distinct().withColumn("__done", F.lit(True))
    marked = salted_join(links, flags, [on], "left")
    processed = F.col("processed") | F.coalesce(F.col("__done"), F.lit(False))
    return marked.withColumn("processed", processed).select(*links.columns)


def count_unprocessed(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(~F.col("processed")).alias("n"))


def links_by_source(links: DataFrame, source_id: object) -> DataFrame:
    return links.where(F.col("source_id") == source_id)


def delete_by_source(links: DataFrame, sources: DataFrame) -> DataFrame:
    return salted_join(links, sources.select("source_id").distinct(), ["source_id"], "left_anti").select(*links.columns)


def expand_frontier(links: DataFrame, known_urls: DataFrame, created_at: Column, base_priority: int = 0) -> DataFrame:
    """A pending task for each new URL; its first link in (added_at, source_id) order decides.

    Repeats of a URL collapse before the shuffle, then known URLs, queued or done, drop out.
    """
    firsts = first_write_wins(
        links.select("url", "platform", "priority_delta", "added_at", "source_id"),
        ["url"],
        ["added_at", "source_id", "priority_delta", "platform"],
    )
    unseen = firsts.join(known_urls.select("url"), ["url"], "left_anti")
    return new_tasks(unseen, created_at, F.col("priority_delta") + base_priority)


def ripple(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Tasks within ``hops`` links of the seeds: id, hop of first arrival, best summed delta.

    ``edges`` holds (parent_id, child_id, delta), ``seeds`` holds ``id``. Arrivals at one task
    are reduced before the shuffle; each hop is checkpointed. Stops when no task is new.
    """
    reached = seeds.select("id", F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("delta")).distinct()
    visited = frontier = cut_lineage(reached)
    links = edges.select(F.col("parent_id").alias("id"), "child_id", F.col("delta").cast("bigint").alias("step"))
    heavy = heavy_keys(links, ["id"])
    for hop in range(1, hops + 1):
        # A parent may own most edges; the frontier holds one row per task.
        arrivals = salted_join(links, frontier.select("id", "delta"), ["id"], heavy=heavy)
        best = arrivals.groupBy(F.col("child_id").alias("id")).agg(F.max(F.col("delta") + F.col("step")).alias("delta"))
        fresh = best.join(visited.select("id"), ["id"], "left_anti")
        frontier = cut_lineage(fresh.select("id", F.lit(hop).alias("hop"), "delta"))
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
    return visited


def recalculate_priorities(tasks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the summed deltas of each task to its priority."""
    summed = deltas.groupBy("id").agg(F.sum("delta").alias("__delta"))
    joined = tasks.join(summed, ["id"], "left")
    return joined.withColumn("priority", F.col("priority") + F.coalesce("__delta", F.lit(0))).select(*tasks.columns)


def unsynced_results(results: DataFrame, as_of: Column, base: float = 30.0, longest: float = 300.0) -> DataFrame:
    """Results not yet sent whose back-off since the last attempt has passed."""
    wait = retry_delay(F.col("sync_attempts"), base, longest)
    waited = F.timestamp_diff("SECOND", F.col("last_attempt_at"), as_of)
    return results.where(~F.col("synced") & (F.col("last_attempt_at").isNull() | (waited >= wait)))


def mark_synced(results: DataFrame, sent: DataFrame) -> DataFrame:
    flags = sent.select("id").distinct().withColumn("__sent", F.lit(True))
    joined = results.join(flags, ["id"], "left")
    return joined.withColumn("synced", F.col("synced") | F.coalesce("__sent", F.lit(False))).select(*results.columns)


def recover_stale(tasks: DataFrame, as_of: Column, timeout_seconds: int) -> DataFrame:
    """Tasks that have been processing for longer than the timeout become pending again."""
    age = F.timestamp_diff("SECOND", F.col("started_at"), as_of)
    stale = (F.col("status") == "processing") & (age > timeout_seconds)
    return tasks.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def known_urls(*tables: DataFrame) -> DataFrame:
    """Distinct URLs of queued and processed work."""
    urls = [t.select("url") for t in tables]
    union = urls[0]
    for more in urls[1:]:
        union = union.unionAll(more)
    return union.distinct()
