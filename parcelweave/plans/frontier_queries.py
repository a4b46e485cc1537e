"""Driver queries over the frontier and its selection strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.operators import frontier as R
from parcelweave.operators import lifecycle as L
from parcelweave.operators import strategies as S
from parcelweave.plans.registry import query
from parcelweave.plans.tables import (
    EDGES_SQL,
    LINKS_SQL,
    LOG_SQL,
    MICRO,
    BARE_TASKS_SQL,
    REGION_OF_EVENT,
    TASKS_SQL,
    as_ts,
    bare_tasks,
    by_value,
    edges,
    event_log,
    event_number,
    links,
    load,
    tasks,
    text,
    with_platform,
)
from parcelweave.session import spread_small

_PULL = "ORDER BY priority DESC, created_at ASC, id ASC"


@query(f"WITH {TASKS_SQL} SELECT id, url, platform, CAST(priority AS INT) AS priority FROM tasks WHERE status = 'pending' {_PULL} LIMIT 100")
def next_tasks(spark: SparkSession, sf: str) -> DataFrame:
    # The pick is a top-k over one scan; only its rows are given a platform.
    picked = R.next_tasks(bare_tasks(spark, sf), 100)
    return with_platform(spark, sf, picked).select("id", "url", "platform", "priority")


@query(
    f"""WITH {TASKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY platform {_PULL}) AS rn FROM tasks WHERE status = 'pending')
SELECT id, platform, CAST(priority AS INT) AS priority FROM r WHERE rn <= 5"""
)
def next_tasks_per_platform(spark: SparkSession, sf: str) -> DataFrame:
    return R.next_tasks_per_platform(tasks(spark, sf), 5).select("id", "platform", "priority")


@query(
    f"""WITH {TASKS_SQL} SELECT id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM tasks
WHERE platform = 'NATION_5' ORDER BY tasks.created_at DESC, id LIMIT 1000"""
)
def task_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = R.list_tasks(tasks(spark, sf), "NATION_5")
    return listed.select("id", "status", text("created_at").alias("created_at"))


@query(f"WITH {BARE_TASKS_SQL} SELECT id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM tasks")
def task_list_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.list_tasks(bare_tasks(spark, sf), limit=None).select("id", "status", text("created_at").alias("created_at"))


@query(f"WITH {BARE_TASKS_SQL} SELECT status, CAST(count(*) AS BIGINT) AS n FROM tasks GROUP BY 1")
def count_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.count_by_status(bare_tasks(spark, sf))


@query(
    f"""WITH {BARE_TASKS_SQL}, {LINKS_SQL} SELECT CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending,
  CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS processing,
  CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total,
  (SELECT CAST(count(*) AS BIGINT) FROM links WHERE NOT processed) AS unprocessed_links FROM tasks"""
)
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.queue_stats(bare_tasks(spark, sf), links(spark, sf))


@query(
    f"""WITH {LOG_SQL},
seqd AS (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY ts, seq) AS prior FROM log),
f AS (SELECT id, arg_max(type, seq) FILTER (WHERE type <> 'start') AS set_type,
  max(seq) FILTER (WHERE type <> 'start') AS set_seq,
  max(seq) FILTER (WHERE type = 'start' AND (prior IS NULL OR prior = 'retry')) AS run_seq,
  max(ts) FILTER (WHERE type = 'start' AND (prior IS NULL OR prior = 'retry')) AS run_ts,
  count(*) FILTER (WHERE type = 'retry') AS retries, max(ts) FILTER (WHERE type IN ('complete', 'fail')) AS done_ts,
  arg_max(detail, seq) FILTER (WHERE type = 'complete') AS result_path,
  arg_max(detail, seq) FILTER (WHERE type = 'fail') AS error FROM seqd GROUP BY id)
SELECT id, CASE WHEN run_seq IS NOT NULL AND (set_seq IS NULL OR run_seq > set_seq) THEN 'processing'
    WHEN set_type = 'complete' THEN 'completed' WHEN set_type = 'fail' THEN 'failed' ELSE 'pending' END AS status,
  CAST(retries AS BIGINT) AS retry_count, strftime(run_ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(done_ts, '%Y-%m-%d %H:%M:%S.%f') AS completed_at, result_path, error
FROM f"""
)
def task_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    state = R.task_state_fold(event_log(load(spark, sf, "events")))
    return state.withColumns({"started_at": text("started_at", MICRO), "completed_at": text("completed_at", MICRO)})


@query(
    """WITH f AS (SELECT user_id AS id, count(*) AS fails FROM events WHERE event_type = 'error' GROUP BY 1),
t AS (SELECT id, (fails - 1) % 4 AS tried FROM f)
SELECT id, CASE WHEN tried + 1 <= 3 THEN 'pending' ELSE 'failed' END AS status,
  CAST(CASE WHEN tried + 1 <= 3 THEN tried + 1 ELSE tried END AS BIGINT) AS retry_count,
  least(2.0 * power(2, tried), 10.0) AS wait_seconds FROM t"""
)
def retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    failing = load(spark, sf, "events").where(F.col("event_type") == "error").groupBy(F.col("user_id").alias("id"))
    tried = failing.agg(((F.count("*") - 1) % 4).alias("retry_count"))
    waits = tried.withColumn("wait_seconds", R.retry_delay(F.col("retry_count"), 2.0, 10.0))
    return R.retry_decision(waits).select("id", "status", "retry_count", "wait_seconds")


@query(
    """WITH r AS (SELECT event_id AS id, event_type = 'purchase' AS synced, CAST(json_extract_string(props, '$.k') AS INT) // 20 AS n,
  CASE WHEN event_type <> 'signup' THEN ts END AS tried FROM events)
SELECT id, CAST(n AS INT) AS sync_attempts FROM r WHERE NOT synced AND (tried IS NULL OR
  date_sub('second', tried, TIMESTAMP '2024-01-30 23:59:00') >= least(30 * power(2, n), 300))"""
)
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    results = load(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("synced"),
        F.floor(event_number() / 20).cast("int").alias("sync_attempts"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("last_attempt_at"),
    )
    return R.unsynced_results(results, as_ts("2024-01-30 23:59:00")).select("id", "sync_attempts")


@query(
    """SELECT event_id AS id, event_type IN ('purchase', 'view') AS synced FROM events"""
)
def synced_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results after those that were sent are marked; one is sent twice."""
    events = load(spark, sf, "events")
    results = events.select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("synced"))
    sent = events.where("event_type = 'view'").select(F.col("event_id").alias("id"))
    return R.mark_synced(results, sent.unionAll(sent))


@query(
    f"""WITH {LINKS_SQL} SELECT source_id, CAST(count(*) AS BIGINT) AS links, CAST(sum(CASE WHEN added THEN 1 ELSE 0 END) AS BIGINT) AS added
FROM (SELECT source_id, false AS added FROM links UNION ALL
  SELECT o_orderkey, true FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"""
)
def added_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links found later, without a time yet, beside the known ones."""
    found = load(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("source_id"),
        F.concat(F.lit("https://records.example.com/new/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.lit(False).alias("processed"),
    )
    every = R.add_links(links(spark, sf), found)
    return every.groupBy("source_id").agg(
        F.count("*").alias("links"), F.count_if(F.col("url").contains("/new/")).alias("added")
    )


@query(
    f"""WITH {LINKS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY added_at, source_id, priority_delta, platform) AS rn
  FROM links)
SELECT sha256(url) AS id, url, platform, 'pending' AS status, CAST(priority_delta AS INT) AS priority FROM f
WHERE rn = 1 AND url NOT IN (SELECT 'https://records.example.com/part/' || p_partkey FROM part WHERE p_size > 25)"""
)
def frontier_expand(spark: SparkSession, sf: str) -> DataFrame:
    known = load(spark, sf, "part").where("p_size > 25").select(
        F.concat(F.lit("https://records.example.com/part/"), F.col("p_partkey").cast("string")).alias("url")
    )
    added = R.expand_frontier(links(spark, sf), R.known_urls(known), as_ts("2024-02-01"))
    return added.select("id", "url", "platform", "status", "priority")


@query(
    f"""WITH {LINKS_SQL} SELECT source_id, url, CAST(priority_delta AS INT) AS priority_delta,
  strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at FROM links WHERE NOT processed
ORDER BY links.priority_delta DESC, links.added_at ASC, source_id, url LIMIT 500"""
)
def unprocessed_links(spark: SparkSession, sf: str) -> DataFrame:
    waiting = R.unprocessed_links(links(spark, sf), 500)
    return waiting.select("source_id", "url", "priority_delta", text("added_at").alias("added_at"))


@query(
    f"""WITH {LINKS_SQL} SELECT source_id, CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE NOT processed AND
  url NOT IN (SELECT 'https://records.example.com/part/' || p_partkey FROM part WHERE p_type = 'SMALL')) AS BIGINT) AS waiting
FROM links WHERE source_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"""
)
def marked_links(spark: SparkSession, sf: str) -> DataFrame:
    done = load(spark, sf, "part").where(F.col("p_type") == "SMALL").select(
        F.concat(F.lit("https://records.example.com/part/"), F.col("p_partkey").cast("string")).alias("url")
    )
    closed = load(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("source_id"))
    open_links = R.delete_by_source(links(spark, sf), closed)
    return R.mark_processed(open_links, done).groupBy("source_id").agg(
        F.count("*").alias("links"), F.count_if(~F.col("processed")).alias("waiting")
    )


@query(
    f"""WITH {BARE_TASKS_SQL} SELECT id, status FROM tasks WHERE NOT (status = 'pending' AND id IN (SELECT l_partkey FROM lineitem
  WHERE l_returnflag = 'R'))"""
)
def cancel_tasks(spark: SparkSession, sf: str) -> DataFrame:
    doomed = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return R.cancel_tasks(bare_tasks(spark, sf), doomed).select("id", "status")


@query(
    f"""WITH {BARE_TASKS_SQL} SELECT id, CASE WHEN status = 'processing' AND
  date_sub('second', created_at, TIMESTAMP '2001-01-01') > 31536000 THEN 'pending' ELSE status END AS status FROM tasks"""
)
def recover_stale(spark: SparkSession, sf: str) -> DataFrame:
    held = bare_tasks(spark, sf).withColumn("started_at", F.col("created_at"))
    return R.recover_stale(held, as_ts("2001-01-01"), 365 * 86400).select("id", "status")


@query(
    f"""WITH {EDGES_SQL}, seeds AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 450000),
one AS (SELECT child_id AS id, max(delta) AS delta FROM edges WHERE parent_id IN (SELECT id FROM seeds)
  AND child_id NOT IN (SELECT id FROM seeds) GROUP BY 1),
two AS (SELECT e.child_id AS id, max(o.delta + e.delta) AS delta FROM edges e JOIN one o ON o.id = e.parent_id
  WHERE e.child_id NOT IN (SELECT id FROM seeds) AND e.child_id NOT IN (SELECT id FROM one) GROUP BY 1)
SELECT id, CAST(0 AS INT) AS hop, CAST(0 AS BIGINT) AS delta FROM seeds
UNION ALL SELECT id, CAST(1 AS INT), CAST(delta AS BIGINT) FROM one UNION ALL SELECT id, CAST(2 AS INT), CAST(delta AS BIGINT) FROM two"""
)
def ripple_2hop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = load(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("id"))
    return R.ripple(edges(spark, sf), seeds, 2)


@query(
    f"""WITH {BARE_TASKS_SQL}, {EDGES_SQL}, d AS (SELECT child_id AS id, sum(delta) AS delta FROM edges GROUP BY 1)
SELECT t.id, CAST(t.priority + coalesce(d.delta, 0) AS BIGINT) AS priority FROM tasks t LEFT JOIN d USING (id)"""
)
def recalculate_priorities(spark: SparkSession, sf: str) -> DataFrame:
    deltas = edges(spark, sf).select(F.col("child_id").alias("id"), "delta")
    return R.recalculate_priorities(bare_tasks(spark, sf), deltas).select("id", "priority")


@query(
    f"""WITH {TASKS_SQL}, new AS (SELECT url, max(page_id % 5) AS p FROM pages GROUP BY 1)
SELECT url, status, CAST(priority AS INT) AS priority FROM tasks
  WHERE NOT (status = 'pending' AND id IN (SELECT c_custkey FROM customer))
UNION ALL SELECT url, 'pending', CAST(p AS INT) FROM new"""
)
def inbound_events(spark: SparkSession, sf: str) -> DataFrame:
    own = tasks(spark, sf)
    keyed = own.withColumns({"id": F.col("id").cast("string"), "retry_count": F.lit(0)})
    nothing = F.lit(None).cast("string")
    creates = load(spark, sf, "pages").select(
        F.lit("task.create").alias("event"), nothing.alias("task_id"), "url", nothing.alias("platform"),
        (F.col("page_id") % 5).cast("int").alias("priority"),
    )
    cancels = load(spark, sf, "customer").select(
        F.lit("task.cancel"), F.col("c_custkey").cast("string"), nothing, nothing, F.lit(None).cast("int")
    )
    after = L.apply_inbound_events(keyed, creates.unionAll(cancels), as_ts("2024-02-01"), "web")
    return after.select("url", "status", "priority")


# --- strategies ---------------------------------------------------------------------------


@query(f"WITH {BARE_TASKS_SQL} SELECT id FROM tasks WHERE status <> 'processing' ORDER BY last_scraped_at ASC NULLS FIRST, id LIMIT 2000")
def chronos(spark: SparkSession, sf: str) -> DataFrame:
    return S.chronos(bare_tasks(spark, sf), 2000).select("id")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        by_value(F.col("event_type"), REGION_OF_EVENT).alias("region"),
        (event_number() + 1).alias("signal_strength"), F.col("ts").alias("created_at"),
    )


_SIGNALS_SQL = """signals AS (SELECT CASE event_type WHEN 'view' THEN 'AUTOMOBILE' WHEN 'purchase' THEN 'BUILDING'
    WHEN 'error' THEN 'FURNITURE' WHEN 'click' THEN 'HOUSEHOLD' WHEN 'signup' THEN 'MACHINERY' END AS region,
  CAST(json_extract_string(props, '$.k') AS INT) + 1 AS signal_strength, ts AS created_at FROM events)"""
_LIVE_SQL = """live AS (SELECT region AS county, max(signal_strength) AS signal_strength FROM signals
  WHERE created_at <= TIMESTAMP '2024-01-30 23:58:00' AND created_at > TIMESTAMP '2024-01-30 22:58:00' GROUP BY 1)"""


@query(
    f"""WITH {TASKS_SQL}, {_SIGNALS_SQL}, {_LIVE_SQL}
SELECT id, county, CAST(signal_strength AS INT) AS signal_strength FROM tasks JOIN live USING (county)
ORDER BY signal_strength DESC, last_scraped_at ASC NULLS FIRST, id LIMIT 500"""
)
def hotspot(spark: SparkSession, sf: str) -> DataFrame:
    hot = S.hotspot(tasks(spark, sf), _signals(spark, sf), as_ts("2024-01-30 23:58:00"), 500)
    return hot.select("id", "county", "signal_strength")


@query(
    f"""WITH {TASKS_SQL} SELECT id, strftime(created_at, '%Y-%m-%d') AS auction_date FROM tasks
WHERE amount >= 200000 AND date_diff('day', DATE '1998-06-01', CAST(created_at AS DATE)) BETWEEN 0 AND 30"""
)
def targeted(spark: SparkSession, sf: str) -> DataFrame:
    when = F.date_format("created_at", "yyyy-MM-dd")
    tags = F.to_json(F.struct(F.when(F.col("amount") >= 200000, when).alias("auction_date"), "platform"))
    found = S.targeted(tasks(spark, sf).withColumn("tags", tags), as_ts("1998-06-01"))
    return found.select("id", F.col("auction_date").cast("string").alias("auction_date"))


@query(
    """WITH ids AS (SELECT DISTINCT o_orderpriority AS region, o_custkey AS id FROM orders),
n AS (SELECT *, lead(id) OVER (PARTITION BY region ORDER BY id) AS nxt FROM ids)
SELECT region, id + 1 AS gap_start, nxt - 1 AS gap_end FROM n WHERE nxt - id > 1"""
)
def sweeper_gaps(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("region"), F.col("o_custkey").alias("id"))
    return S.sweeper_gaps(ids)


@query(
    """WITH ids AS (SELECT o_orderpriority AS region, o_orderkey AS id FROM orders),
c AS (SELECT o_orderpriority AS region, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '4'
  AND o_totalprice > 499000 GROUP BY 1)
SELECT ids.region, ids.id FROM ids LEFT JOIN c USING (region) WHERE c.last IS NULL OR ids.id > c.last"""
)
def sweeper_next(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    ids = orders.select(F.col("o_orderpriority").alias("region"), F.col("o_orderkey").alias("id"))
    checked = orders.where("o_orderstatus = 'F' AND o_orderpriority < '4' AND o_totalprice > 499000").select(
        F.col("o_orderpriority").alias("region"), F.col("o_orderkey").alias("last_checked_id")
    )
    return S.sweeper_next(ids, checked)


@query(
    r"""WITH words AS (SELECT DISTINCT doc_id AS id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w
  FROM documents) WHERE w <> ''),
k AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> '')
SELECT id, CAST(count(*) AS BIGINT) AS hits FROM words JOIN k USING (w) GROUP BY 1"""
)
def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Known words each document holds, over whole texts."""
    split = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    known = load(spark, sf, "benchmark").select(F.explode(split).alias("keyword")).where(F.col("keyword") != "")
    docs = spread_small(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return S.seeded(docs, "text", known)


def _tagged(rows: DataFrame) -> DataFrame:
    tags = F.array_compact(
        F.array(F.when(F.col("amount") > 400000, "delinquent"), F.when(F.col("level") == 4, "slow"))
    )
    return rows.withColumn("tags", tags)


@query(f"WITH {BARE_TASKS_SQL} SELECT id FROM tasks ORDER BY amount > 400000 DESC, priority DESC, id LIMIT 3000")
def risk(spark: SparkSession, sf: str) -> DataFrame:
    return S.risk(_tagged(bare_tasks(spark, sf)), 3000).select("id")


@query(
    f"""WITH {TASKS_SQL}, {_SIGNALS_SQL}, {_LIVE_SQL},
lists AS (
  SELECT id, url, 0 AS rank, row_number() OVER (ORDER BY amount > 400000 DESC, priority DESC, id) AS pos FROM tasks
  UNION ALL SELECT id, url, 1, row_number() OVER (ORDER BY last_scraped_at ASC NULLS FIRST, id) FROM tasks WHERE status <> 'processing'
  UNION ALL SELECT id, url, 2, row_number() OVER (ORDER BY signal_strength DESC, last_scraped_at ASC NULLS FIRST, id)
    FROM tasks JOIN live USING (county)),
b AS (SELECT id, url, rank, pos AS row_pos FROM lists QUALIFY row_number() OVER (PARTITION BY rank, url ORDER BY pos) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY row_pos) AS pos FROM b QUALIFY pos <= 100),
r AS (SELECT * FROM l WHERE rank = 0 ORDER BY pos LIMIT 50),
c AS (SELECT * FROM l WHERE rank = 1 AND url NOT IN (SELECT url FROM r) ORDER BY pos LIMIT 30),
h AS (SELECT * FROM l WHERE rank = 2 AND url NOT IN (SELECT url FROM r UNION ALL SELECT url FROM c) ORDER BY pos LIMIT 20),
m AS (SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM h),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, pos) AS rn FROM l WHERE url NOT IN (SELECT url FROM m)) WHERE rn = 1),
o AS (SELECT id, url, rank, pos, 0 AS late FROM m UNION ALL SELECT id, url, rank, pos, 1 FROM x ORDER BY late, rank, pos LIMIT 100)
SELECT id, url, ['risk', 'chronos', 'hotspot'][rank + 1] AS strategy FROM o"""
)
def strategy_mix(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred picks; no list is joined to more than the segments of its customers."""
    bare = bare_tasks(spark, sf)
    pool = _tagged(bare)
    segment = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("county"))
    placed = bare.select("id", "url", "last_scraped_at", "o_custkey").join(segment, "o_custkey")
    limit, weights = 100, {"risk": 0.5, "chronos": 0.3, "hotspot": 0.2}
    oldest = [F.col("last_scraped_at").asc_nulls_first(), F.col("id").asc()]
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in S.RISK_TAGS]))
    return S.strategy_mix(
        {
            "risk": (pool, [tagged.desc(), F.col("priority").desc(), F.col("id").asc()]),
            "chronos": (pool.where("status <> 'processing'"), oldest),
            "hotspot": (
                S.hotspot(placed, _signals(spark, sf), as_ts("2024-01-30 23:58:00"), None),
                [F.col("signal_strength").desc(), *oldest],
            ),
        },
        limit,
        weights,
    )


@query(
    """WITH picks AS (SELECT event_type AS strategy, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS cycle,
  CASE WHEN value > 25 THEN 1 ELSE 0 END AS picks FROM events),
p AS (SELECT strategy, cycle, sum(picks) AS picks FROM picks GROUP BY 1, 2),
w AS (SELECT strategy, cycle, sum(picks) OVER x AS recent, count(*) OVER x AS seen FROM p
  WINDOW x AS (PARTITION BY strategy ORDER BY cycle RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT strategy, CAST(cycle AS BIGINT) AS cycle, CAST(recent AS BIGINT) AS recent_picks, recent = 0 AND seen = 10 AS forced FROM w"""
)
def starvation(spark: SparkSession, sf: str) -> DataFrame:
    picks = load(spark, sf, "events").select(
        F.col("event_type").alias("strategy"),
        F.timestamp_diff("HOUR", as_ts("2024-01-01"), F.date_trunc("hour", "ts")).alias("cycle"),
        F.when(F.col("value") > 25, 1).otherwise(0).alias("picks"),
    )
    return S.starvation_check(picks)


@query(
    f"""WITH {TASKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY platform {_PULL}) AS rn FROM tasks WHERE status = 'pending')
SELECT id, platform, CAST((rn - 1) // 5 AS BIGINT) AS slot,
  strftime(TIMESTAMP '2024-02-01' + INTERVAL 1 MINUTE * ((rn - 1) // 5), '%Y-%m-%d %H:%M:%S') AS planned_at FROM r"""
)
def rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    waiting = tasks(spark, sf).where("status = 'pending'")
    slots = S.rate_slots(waiting, R.pull_order(), 5, as_ts("2024-02-01"), id_col="id", by=["priority", "created_at"])
    return slots.select("id", "platform", "slot", text("planned_at").alias("planned_at"))
