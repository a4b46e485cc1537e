"""Driver queries over telemetry and the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.operators import metrics as I
from parcelweave.plans.registry import query
from parcelweave.plans.tables import BARE_TASKS_SQL, TASKS_SQL, TELEMETRY_SQL, as_ts, bare_tasks, links, load, tasks, telemetry, text

BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0)
_T = f"WITH {TELEMETRY_SQL}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(load(spark, sf, "events"))


def _n(kind: str) -> str:
    return f"CAST(count(*) FILTER (WHERE type = '{kind}') AS BIGINT)"


_RATE = "round(CASE WHEN succeeded + failed > 0 THEN succeeded / (succeeded + failed) END, 4)"
_STARTED, _GOOD, _BAD = _n("started"), _n("succeeded"), _n("failed")


@query(f"{_T} SELECT {_GOOD} AS succeeded, {_BAD} AS failed FROM telemetry")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return I.event_counts(_events(spark, sf))


@query(f"{_T} SELECT {_STARTED} - {_GOOD} - {_BAD} AS running FROM telemetry")
def tasks_running(spark: SparkSession, sf: str) -> DataFrame:
    return I.tasks_running(_events(spark, sf))


_LEVEL_SQL = f"""{TELEMETRY_SQL}, m AS (SELECT date_trunc('minute', ts) AS minute, CAST(sum(CASE type WHEN 'started' THEN 1 ELSE -1 END) AS BIGINT) AS change
  FROM telemetry WHERE type IN ('started', 'succeeded', 'failed') GROUP BY 1),
levels AS (SELECT minute, change, CAST(sum(change) OVER (ORDER BY minute) AS BIGINT) AS level FROM m)"""


@query(f"WITH {_LEVEL_SQL} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, change, level FROM levels")
def running_level(spark: SparkSession, sf: str) -> DataFrame:
    return I.running_level(_events(spark, sf)).withColumn("minute", text("minute"))


@query(
    f"""WITH {_LEVEL_SQL}, w AS (SELECT minute, level, min(level) OVER (ORDER BY minute RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS lowest
  FROM levels) SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, level, lowest, lowest > -100 AS alert FROM w"""
)
def sustained_alert(spark: SparkSession, sf: str) -> DataFrame:
    levels = I.running_level(_events(spark, sf)).select("minute", "level")
    return I.sustained_alert(levels, -100).withColumn("minute", text("minute"))


@query(
    f"""{_T}, w AS (SELECT worker, max(ts) AS seen FROM telemetry WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE date_sub('second', seen, TIMESTAMP '2024-01-30 12:00:00') <= 36000) AS BIGINT) AS online,
  CAST(count(*) AS BIGINT) AS known FROM w"""
)
def online_workers(spark: SparkSession, sf: str) -> DataFrame:
    return I.online_workers(_events(spark, sf), as_ts("2024-01-30 12:00:00"), 36000)


def _rates_sql(size: str) -> str:
    return f"""{_T}, w AS (SELECT time_bucket(INTERVAL '{size}', ts) AS s, {_GOOD} AS succeeded, {_BAD} AS failed FROM telemetry
  WHERE type IN ('succeeded', 'failed') GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, succeeded, failed, {_RATE} AS success_rate FROM w"""


@query(_rates_sql("5 minutes"))
def success_rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    return I.windowed_success_rate(_events(spark, sf)).withColumn("window_start", text("window_start"))


@query(_rates_sql("1 hour"))
def success_rate_1h(spark: SparkSession, sf: str) -> DataFrame:
    return I.windowed_success_rate(_events(spark, sf), "1 hour").withColumn("window_start", text("window_start"))


@query(
    """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1"""
)
def runtime_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = I.runtime_quantiles(_events(spark, sf), "1 day")
    return found.select(text("window_start").alias("window_start"), *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


def _interpolated_sql(q: float) -> str:
    chain = ""
    for i, bound in enumerate(BOUNDS):
        low, below = (BOUNDS[i - 1], f"b{i - 1}") if i else (0.0, "0")
        chain += f" WHEN b{i} >= {q} * n THEN {low} + {bound - low} * ({q} * n - {below}) / (b{i} - {below})"
    return f"round(CAST(CASE{chain} ELSE {BOUNDS[-1]} END AS DOUBLE), 4)"


_BUCKETS_SQL = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))


@query(
    f"""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, {_BUCKETS_SQL}, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS n, {_interpolated_sql(0.5)} AS p50, {_interpolated_sql(0.95)} AS p95,
  {_interpolated_sql(0.99)} AS p99 FROM w"""
)
def histogram_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = I.histogram_quantiles(_events(spark, sf), "1 hour", BOUNDS)
    return found.select(text("window_start").alias("window_start"), "n", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


@query(
    f"""{_T}, b AS (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0]) AS bound, unnest(['1.0', '2.5', '5.0', '10.0', '25.0', '50.0']) AS le),
s AS (SELECT platform, round(sum(runtime), 4) AS sum, count(*) AS n FROM telemetry GROUP BY 1)
SELECT t.platform, le, CAST(count(*) FILTER (WHERE runtime <= bound) AS BIGINT) AS n, any_value(s.sum) AS sum, CAST(any_value(s.n) AS BIGINT) AS count
FROM telemetry t JOIN s USING (platform), b GROUP BY 1, 2
UNION ALL SELECT platform, '+Inf', CAST(n AS BIGINT), sum, CAST(n AS BIGINT) FROM s"""
)
def runtime_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return I.runtime_histogram(_events(spark, sf), ["platform"], BOUNDS)


@query(
    f"""{_T}, s AS (SELECT date_trunc('minute', ts) - INTERVAL 1 MINUTE * k AS window_start, type FROM telemetry, range(0, 5) r(k)
  WHERE type IN ('started', 'succeeded', 'failed'))
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, round({_STARTED} / 300, 6) AS started_rate,
  round({_GOOD} / 300, 6) AS succeeded_rate, round({_BAD} / 300, 6) AS failed_rate FROM s GROUP BY window_start"""
)
def throughput_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return I.throughput(_events(spark, sf)).withColumn("window_start", text("window_start"))


@query(f"{_T} SELECT worker, CAST(count(*) AS BIGINT) AS tasks FROM telemetry WHERE type = 'started' GROUP BY 1")
def tasks_per_worker(spark: SparkSession, sf: str) -> DataFrame:
    return I.tasks_per_worker(_events(spark, sf))


@query(
    f"""{_T}, r AS (SELECT t.* REPLACE (nullif(task_type, 'fast') AS task_type, nullif(platform, 'p1') AS platform), rg.range FROM telemetry t, (SELECT unnest(['1h', '24h', '7d']) AS range, unnest([3600, 86400, 604800]) AS secs) rg
  WHERE ts <= TIMESTAMP '2024-01-30 23:59:00' AND date_sub('second', ts, TIMESTAMP '2024-01-30 23:59:00') < secs)
SELECT range, CAST(grouping(task_type, platform) AS INT) AS grouping, task_type, platform, CAST(count(*) FILTER (WHERE type IN ('succeeded', 'failed')) AS BIGINT) AS total, {_GOOD} AS succeeded, {_BAD} AS failed,
  round(CASE WHEN count(*) FILTER (WHERE type IN ('succeeded', 'failed')) > 0 THEN
    count(*) FILTER (WHERE type = 'succeeded') / count(*) FILTER (WHERE type IN ('succeeded', 'failed')) END, 4) AS success_rate,
  round(avg(runtime) FILTER (WHERE type IN ('succeeded', 'failed')), 4) AS avg_runtime,
  round(quantile_cont(runtime, 0.5) FILTER (WHERE type IN ('succeeded', 'failed')), 4) AS median_runtime,
  min(runtime) FILTER (WHERE type IN ('succeeded', 'failed')) AS min_runtime,
  max(runtime) FILTER (WHERE type IN ('succeeded', 'failed')) AS max_runtime
FROM r GROUP BY GROUPING SETS ((range, task_type, platform), (range, task_type), (range, platform), (range))"""
)
def range_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the type ``fast`` and of platform ``p1`` come as of unknown type and platform."""
    unknown = {c: F.nullif(F.col(c), F.lit(value)) for c, value in (("task_type", "fast"), ("platform", "p1"))}
    return I.range_stats(_events(spark, sf).withColumns(unknown), as_ts("2024-01-30 23:59:00"))


@query(
    f"""{_T}, p AS (SELECT platform, {_GOOD} AS succeeded, {_BAD} AS failed, max(ts) FILTER (WHERE type = 'succeeded') AS ok FROM telemetry GROUP BY 1),
r AS (SELECT *, {_RATE} AS success_rate FROM p)
SELECT platform, succeeded, failed, strftime(ok, '%Y-%m-%d %H:%M:%S') AS last_ok_at, success_rate,
  CASE WHEN success_rate < 0.7 THEN 'critical' WHEN success_rate < 0.9 THEN 'warning' ELSE 'ok' END AS alert FROM r"""
)
def platform_health(spark: SparkSession, sf: str) -> DataFrame:
    return I.platform_health(_events(spark, sf)).withColumn("last_ok_at", text("last_ok_at"))


@query(
    f"""WITH {TASKS_SQL}, q AS (SELECT level, nullif(platform, 'FRANCE') AS platform FROM tasks WHERE status = 'pending'),
d AS (SELECT level, platform, count(*) AS depth, grouping(level, platform) AS g FROM q GROUP BY ROLLUP (level, platform))
SELECT CAST(g AS INT) AS grouping, CAST(level AS INT) AS level, platform, CAST(depth AS BIGINT) AS depth, CASE WHEN level = 1 AND g = 1 AND depth > 500 THEN 'critical'
  WHEN level = 1 AND g = 1 AND depth > 100 THEN 'warning' ELSE 'ok' END AS alert FROM d"""
)
def queue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of one country come as of an unknown platform."""
    return I.queue_depth(tasks(spark, sf).withColumn("platform", F.nullif(F.col("platform"), F.lit("FRANCE"))))


@query(
    f"""WITH {BARE_TASKS_SQL}, w AS (SELECT id, level, date_sub('second', created_at, TIMESTAMP '1998-01-01 00:04:00') AS waited FROM tasks WHERE status = 'pending')
SELECT id, CAST(level AS INT) AS level, CAST(waited AS BIGINT) AS waited_seconds FROM w
WHERE waited > CASE level WHEN 1 THEN 30 WHEN 2 THEN 300 WHEN 3 THEN 3600 ELSE 86400 END"""
)
def sla_breach(spark: SparkSession, sf: str) -> DataFrame:
    late = I.sla_breaches(bare_tasks(spark, sf), as_ts("1998-01-01 00:04:00"))
    return late.select("id", "level", "waited_seconds")


@query(
    f"""WITH {TASKS_SQL} SELECT platform, CAST(count(DISTINCT county) AS BIGINT) AS counties,
  CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS assessor, CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS tax,
  CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS gis FROM tasks GROUP BY 1"""
)
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("status") == "pending", "assessor").when(F.col("status") == "processing", "tax").otherwise("gis")
    registry = tasks(spark, sf).select("platform", "county", kind.alias("data_type"))
    return I.coverage_matrix(registry, ["assessor", "tax", "gis"])


@query(
    f"""{_T} SELECT platform, task_type AS parser_version, CAST(count(*) AS BIGINT) AS parses, round(avg(runtime), 4) AS avg_ms, max(runtime) AS max_ms,
  round(quantile_cont(runtime, 0.5), 4) AS p50_ms, round(quantile_cont(runtime, 0.95), 4) AS p95_ms FROM telemetry GROUP BY 1, 2"""
)
def parse_duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    parses = _events(spark, sf).select("platform", F.col("task_type").alias("parser_version"), F.col("runtime").alias("parse_duration_ms"))
    return I.parse_duration_stats(parses)


@query(
    """WITH t AS (SELECT l_orderkey AS root_id, CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT root_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed FROM t GROUP BY 1)
SELECT root_id, CAST(total AS BIGINT) AS total, CAST(pending AS BIGINT) AS pending, CAST(0 AS BIGINT) AS processing, CAST(completed AS BIGINT) AS completed,
  CAST(failed AS BIGINT) AS failed, round((completed + failed) * 100.0 / total, 2) AS progress_percent FROM c"""
)
def chain_progress(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("root_id"))
    items = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("root_id"),
        F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "A", "failed").otherwise("completed").alias("status"),
    )
    # Counting first leaves one row per chain on either side of the join.
    return I.chain_progress(items).join(orders, ["root_id"], "left_semi")


@query("SELECT l_returnflag AS kind, CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS BIGINT) AS waiting FROM lineitem GROUP BY 1")
def waiting_links(spark: SparkSession, sf: str) -> DataFrame:
    back = F.when(F.col("relationship_type") == "owner", "A").when(F.col("relationship_type") == "parcel", "N").otherwise("R")
    return links(spark, sf).groupBy(back.alias("kind")).agg(F.count_if(~F.col("processed")).alias("waiting"))
