"""Driver queries that run streaming jobs over all available input and read their sinks back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.plans.registry import query
from parcelweave.plans.tables import LOG_SQL, MICRO, TELEMETRY_SQL, decoded_sql, event_log, load, telemetry, text
from parcelweave.session import fresh_dir
from parcelweave.streaming import jobs as K


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = load(spark, sf, table).schema
    # A glob, so that the table may be one file as well as a directory of parts.
    return K.read_stream(spark, f"{sf}/{table}.parque[t]", schema)


def _drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    base = fresh_dir(spark, label)
    return K.drain_to(stream, f"{base}/out", f"{base}/checkpoint")


def _timed(events: DataFrame) -> DataFrame:
    return telemetry(events).withColumn("ts", K.event_time("ts"))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = _stream(spark, sf, "events").select("user_id", "event_id", K.event_time("ts").alias("ts"))
    unique = K.stream_dedup(arrivals, "ts", "40 days", ["user_id"], spread_by="event_id")
    return _drain(spark, unique.select("user_id"), "dedup")


_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@query(
    f"""WITH {TELEMETRY_SQL}, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s,
  CAST(count(*) FILTER (WHERE type = 'started') AS BIGINT) AS started,
  CAST(count(*) FILTER (WHERE type = 'succeeded') AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE type = 'failed') AS BIGINT) AS failed FROM telemetry GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  started, succeeded, failed, round(CASE WHEN succeeded + failed > 0 THEN succeeded / (succeeded + failed) END, 4) AS success_rate
FROM w WHERE s + INTERVAL 1 HOUR <= {_WATERMARK}"""
)
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly metrics; a window is emitted once the watermark has passed it."""
    found = _drain(spark, K.stream_metrics(_timed(_stream(spark, sf, "events")), "1 hour"), "metrics")
    return found.withColumns({"window_start": text("window_start"), "window_end": text("window_end")})


@query(
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
j AS (SELECT user_id AS worker, min(ts) AS a, max(ts) + INTERVAL 30 MINUTES AS b, count(*) AS n FROM s GROUP BY user_id, sid)
SELECT worker, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS joined_at, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS left_at,
  CAST(n AS BIGINT) AS events FROM j WHERE b <= {_WATERMARK}"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = _timed(_stream(spark, sf, "events")).select("worker", "ts")
    found = _drain(spark, K.worker_sessions(events, "30 minutes"), "sessions")
    return found.withColumns({"joined_at": text("joined_at", MICRO), "left_at": text("left_at", MICRO)})


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, value FROM r WHERE rn = 1"""
)
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = fresh_dir(spark, "upsert")
    rows = _stream(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    K.stream_upsert(rows, ["user_id"], ["ts", "event_id"], f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    table = K.read_upserted(spark, f"{base}/deltas", ["user_id"], order=["ts", "event_id"])
    return table.select("user_id", "event_id", "value")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, value FROM r WHERE rn = 1"""
)
def stream_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas of a first delivery are compacted into a base and emptied; those of a second one come on top."""
    base = fresh_dir(spark, "compacted")
    events = load(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    key, order = ["user_id"], ["ts", "event_id"]
    for delivery in (0, 1):
        events.where(F.col("event_id") % 2 == delivery).write.mode("append").parquet(f"{base}/in")
        rows = K.read_stream(spark, f"{base}/in", events.schema)
        K.stream_upsert(rows, key, order, f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
        if delivery == 0:
            K.compact(spark, f"{base}/deltas", key, order)
            K.drop_deltas(spark, f"{base}/deltas")
    return K.read_upserted(spark, f"{base}/deltas", key, order=order).select("user_id", "event_id", "value")


@query(
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS ids,
  CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1"""
)
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A job that stops and starts again from its checkpoint: every row arrives once."""
    base = fresh_dir(spark, "resume")
    events = load(spark, sf, "events").select("event_id", "event_type")
    for delivery in (0, 1, 2):
        events.where(F.col("event_id") % 3 == delivery).write.mode("append").parquet(f"{base}/in")
        arrived = K.drain_to(K.read_stream(spark, f"{base}/in", events.schema), f"{base}/out", f"{base}/checkpoint")
    per_id = arrived.groupBy("event_type", "event_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum(F.col("event_id") * F.col("n")).alias("id_sum")
    )


@query(
    f"""WITH {LOG_SQL}, f AS (SELECT id, arg_max(type, seq) FILTER (WHERE type <> 'start') AS set_type, max(seq) FILTER (WHERE type <> 'start') AS set_seq,
  max(seq) FILTER (WHERE type = 'start') AS run_seq, count(*) FILTER (WHERE type = 'retry') AS retries FROM log GROUP BY 1)
SELECT id, CASE WHEN set_type = 'complete' THEN 'completed' WHEN set_type = 'fail' THEN 'failed'
  WHEN run_seq > coalesce(set_seq, -1) THEN 'processing' ELSE 'pending' END AS status, CAST(retries AS BIGINT) AS retry_count FROM f"""
)
def stream_task_state(spark: SparkSession, sf: str) -> DataFrame:
    """Task states kept up to date batch by batch; the last update of each is read."""
    base = fresh_dir(spark, "state")
    log = event_log(_stream(spark, sf, "events")).where(F.col("type").isNotNull())
    K.write_updates(K.stream_task_state(log, silence=None), f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    return K.read_upserted(spark, f"{base}/deltas", ["id"])


_DELIVERIES = ("2024-01-11", "2024-01-21")


@query(
    f"""WITH {LOG_SQL}, d AS (SELECT *, epoch_ms(ts) AS ms, CASE WHEN ts < TIMESTAMP '{_DELIVERIES[0]}' THEN 0 WHEN ts < TIMESTAMP '{_DELIVERIES[1]}' THEN 1 ELSE 2 END AS part FROM log),
w AS (SELECT p.part, max(ms) - 600000 AS mark FROM (VALUES (1), (2)) p(part) JOIN d ON d.part < p.part GROUP BY 1),
g AS (SELECT id, part, max(ms) + 6 * 3600000 AS until FROM d GROUP BY 1, 2),
h AS (SELECT g.id, g.part, lag(until) OVER (PARTITION BY g.id ORDER BY g.part) AS before, w.mark FROM g LEFT JOIN w USING (part)),
b AS (SELECT id, max(part) AS anew FROM h WHERE before IS NULL OR before < mark GROUP BY 1),
f AS (SELECT id, arg_max(type, seq) FILTER (WHERE type <> 'start') AS set_type, max(seq) FILTER (WHERE type <> 'start') AS set_seq,
  max(seq) FILTER (WHERE type = 'start') AS run_seq, count(*) FILTER (WHERE type = 'retry') AS retries FROM d JOIN b USING (id) WHERE part >= anew GROUP BY 1)
SELECT id, CASE WHEN set_type = 'complete' THEN 'completed' WHEN set_type = 'fail' THEN 'failed'
  WHEN run_seq > coalesce(set_seq, -1) THEN 'processing' ELSE 'pending' END AS status, CAST(retries AS BIGINT) AS retry_count FROM f"""
)
def stream_expiring_state(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries: a task that was silent for six hours before one ended starts anew in the next."""
    base = fresh_dir(spark, "expiring")
    log = event_log(load(spark, sf, "events")).where(F.col("type").isNotNull()).withColumn("ts", K.event_time("ts"))
    first, second = (F.lit(day).cast("timestamp") for day in _DELIVERIES)
    for part in (F.col("ts") < first, (F.col("ts") >= first) & (F.col("ts") < second), F.col("ts") >= second):
        log.where(part).write.mode("append").parquet(f"{base}/in")
        arriving = K.read_stream(spark, f"{base}/in", log.schema)
        updates = K.stream_task_state(arriving, silence="6 hours")
        K.write_updates(updates, f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    return K.read_upserted(spark, f"{base}/deltas", ["id"])


@query(
    """SELECT t.event_id AS id, s.event_id AS signal_id FROM events t JOIN events s ON t.user_id = s.user_id
WHERE t.event_type = 'view' AND s.event_type = 'click' AND s.ts <= t.ts AND s.ts > t.ts - INTERVAL 1 HOUR"""
)
def stream_signal_join(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf, "events")
    views = events.where("event_type = 'view'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("county"), K.event_time("ts").alias("ts")
    )
    clicks = _stream(spark, sf, "events").where("event_type = 'click'").select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("region"), K.event_time("ts").alias("signal_ts")
    )
    return _drain(spark, K.signal_join(views, clicks).select("id", "signal_id"), "signals")


_TITLE_SQL = decoded_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")


@query(f"SELECT page_id, nullif({_TITLE_SQL}, '') AS title, CAST(0 AS BIGINT) AS errors FROM pages")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Pages parsed as they arrive, drained, and read back."""
    base = fresh_dir(spark, "ingest")
    config = {"selectors": {"title": {"selector": "title"}}}
    job = K.continuous_ingest(_stream(spark, sf, "pages"), config, f"{base}/out", f"{base}/checkpoint", drain=True)
    job.awaitTermination()
    records = spark.read.parquet(f"{base}/out")
    return records.select("page_id", "data.title", F.size("errors").cast("bigint").alias("errors"))
