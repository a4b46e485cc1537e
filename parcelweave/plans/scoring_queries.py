"""Driver queries over priority scoring, retention and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions.signing import verify
from parcelweave.operators import lifecycle as L
from parcelweave.operators import scoring as G
from parcelweave.plans.registry import query
from parcelweave.plans.tables import (
    AUCTIONS_SQL,
    LIENS_SQL,
    MICRO,
    PARCELS_SQL,
    TASKS_SQL,
    as_ts,
    auctions,
    by_value,
    event_number,
    liens,
    load,
    parcels,
    tasks,
    text,
)

AS_OF = "2001-08-02 00:00:00"


@query(
    """WITH t AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'owner' WHEN 'click' THEN 'county' WHEN 'error' THEN 'parcel'
    WHEN 'purchase' THEN 'neighbor' END AS rel, ts, CAST(json_extract_string(props, '$.k') AS INT) // 30 AS tried FROM events)
SELECT id, CAST(1 + CASE rel WHEN 'owner' THEN 5 WHEN 'county' THEN 3 WHEN 'parcel' THEN 2 WHEN 'neighbor' THEN 1 ELSE 0 END
  + least(date_sub('hour', ts, TIMESTAMP '2024-01-31'), 10) + 2 * tried + 4 AS BIGINT) AS priority FROM t"""
)
def task_priority(spark: SparkSession, sf: str) -> DataFrame:
    relation = by_value(F.col("event_type"), {"view": "owner", "click": "county", "error": "parcel", "purchase": "neighbor"})
    tried = F.floor(event_number() / 30).cast("int")
    score = G.task_priority(relation, F.col("ts"), tried, as_ts("2024-01-31"), boost=4, base=1)
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), score.alias("priority"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS p FROM orders)
SELECT id, p + least(CAST(trunc(p * 0.5) AS BIGINT), 20) AS boosted, greatest(CAST(trunc(CAST(p AS DOUBLE) * CAST(0.9 AS DOUBLE)) AS BIGINT), 30) AS decayed FROM p"""
)
def boost_decay(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.floor(F.col("o_totalprice") / 1000)
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), G.boost_priority(priority).alias("boosted"),
        G.decay_priority(priority, least=30).cast("bigint").alias("decayed"),
    )


_SCORED_SQL = f"""{PARCELS_SQL}, {LIENS_SQL}, {AUCTIONS_SQL},
held AS (SELECT parcel_id, count(*) AS active_liens, count(DISTINCT investor_id) AS holders FROM liens WHERE active GROUP BY 1),
st AS (SELECT p.*, CASE WHEN p.parcel_id IN (SELECT parcel_id FROM auctions) THEN 'auction_scheduled'
    WHEN holders > 1 THEN 'multiple_holders' WHEN tax_due > 0 THEN 'delinquent'
    WHEN holders = 1 THEN 'paid_active_liens' ELSE 'paid_no_liens' END AS status FROM parcels p LEFT JOIN held USING (parcel_id)),
base AS (SELECT *, date_sub('day', last_scraped_at, TIMESTAMP '{AS_OF}') AS days,
  date_sub('second', last_viewed_at, TIMESTAMP '{AS_OF}') AS since_view,
  CASE status WHEN 'paid_no_liens' THEN 0.1 WHEN 'paid_active_liens' THEN 1.0 WHEN 'delinquent' THEN 5.0
    WHEN 'multiple_holders' THEN 7.5 ELSE 10.0 END AS b,
  CASE status WHEN 'paid_no_liens' THEN 'HIBERNATION' WHEN 'paid_active_liens' THEN 'LOW' WHEN 'delinquent' THEN 'HIGH'
    WHEN 'multiple_holders' THEN 'HIGH' ELSE 'CRITICAL' END AS tier FROM st),
scored AS (SELECT *, CAST(b AS DOUBLE) * CASE WHEN state = 'AZ' THEN 2 ELSE 1 END
  * CASE WHEN tax_due <> 0 AND market_value / tax_due > 20 THEN 1.5 ELSE 1 END
  * CASE WHEN since_view BETWEEN 0 AND 86400 THEN 5 ELSE 1 END
  + CASE WHEN starts_with(status, 'paid') THEN least(coalesce(days, 0) * 0.1, 1.0) ELSE coalesce(days, 0) * 0.1 END AS raw_score
  FROM base)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    with_status = G.parcel_status(parcels(spark, sf), liens(spark, sf), auctions(spark, sf))
    return G.delinquency_score(with_status, as_ts(AS_OF))


@query(
    f"""WITH {_SCORED_SQL} SELECT parcel_id, status, round(raw_score, 4) AS raw_score,
  round(least(greatest(raw_score, 0), 10), 4) AS priority_score, tier FROM scored"""
)
def delinquency_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "parcel_id", "status", F.round("raw_score", 4).alias("raw_score"),
        F.round("priority_score", 4).alias("priority_score"), "tier",
    )


_HOURS_SQL = "CASE tier WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 72 WHEN 'LOW' THEN 720 ELSE 2160 END"
_LATEST_SQL = "CASE tier WHEN 'CRITICAL' THEN 24 WHEN 'HIGH' THEN 168 WHEN 'LOW' THEN 1440 ELSE 4320 END"


@query(
    f"""WITH {_SCORED_SQL} SELECT parcel_id, tier,
  strftime(last_scraped_at + INTERVAL 1 HOUR * {_HOURS_SQL}, '%Y-%m-%d %H:%M:%S') AS next_scrape_at,
  strftime(last_scraped_at + INTERVAL 1 HOUR * {_LATEST_SQL}, '%Y-%m-%d %H:%M:%S') AS latest_scrape_at FROM scored"""
)
def tier_schedule(spark: SparkSession, sf: str) -> DataFrame:
    planned = G.tier_schedule(_scored(spark, sf))
    return planned.select(
        "parcel_id", "tier", text("next_scrape_at").alias("next_scrape_at"), text("latest_scrape_at").alias("latest_scrape_at")
    )


@query(
    f"""WITH {_SCORED_SQL} SELECT parcel_id, tier FROM scored
WHERE last_scraped_at + INTERVAL 1 HOUR * {_HOURS_SQL} <= TIMESTAMP '{AS_OF}'
ORDER BY round(least(greatest(raw_score, 0), 10), 6) DESC, parcel_id LIMIT 200"""
)
def due_parcels(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).withColumn("priority_score", F.round("priority_score", 6))
    return G.due_parcels(G.tier_schedule(scored), as_ts(AS_OF), 200).select("parcel_id", "tier")


@query(
    f"""WITH {_SCORED_SQL}, m AS (SELECT parcel_id, state, CASE WHEN status = 'paid_active_liens' THEN 'active_lien'
    WHEN status = 'multiple_holders' AND state = 'FL' THEN 'tda_filed' WHEN status = 'multiple_holders' THEN 'foreclosure'
    ELSE status END AS phase FROM scored)
SELECT parcel_id, state, phase, CASE state || ':' || phase WHEN 'AZ:delinquent' THEN 'HIGH' WHEN 'AZ:active_lien' THEN 'LOW'
    WHEN 'AZ:foreclosure' THEN 'CRITICAL' WHEN 'FL:delinquent' THEN 'HIGH' WHEN 'FL:active_lien' THEN 'LOW'
    WHEN 'FL:tda_filed' THEN 'SUPER HOT' WHEN 'DEED:auction_scheduled' THEN 'CRITICAL' END AS matrix_priority,
  CASE state || ':' || phase WHEN 'AZ:delinquent' THEN 'weekly' WHEN 'AZ:active_lien' THEN 'monthly'
    WHEN 'AZ:foreclosure' THEN 'daily' WHEN 'FL:delinquent' THEN 'weekly' WHEN 'FL:active_lien' THEN 'monthly'
    WHEN 'FL:tda_filed' THEN 'daily' WHEN 'DEED:auction_scheduled' THEN 'daily' END AS frequency FROM m"""
)
def state_matrix(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("status")
    phase = (
        F.when(status == "paid_active_liens", "active_lien")
        .when((status == "multiple_holders") & (F.col("state") == "FL"), "tda_filed")
        .when(status == "multiple_holders", "foreclosure")
        .otherwise(status)
    )
    phased = _scored(spark, sf).select("parcel_id", "state", phase.alias("phase"))
    return G.state_matrix(phased, "state", "phase")


@query(
    f"""WITH {PARCELS_SQL}, {LIENS_SQL}, t AS (SELECT parcel_id, CASE county WHEN 'BUILDING' THEN 'CRITICAL' WHEN 'FURNITURE' THEN 'MEDIUM' ELSE 'LOW' END AS tier
  FROM parcels)
SELECT parcel_id, CASE WHEN parcel_id IN (SELECT parcel_id FROM liens WHERE active GROUP BY 1 HAVING count(DISTINCT investor_id) > 1)
  AND tier <> 'CRITICAL' THEN 'HIGH' ELSE tier END AS tier FROM t"""
)
def multi_holder(spark: SparkSession, sf: str) -> DataFrame:
    tier = by_value(F.col("county"), {"BUILDING": "CRITICAL", "FURNITURE": "MEDIUM"}, "LOW")
    rows = parcels(spark, sf).select("parcel_id", tier.alias("tier"))
    return G.multi_holder_boost(rows, liens(spark, sf))


@query(
    f"""WITH {_SCORED_SQL}, cal AS (SELECT DISTINCT CASE n_name WHEN 'NATION_3' THEN 'AZ' WHEN 'NATION_4' THEN 'FL' ELSE 'DEED' END AS state,
    c_mktsegment AS county FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'),
rel AS (SELECT parcel_id FROM auctions WHERE released_at <= TIMESTAMP '1997-06-01')
SELECT parcel_id, CASE WHEN parcel_id IN (SELECT parcel_id FROM rel) THEN 'CRITICAL'
  WHEN starts_with(status, 'paid') AND county <> 'BUILDING' AND tier NOT IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE tier END AS tier
FROM scored"""
)
def event_triggers(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).select("parcel_id", "state", "county", "status", "tier")
    due = F.when(F.col("county") != "BUILDING", as_ts("1997-05-31")).otherwise(as_ts("1997-05-30"))
    calendar = parcels(spark, sf).select("state", "county", due.alias("due_date")).distinct()
    raised = G.event_triggers(scored, calendar, auctions(spark, sf), as_ts("1997-06-01"))
    return raised.select("parcel_id", "tier")


@query(
    """SELECT o_orderkey AS id, round(CASE WHEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) < 0 THEN 0
  ELSE 10 * exp(-date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) / 14.0) END, 6) AS score FROM orders"""
)
def auction_proximity(spark: SparkSession, sf: str) -> DataFrame:
    score = G.auction_proximity(F.col("o_orderdate"), as_ts("1998-01-01"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(score, 6).alias("score"))


@query(
    f"""WITH {PARCELS_SQL}, {LIENS_SQL}, h AS (SELECT parcel_id, count(*) AS n FROM liens WHERE active GROUP BY 1)
SELECT parcel_id, concat_ws(',', CASE WHEN tax_due > 5000 THEN 'delinquent' END, CASE WHEN n > 1 THEN 'stacking' END,
    CASE WHEN state = 'AZ' THEN 'auction_feb_2026' END) AS tags,
  CAST(CASE WHEN tax_due > 5000 OR n > 1 THEN 200 WHEN state = 'AZ' THEN 150 ELSE 3 END AS INT) AS priority
FROM parcels LEFT JOIN h USING (parcel_id)"""
)
def risk_tags(spark: SparkSession, sf: str) -> DataFrame:
    joined = parcels(spark, sf).join(G.multi_holder(liens(spark, sf)), ["parcel_id"], "left")
    tags, priority = G.risk_tags(F.col("tax_due") - 5000, F.col("active_liens"), F.col("state"), F.lit(3))
    return joined.select("parcel_id", F.array_join(tags, ",").alias("tags"), priority.alias("priority"))


# --- retention and notification -----------------------------------------------------------


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, props, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM r WHERE rn = 1"""
)
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    saved = load(spark, sf, "events").select("user_id", "event_id", "ts", "props")
    return L.latest_snapshot(saved, ["user_id"], ["ts", "event_id"]).withColumn("ts", text("ts", MICRO))


@query(
    """SELECT CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') >= 365 THEN 'archive'
    WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') >= 30 THEN 'compress' ELSE 'keep' END AS action,
  CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1"""
)
def retention_class(spark: SparkSession, sf: str) -> DataFrame:
    action = L.retention_class(F.col("o_orderdate"), as_ts(AS_OF))
    return load(spark, sf, "orders").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE date_sub('second', ts, TIMESTAMP '2024-01-31') <= 7 * 86400)
SELECT user_id, event_id FROM r WHERE rn <= 5"""
)
def expire_keep_n(spark: SparkSession, sf: str) -> DataFrame:
    saved = load(spark, sf, "events").select("user_id", "event_id", "ts")
    recent = L.expire_by_age(saved, "ts", as_ts("2024-01-31"), L.KEEP_DAYS["screenshot"])
    kept = L.keep_newest(recent, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return kept.select("user_id", "event_id")


@query(
    """WITH o AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS failed,
  max(event_id) FILTER (WHERE event_type = 'purchase') AS passed FROM events GROUP BY 1)
SELECT user_id AS parcel_id, failed AS seq FROM o WHERE failed IS NOT NULL AND (passed IS NULL OR failed > passed)"""
)
def last_failure(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = load(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("parcel_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok")
    )
    return L.keep_last_failure(outcomes).select("parcel_id", "seq")


def _ended(spark: SparkSession, sf: str) -> DataFrame:
    done = tasks(spark, sf).where("status <> 'pending'")
    good = F.col("status") == "completed"
    return done.select(
        F.col("id").cast("string").alias("task_id"), "platform",
        F.when(good, "task.completed").otherwise("task.failed").alias("event"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(
            good,
            F.struct(
                F.col("priority").alias("priority"), F.concat(F.lit("Señor 😀 "), "county").alias("county"),
                (F.col("amount") * 1000).alias("amount"), (F.col("priority") / 1e5).alias("share"),
            ),
        ).alias("result"),
        F.when(
            good, F.create_map(F.lit("pdf"), F.lit("raw/p"), F.lit("html"), F.concat(F.lit("raw/"), F.col("id").cast("string")))
        ).alias("raw_paths"),
        F.when(~good, F.concat(F.lit("level "), F.col("level").cast("string"))).alias("error"),
    )


_OUTBOX_SQL = f"""{TASKS_SQL}, o AS (SELECT CAST(id AS VARCHAR) AS task_id,
  CASE WHEN status = 'completed' THEN 'task.completed' ELSE 'task.failed' END AS event,
  '{{"error":' || CASE WHEN status = 'completed' THEN 'null' ELSE '"level ' || level || '"' END ||
  ',"event":"' || CASE WHEN status = 'completed' THEN 'task.completed' ELSE 'task.failed' END ||
  '","job_id":null,"platform":"' || platform || '","raw_paths":' ||
  CASE WHEN status = 'completed' THEN '{{"html":"raw/' || id || '","pdf":"raw/p"}}' ELSE 'null' END || ',"result":' ||
  CASE WHEN status = 'completed' THEN '{{"amount":' || CAST(amount * 1000 AS VARCHAR) || ',"county":"Se\\u00f1or \\ud83d\\ude00 ' || county || '","priority":' || priority || ',"share":' || CAST(priority / 1e5 AS VARCHAR) || '}}' ELSE 'null' END ||
  ',"stats":null,"task_id":"' || id || '","timestamp":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}}' AS payload
  FROM tasks WHERE status <> 'pending')"""


@query(f"WITH {_OUTBOX_SQL} SELECT task_id, event, payload FROM o")
def notification_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return L.notification_outbox(_ended(spark, sf))


_DEMO_KEY = "demo-key"


def _pad_sql(mask: int) -> str:
    padded = _DEMO_KEY.encode().ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ mask:02X}" for b in padded) + "'::BLOB"


@query(
    f"""WITH {_OUTBOX_SQL} SELECT task_id,
  'sha256=' || sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(payload)))) AS signature,
  CAST(task_id AS BIGINT) % 10 <> 0 AS verified FROM o"""
)
def signed_outbox(spark: SparkSession, sf: str) -> DataFrame:
    signed = L.notification_outbox(_ended(spark, sf), _DEMO_KEY)
    # One payload in ten arrives changed.
    changed = F.col("task_id").cast("bigint") % 10 == 0
    arrived = F.when(changed, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    ok = verify(arrived, F.col("signature"), _DEMO_KEY)
    return signed.select("task_id", "signature", ok.alias("verified"))
