"""Driver tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.session import salted_join

SECOND = "yyyy-MM-dd HH:mm:ss"
MICRO = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def decoded_sql(html: str) -> str:
    """SQL that replaces the named entities of the test pages, cut-off ones included."""
    for entity, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("amp", "&")):
        html = f"regexp_replace({html}, '&{entity};?', '{char}', 'g')"
    return f"trim({html})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ts(text: str) -> Column:
    """Timestamp literal without time zone, as the tables store them."""
    return F.lit(text).cast("timestamp_ntz")


def text(ts: Column | str, pattern: str = SECOND) -> Column:
    return F.date_format(ts, pattern)


def by_value(column: Column, table: dict[str, object], default: object = None) -> Column:
    chain = F
    for key, value in table.items():
        chain = chain.when(column == key, F.lit(value))
    return chain.otherwise(F.lit(default))


STATUS = {"O": "pending", "P": "processing", "F": "completed"}
TASK_URL = "https://records.example.com/task/"
LINK_URL = "https://records.example.com/part/"
EVENT_ROLE = {"view": "started", "purchase": "succeeded", "error": "failed", "click": "signal", "signup": "sent"}
LOG_TYPE = {"view": "start", "purchase": "complete", "error": "fail", "signup": "retry"}
RELATION = {"A": "owner", "N": "parcel", "R": "neighbor"}
REGION_OF_EVENT = {"view": "AUTOMOBILE", "purchase": "BUILDING", "error": "FURNITURE", "click": "HOUSEHOLD", "signup": "MACHINERY"}


def customer_platform(spark: SparkSession, sf: str) -> DataFrame:
    customer = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return salted_join(customer, nation, ["c_nationkey"]).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("platform"), F.col("c_mktsegment").alias("county")
    )


def bare_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks, without platform and county: one narrow scan."""
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit(TASK_URL), F.col("o_orderkey").cast("string")).alias("url"),
        by_value(F.col("o_orderstatus"), STATUS).alias("status"),
        (6 - urgency).alias("priority"),
        F.least(urgency, F.lit(4)).alias("level"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate")).alias("last_scraped_at"),
        F.col("o_totalprice").alias("amount"),
        "o_custkey",
    )


def with_platform(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Add the nation and segment of the customer behind each task."""
    return salted_join(rows, customer_platform(spark, sf), ["o_custkey"]).drop("o_custkey")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return with_platform(spark, sf, bare_tasks(spark, sf))


_TASK_COLUMNS_SQL = f"""o_orderkey AS id, '{TASK_URL}' || o_orderkey AS url,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' WHEN 'F' THEN 'completed' END AS status,
    6 - CAST(left(o_orderpriority, 1) AS INT) AS priority,
    least(CAST(left(o_orderpriority, 1) AS INT), 4) AS level,
    o_orderdate AS created_at,
    CASE WHEN o_totalprice >= 50000 THEN o_orderdate END AS last_scraped_at,
    o_totalprice AS amount"""
BARE_TASKS_SQL = f"tasks AS (SELECT {_TASK_COLUMNS_SQL} FROM orders)"
TASKS_SQL = f"""tasks AS (
  SELECT {_TASK_COLUMNS_SQL}, n_name AS platform, c_mktsegment AS county
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as links from an order to a part."""
    relation = by_value(F.col("l_returnflag"), RELATION, "unknown")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("source_id"),
        F.concat(F.lit(LINK_URL), F.col("l_partkey").cast("string")).alias("url"),
        F.lit("parts").alias("platform"),
        relation.alias("relationship_type"),
        by_value(F.col("l_returnflag"), {"A": 5, "N": 2, "R": 1}, 0).alias("priority_delta"),
        F.col("l_shipdate").alias("added_at"),
        (F.col("l_linestatus") == "F").alias("processed"),
        F.col("l_linenumber").alias("position"),
    )


LINKS_SQL = f"""links AS (
  SELECT l_orderkey AS source_id, '{LINK_URL}' || l_partkey AS url, 'parts' AS platform,
    CASE l_returnflag WHEN 'A' THEN 'owner' WHEN 'N' THEN 'parcel' WHEN 'R' THEN 'neighbor' ELSE 'unknown' END
      AS relationship_type,
    CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS priority_delta,
    l_shipdate AS added_at, l_linestatus = 'F' AS processed, l_linenumber AS position
  FROM lineitem)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"),
        F.col("l_partkey").alias("child_id"),
        by_value(F.col("l_returnflag"), {"A": 5, "N": 2, "R": 1}, 0).alias("delta"),
    )


EDGES_SQL = """edges AS (
  SELECT l_orderkey AS parent_id, l_partkey AS child_id,
    CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS delta
  FROM lineitem)"""


def event_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(events: DataFrame) -> DataFrame:
    pace = F.when(F.col("value") < 5, "fast").when(F.col("value") < 15, "normal").otherwise("slow")
    return events.select(
        "event_id",
        "ts",
        by_value(F.col("event_type"), EVENT_ROLE).alias("type"),
        F.col("user_id").alias("worker"),
        F.col("value").alias("runtime"),
        pace.alias("task_type"),
        F.concat(F.lit("p"), F.floor(event_number() / 20).cast("string")).alias("platform"),
    )


TELEMETRY_SQL = """telemetry AS (
  SELECT event_id, ts,
    CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed'
      WHEN 'click' THEN 'signal' WHEN 'signup' THEN 'sent' END AS type,
    user_id AS worker, value AS runtime,
    CASE WHEN value < 5 THEN 'fast' WHEN value < 15 THEN 'normal' ELSE 'slow' END AS task_type,
    'p' || (CAST(json_extract_string(props, '$.k') AS INT) // 20) AS platform
  FROM events)"""


def event_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"),
        by_value(F.col("event_type"), LOG_TYPE).alias("type"), F.col("props").alias("detail"),
    )


LOG_SQL = """log AS (
  SELECT user_id AS id, ts, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail'
      WHEN 'signup' THEN 'retry' END AS type,
    props AS detail
  FROM events WHERE event_type <> 'click')"""


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as parcels, valued and visited as their orders tell."""
    orders = load(spark, sf, "orders")
    seen = orders.groupBy(F.col("o_custkey").alias("parcel_id")).agg(
        F.max("o_totalprice").alias("market_value"),
        F.max("o_orderdate").alias("last_scraped_at"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("last_viewed_at"),
    )
    customer = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("parcel_id"), F.col("c_name").alias("owner"), "c_nationkey",
        F.col("c_mktsegment").alias("county"), F.col("c_acctbal").alias("tax_due"),
    )
    nation = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        by_value(F.col("n_name"), {"NATION_3": "AZ", "NATION_4": "FL"}, "DEED").alias("state"),
    )
    return salted_join(customer, nation, ["c_nationkey"]).join(seen, ["parcel_id"], "left").drop("c_nationkey")


PARCELS_SQL = """parcels AS (
  SELECT c_custkey AS parcel_id, c_name AS owner, c_mktsegment AS county, c_acctbal AS tax_due,
    CASE n_name WHEN 'NATION_3' THEN 'AZ' WHEN 'NATION_4' THEN 'FL' ELSE 'DEED' END AS state,
    market_value, last_scraped_at, last_viewed_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS market_value, max(o_orderdate) AS last_scraped_at,
      max(o_orderdate) FILTER (WHERE o_orderpriority = '1-URGENT') AS last_viewed_at
    FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def liens(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("parcel_id"), F.col("l_suppkey").alias("investor_id"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("active"),
    )


LIENS_SQL = """liens AS (
  SELECT l_partkey AS parcel_id, l_suppkey AS investor_id, l_linestatus = 'O' AND l_quantity > 40 AS active
  FROM lineitem)"""


def auctions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))
        .select(F.col("l_partkey").alias("parcel_id"), F.col("l_shipdate").alias("released_at"))
    )


AUCTIONS_SQL = """auctions AS (
  SELECT l_partkey AS parcel_id, l_shipdate AS released_at FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity >= 49)"""
