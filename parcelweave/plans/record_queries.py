"""Driver queries over records: mapping, validation, upserts, content and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions.transforms import register_transform, timestamp_from, title_case, transform_column
from parcelweave.functions.validators import register_rule
from parcelweave.operators import content as C
from parcelweave.operators import mapping as M
from parcelweave.operators import pages as P
from parcelweave.operators import upsert as U
from parcelweave.operators import validation as V
from parcelweave.plans.bulk import bulk_load as run_bulk_load
from parcelweave.plans.registry import query
from parcelweave.plans.tables import SECOND, load, text
from parcelweave.session import fresh_dir, salted_join, spread_small
from parcelweave.sources import files, sinks

# --- mapping and transforms ---------------------------------------------------------------

CUSTOMER_FIELDS = {
    "parcel_id": {"source": "raw_id", "transform": "clean_parcel_id"},
    "owner_name": {"source": "raw_owner", "transform": "normalize_name"},
    "balance": {"source": "raw_balance", "transform": "to_decimal"},
    "cents": {"source": "raw_balance", "transform": "to_integer"},
    "segment": {"source": "c_mktsegment", "transform": "lowercase"},
    "segment_up": {"source": "c_mktsegment", "transform": "uppercase"},
    "padded": {"source": "padded", "transform": "trim"},
    "label": {"source": "c_mktsegment", "transform": "concat", "with": ["USA", "2024"], "separator": "/"},
    "pieces": {"source": "raw_id", "transform": "split", "delimiter": "#"},
    "name_digits": {"source": "c_name", "transform": "regex_extract", "pattern": r"#0*(\d+)$"},
    "unmatched": {"source": "c_name", "transform": "regex_extract", "pattern": r"zzz(\d+)"},
    "filled": {"source": "blank", "transform": "default_if_empty", "default": "none"},
    "county": {"const": "Columbia"},
    "missing": {"source": "not_there", "default": "n/a"},
    "titled": {"source": "raw_owner", "transform": "title"},
}


@query(
    r"""
SELECT c_custkey, 'CUSTOMER' || substr(c_name, 10) AS parcel_id,
  'O''Brien Mc-' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS owner_name,
  c_acctbal AS balance,
  CAST(regexp_replace(printf('%.2f', c_acctbal), '[^0-9-]', '', 'g') AS BIGINT) AS cents,
  lower(c_mktsegment) AS segment, upper(c_mktsegment) AS segment_up, c_name AS padded,
  c_mktsegment || '/USA/2024' AS label,
  'APN: Customer|' || substr(c_name, 10) || '_' AS pieces,
  CASE WHEN regexp_matches(c_name, '#0*[0-9]+$') THEN regexp_extract(c_name, '#0*([0-9]+)$', 1) ELSE c_name END AS name_digits,
  c_name AS unmatched, 'none' AS filled, 'Columbia' AS county, 'n/a' AS missing,
  'O''Brien   Mc-' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Llc.' AS titled
FROM customer"""
)
def mapped_customers(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.concat(F.lit("APN: "), "c_name", F.lit("_")).alias("raw_id"),
        F.concat(F.lit("o'BRIEN   mc-"), "c_mktsegment", F.lit(" LLC.")).alias("raw_owner"),
        F.concat(F.lit("$"), F.format_number("c_acctbal", 2)).alias("raw_balance"),
        F.concat(F.lit(" \t"), "c_name", F.lit(" \n")).alias("padded"),
        F.lit("").alias("blank"),
    )
    mapped = M.apply_mapping(raw, CUSTOMER_FIELDS, keep=["c_custkey"])
    # clean_parcel_id turns the trailing underscore into a dash; drop it for comparison.
    return mapped.withColumn("pieces", F.array_join("pieces", "|")).withColumn(
        "parcel_id", F.regexp_replace("parcel_id", "-$", "")
    )


@query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%d %B %Y') AS kept,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS typed
FROM orders"""
)
def mapped_order_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "M/d/yyyy").alias("short"),
        F.date_format("o_orderdate", "dd MMMM yyyy").alias("long"),
    )
    return raw.select(
        "o_orderkey",
        transform_column("to_date", F.col("short"), {"format": "%m/%d/%Y"}).alias("iso"),
        transform_column("to_date", F.col("long"), {"format": "%m/%d/%Y"}).alias("kept"),
        text(timestamp_from(F.col("long"), "%d %B %Y"), SECOND).alias("typed"),
    )


@query(
    r"""
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+'),
  lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || substr(w, 2)), '')) AS titled_md5
FROM documents"""
)
def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title case over whole texts."""
    docs = spread_small(load(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(title_case(F.col("text"))).alias("titled_md5"))


PART_PROFILE = M.BulkProfile(
    mappings={"p_partkey": "parcel_id", "p_name": "name", "p_size": "size", "p_retailprice": "price", "size_text": "size_number", "flag": "is_open", "price_text": "price_number"},
    transforms={"parcel_id": "to_string", "name": "uppercase", "size": "to_float", "price": "to_int", "size_number": "to_int", "is_open": "to_bool", "price_number": "to_float"},
    constants={"county": "Columbia", "state": "FL", "p_type": "never used"},
    composites={"brand_type": ["p_brand", "p_type"]},
    required=["parcel_id", "county", "state"],
    key=["parcel_id", "county", "state"],
)


def _bulk_source(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        "*",
        F.when(F.col("p_size") > 25, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("size_text"),
        F.when(F.col("p_type") == "SMALL", "Yes").when(F.col("p_type") == "ECONOMY", "1").otherwise("no").alias("flag"),
        F.col("p_retailprice").cast("string").alias("price_text"),
    )


@query(
    """
SELECT CAST(p_partkey AS VARCHAR) AS parcel_id, upper(p_name) AS name, CAST(p_size AS DOUBLE) AS size,
  CAST(floor(p_retailprice) AS BIGINT) AS price,
  CASE WHEN p_size <= 25 THEN CAST(p_size AS BIGINT) END AS size_number,
  p_type IN ('SMALL', 'ECONOMY') AS is_open, p_retailprice AS price_number,
  p_brand || ' ' || p_type AS brand_type, p_brand, p_type, 'Columbia' AS county, 'FL' AS state
FROM part"""
)
def bulk_mapped_parts(spark: SparkSession, sf: str) -> DataFrame:
    return M.bulk_map(_bulk_source(spark, sf), PART_PROFILE)


@query(
    """
WITH existing AS (SELECT CAST(s_suppkey AS VARCHAR) AS parcel_id, 'Columbia' AS county, 'FL' AS state, s_name AS name,
    s_acctbal AS balance FROM supplier),
fresh AS (SELECT CAST(p_partkey AS VARCHAR) AS parcel_id, 'Columbia' AS county, 'FL' AS state, upper(p_name) AS name,
    CAST(p_size AS DOUBLE) AS size FROM part WHERE p_size >= 5)
SELECT coalesce(f.parcel_id, e.parcel_id) AS parcel_id, 'Columbia' AS county, 'FL' AS state,
  CASE WHEN f.parcel_id IS NOT NULL THEN f.name ELSE e.name END AS name, e.balance, f.size
FROM existing e FULL JOIN fresh f USING (parcel_id)"""
)
def bulk_load(spark: SparkSession, sf: str) -> DataFrame:
    """Parts loaded over suppliers: mapped, checked, deduplicated and merged."""
    existing = load(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("parcel_id"), F.lit("Columbia").alias("county"), F.lit("FL").alias("state"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
    )
    source = load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    profile = M.BulkProfile(
        mappings={"p_partkey": "parcel_id", "p_name": "name", "p_size": "size"},
        transforms={"parcel_id": "to_string", "name": "uppercase", "size": "to_float"},
        constants={"county": "Columbia", "state": "FL"}, required=["parcel_id"], key=U.PARCEL_KEY,
    )
    return run_bulk_load(source, existing, profile, ["name"], {"fields": {"size": {"min_value": 5}}}).merged


@query(
    """
SELECT c_custkey, n_name, c_mktsegment,
  CASE WHEN n_regionkey <= 2 THEN 'sel_' || n_name ELSE 'sel_default' END AS selector,
  CASE WHEN n_regionkey <= 2 AND n_regionkey > 0 THEN CAST(n_nationkey AS INT) ELSE 7 END AS delay
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def county_overrides(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation")
    overrides = nation.where(F.col("n_regionkey") <= 2).select(
        "n_name", F.concat(F.lit("sel_"), "n_name").alias("selector"),
        F.when(F.col("n_regionkey") > 0, F.col("n_nationkey")).alias("delay"),
    )
    named = load(spark, sf, "customer").join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    rows = named.select("c_custkey", "n_name", "c_mktsegment")
    return M.resolve_overrides(rows, overrides, ["n_name"], {"selector": "sel_default", "delay": 7})


@query(
    """
WITH h AS (SELECT DISTINCT p_name AS header, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS bare FROM part),
t AS (SELECT unnest(['red_gear', 'blue_bolt', 'hot_ring', 'widget']) AS target),
d AS (SELECT header, target, levenshtein(bare, replace(target, '_', '')) AS distance FROM h, t),
r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY distance, target) AS rn FROM d)
SELECT header, target, CAST(distance AS BIGINT) AS distance FROM r WHERE rn = 1"""
)
def column_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    headers = load(spark, sf, "part").select(F.col("p_name").alias("header"))
    return M.suggest_mapping(headers, ["red_gear", "blue_bolt", "hot_ring", "widget"])


@query("SELECT p_partkey AS parcel_id, p_brand, p_size FROM part")
def normalized_headers(spark: SparkSession, sf: str) -> DataFrame:
    named = load(spark, sf, "part").select(F.col("p_partkey").alias("PIN"), "p_brand", "p_size")
    return M.normalize_columns(named)


@query(
    """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE nullif(c_mktsegment, 'MACHINERY') END,
  CASE WHEN length(c_name) >= 6 THEN c_name END, 'unknown') AS record_id
FROM customer"""
)
def resolve_record_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").select(
        "c_custkey", F.lit("").alias("parcel_id"),
        F.when(F.col("c_acctbal") >= 0, F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))).alias("apn"),
        F.lit("ab1").alias("short"), F.col("c_name").alias("name"),
    )
    return rows.select("c_custkey", P.resolve_record_id(rows.columns, ["short", "name"]).alias("record_id"))


@query(
    """
WITH c AS (SELECT c_custkey, c_nationkey - 12 AS lat, c_custkey % 90 AS lon, c_mktsegment || ' St, ' || c_custkey AS address
  FROM customer)
SELECT c_custkey,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'https://www.google.com/maps?q=' || lat || '.5,' || lon || '.25' END AS google_maps,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=' || lat || '.5,' || lon || '.25' END AS street_view,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'https://www.bing.com/maps?cp=' || lat || '.5~' || lon || '.25&lvl=17' END AS bing_maps,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'https://maps.apple.com/?ll=' || lat || '.5,' || lon || '.25' END AS apple_maps,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'https://www.google.com/maps/search/' || replace(replace(address, ' ', '+'), ',', '') END AS search
FROM c"""
)
def map_links(spark: SparkSession, sf: str) -> DataFrame:
    from parcelweave.functions import urls

    lat = F.col("c_nationkey") - 12
    lon = F.col("c_custkey") % 90
    rows = load(spark, sf, "customer").select(
        "c_custkey",
        F.when(lat != 0, F.concat(lat.cast("string"), F.lit(".5"))).otherwise("0").alias("lat"),
        F.when(lon != 0, F.concat(lon.cast("string"), F.lit(".25"))).otherwise("0").alias("lng"),
        F.concat("c_mktsegment", F.lit(" St, "), F.col("c_custkey").cast("string")).alias("address"),
    )
    links = urls.map_links(urls.first_number([F.col("lat")]), urls.first_number([F.col("lng")]), F.col("address"))
    built = rows.select("c_custkey", links.alias("m"))
    names = {"google_maps": "google_maps", "street_view": "google_street_view", "bing_maps": "bing_maps", "apple_maps": "apple_maps", "search": "google_maps_address"}
    return built.select("c_custkey", *[F.col("m")[key].alias(name) for name, key in names.items()])


# --- validation ---------------------------------------------------------------------------

RULES = {
    "required": ["name", "segment"],
    "fields": {
        "name": {"pattern": r"Customer#\d+5$", "min_length": 18, "max_length": 30},
        "balance": {"min_value": 0, "max_value": 9000},
        "segment": {"required": True, "enum": ["BUILDING", "FURNITURE", "MACHINERY"]},
        "email": {"email": True},
        "site": {"url": True},
        "phone": {"phone": True},
    },
}


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return load(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 9500, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.concat(key, F.when(F.col("c_nationkey") > 20, "_at_").otherwise("@"), F.lit("mail.example")).alias("email"),
        F.concat(F.when(F.col("c_nationkey") == 7, "ftp").otherwise("https"), F.lit("://example.com/"), key).alias("site"),
        F.when(F.col("c_nationkey") == 9, F.lit(None)).otherwise(F.concat(F.lit("+1 (555) "), key, F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(""))).alias("phone"),
    )


_CHECKED_SQL = r"""
c AS (SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal > 9500 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS balance,
  CASE WHEN c_nationkey = 0 THEN '' ELSE c_mktsegment END AS segment, c_nationkey AS n, c_mktsegment AS seg FROM customer),
checked AS (SELECT c_custkey, list_filter([
  CASE WHEN name IS NULL OR name = '' THEN 'Missing required field: name' END,
  CASE WHEN segment IS NULL OR segment = '' THEN 'Missing required field: segment' END,
  CASE WHEN NOT regexp_matches(name, '^Customer#[0-9]+5$') THEN 'Field ''name'' does not match pattern' END,
  CASE WHEN length(name) < 18 THEN 'Field ''name'' must be at least 18 characters' END,
  CASE WHEN length(name) > 30 THEN 'Field ''name'' must be at most 30 characters' END,
  CASE WHEN TRY_CAST(balance AS DOUBLE) IS NULL THEN 'Field ''balance'' must be a number'
    WHEN CAST(balance AS DOUBLE) < 0 THEN 'Field ''balance'' must be at least 0' END,
  CASE WHEN TRY_CAST(balance AS DOUBLE) IS NULL THEN 'Field ''balance'' must be a number'
    WHEN CAST(balance AS DOUBLE) > 9000 THEN 'Field ''balance'' must be at most 9000' END,
  CASE WHEN segment = '' THEN 'Field ''segment'' is required' END,
  CASE WHEN segment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY')
    THEN 'Field ''segment'' must be one of: [''BUILDING'', ''FURNITURE'', ''MACHINERY'']' END,
  CASE WHEN n > 20 THEN 'Field ''email'' must be a valid email' END,
  CASE WHEN n = 7 THEN 'Field ''site'' must be a valid URL' END,
  CASE WHEN n <> 9 AND seg = 'BUILDING' THEN 'Field ''phone'' must be a valid phone number' END],
  lambda e: e IS NOT NULL) AS errors FROM c)"""


@query(f"WITH {_CHECKED_SQL} SELECT c_custkey, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM checked")
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    checked = V.validate_records(_contacts(spark, sf), RULES)
    return checked.select("c_custkey", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(f"WITH {_CHECKED_SQL} SELECT error, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(errors) AS error FROM checked) GROUP BY 1")
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return V.validation_summary(V.validate_records(_contacts(spark, sf), RULES))


@query(f"WITH {_CHECKED_SQL} SELECT c_custkey, CASE WHEN len(errors) = 0 THEN 'good' ELSE 'quarantined' END AS part, array_to_string(errors, '; ') AS reason FROM checked")
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = V.quarantine(V.validate_records(_contacts(spark, sf), RULES))
    kept = good.select("c_custkey", F.lit("good").alias("part"), F.lit("").alias("reason"))
    return kept.unionAll(bad.select("c_custkey", F.lit("quarantined"), F.array_join("errors", "; ")))


@query(f"WITH {_CHECKED_SQL} SELECT c_custkey, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0")
def quarantine_written(spark: SparkSession, sf: str) -> DataFrame:
    """Records written once, good and bad apart; the bad ones are read back."""
    path = fresh_dir(spark, "checked")
    sinks.write_checked(V.validate_records(_contacts(spark, sf), RULES), path)
    _, bad = sinks.read_checked(spark, path)
    return bad.select("c_custkey", F.array_join("errors", "; ").alias("errors"))


@query(
    f"""WITH {_CHECKED_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(errors) > 0) AS bad FROM checked)
SELECT CAST(n AS BIGINT) AS total_rows, CAST(n - bad AS BIGINT) AS inserted_rows, CAST(n AS BIGINT) AS processed_rows,
  CAST(bad AS BIGINT) AS error_rows, CAST(100.0 AS DOUBLE) AS progress_percent, 'completed' AS status FROM s"""
)
def bulk_job_report(spark: SparkSession, sf: str) -> DataFrame:
    return V.bulk_job_report(V.validate_records(_contacts(spark, sf), RULES))


@query(
    """
SELECT c_custkey, concat_ws(';', CASE WHEN c_mktsegment = 'FURNITURE' THEN 'parcel_id' END,
  CASE WHEN c_nationkey = 0 THEN 'county' END, 'state') AS missing FROM customer"""
)
def key_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_name")).alias("parcel_id"),
        F.when(F.col("c_nationkey") > 0, F.col("c_mktsegment")).alias("county"),
    )
    missing = U.missing_key_fields(U.PARCEL_KEY, rows.columns)
    return rows.select("c_custkey", F.array_join(missing, ";").alias("missing"))


# --- upsert -------------------------------------------------------------------------------


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), "p_size"
    )


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Latest line item per supplier as the new state of the part with the supplier's number."""
    items = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("name"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("shipped"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    latest = U.last_write_wins(items, ["id"], ["shipped", "l_orderkey", "l_linenumber", "l_partkey", "price"])
    return latest.select("id", "name", "price", "shipped")


_UPSERT_SQL = """
existing AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size FROM part),
ranked AS (SELECT l_suppkey AS id, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS name, l_extendedprice AS price,
    l_shipdate AS shipped, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem),
changes AS (SELECT id, name, price, shipped FROM ranked WHERE rn = 1)"""


@query(f"WITH {_UPSERT_SQL} SELECT id, name, price, strftime(shipped, '%Y-%m-%d %H:%M:%S') AS shipped FROM changes")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).withColumn("shipped", text("shipped"))


@query(
    f"""WITH {_UPSERT_SQL} SELECT id, name, price, p_size FROM existing WHERE id NOT IN (SELECT id FROM changes)
UNION ALL SELECT id, name, price, NULL FROM changes"""
)
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    return U.upsert(_existing(spark, sf), _changes(spark, sf).drop("shipped"), ["id"], "replace")


@query(
    f"""WITH {_UPSERT_SQL} SELECT coalesce(c.id, e.id) AS id,
  CASE WHEN c.id IS NOT NULL THEN c.name ELSE e.name END AS name,
  CASE WHEN c.id IS NOT NULL THEN c.price ELSE e.price END AS price, e.p_size,
  strftime(c.shipped, '%Y-%m-%d %H:%M:%S') AS shipped
FROM existing e FULL JOIN changes c ON c.id = e.id"""
)
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = U.upsert(_existing(spark, sf), _changes(spark, sf), ["id"], "merge")
    return merged.withColumn("shipped", text("shipped"))


@query(
    f"""WITH {_UPSERT_SQL} SELECT coalesce(c.id, e.id) AS id, coalesce(c.name, e.name) AS name,
  coalesce(c.price, e.price) AS price, e.p_size FROM existing e FULL JOIN changes c ON c.id = e.id"""
)
def upsert_merge_ignore_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return U.upsert_merge(_existing(spark, sf), _changes(spark, sf).drop("shipped"), ["id"], ignore_nulls=True)


@query(
    """
SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'updated' ELSE 'inserted' END AS action
FROM customer"""
)
def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    new = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return U.batch_upsert(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), new, ["id"])


@query(
    """
SELECT CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS action, CAST(count(*) AS BIGINT) AS n
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN supplier ON o_custkey = s_suppkey GROUP BY 1"""
)
def upsert_action_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders give many new rows per key: they are reduced to one before they are labelled."""
    new = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey")
    latest = U.last_write_wins(new, ["id"], ["o_orderdate", "o_orderkey"])
    known = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return U.action_counts(U.batch_upsert(known, latest, ["id"]))


@query(
    """
SELECT c_custkey || '|' || c_mktsegment || '|' || n_name AS record_key, c_acctbal FROM customer
JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY'"""
)
def business_keys(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    rows = load(spark, sf, "customer").join(nation, ["c_nationkey"]).select(
        F.col("c_custkey").alias("parcel_id"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("county"), "state", "c_acctbal"
    )
    return U.apply_profile_key(rows).select("record_key", "c_acctbal")


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(n AS BIGINT) AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1"""
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return U.detect_duplicates(items, ["l_orderkey", "l_linenumber"])


@query(
    """
SELECT coalesce(CAST(o_custkey AS VARCHAR), '') || '|' || coalesce(o_orderpriority, '') || '|' AS record_key,
  CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1"""
)
def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    key = U.compute_key(["o_custkey", "o_orderpriority", "absent"], orders.columns)
    return orders.groupBy(key.alias("record_key")).agg(F.count("*").alias("n"))


@query(
    """
WITH r AS (SELECT c_custkey AS id, 'assessor' AS kind, c_name AS owner, CAST(NULL AS DOUBLE) AS amount FROM customer
  UNION ALL SELECT o_custkey, 'tax', CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_totalprice FROM orders
  UNION ALL SELECT s_suppkey, 'recorder', s_name, s_acctbal FROM supplier)
SELECT id, bool_or(kind = 'tax') AS has_tax, bool_or(kind = 'assessor') AS has_assessor,
  bool_or(kind = 'recorder') AS has_recorder, bool_or(kind = 'gis') AS has_gis,
  coalesce(min(owner) FILTER (WHERE kind = 'tax'), min(owner) FILTER (WHERE kind = 'assessor'),
    min(owner) FILTER (WHERE kind = 'recorder')) AS owner,
  coalesce(min(amount) FILTER (WHERE kind = 'tax'), min(amount) FILTER (WHERE kind = 'recorder')) AS amount
FROM r GROUP BY id"""
)
def consolidated_parcels(spark: SparkSession, sf: str) -> DataFrame:
    assessor = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("assessor").alias("kind"), F.col("c_name").alias("owner"),
        F.lit(None).cast("double").alias("amount"),
    )
    tax = load(spark, sf, "orders").select(
        F.col("o_custkey"), F.lit("tax"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), "o_totalprice"
    )
    recorder = load(spark, sf, "supplier").select("s_suppkey", F.lit("recorder"), "s_name", "s_acctbal")
    rows = assessor.unionAll(tax).unionAll(recorder)
    return U.consolidate_sources(rows, ["id"], "kind", ["tax", "assessor", "recorder", "gis"], ["owner", "amount"])


# --- content ------------------------------------------------------------------------------


@query(
    """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies,
  CAST(length(any_value(text)) AS BIGINT) AS chars FROM documents GROUP BY 1"""
)
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    stored = C.distinct_content(load(spark, sf, "documents"), "doc_id", "text")
    return stored.select("content_hash", "doc_id", "copies", F.length("text").cast("bigint").alias("chars"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_map(spark: SparkSession, sf: str) -> DataFrame:
    return C.content_map(load(spark, sf, "documents"), "doc_id", "text")


@query(
    """
SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(DISTINCT text) AS BIGINT) AS distinct_files,
  round(1 - count(DISTINCT text) / count(*), 6) AS dedupe_rate FROM documents"""
)
def dedupe_rate(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedupe_rate(load(spark, sf, "documents"), "text")


@query(
    r"""
WITH p AS (SELECT page_id, sha256(html) AS h, CAST(strlen(html) AS BIGINT) AS size_bytes,
  nullif(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/(.*)$', 1), '') AS raw_id,
  regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
q AS (SELECT *, 'raw/1/' || scheme || '/' || host || '/' || coalesce(regexp_replace(raw_id, '[/\\<>:"|?*]', '_', 'g'),
    '20240102T030405_' || h) AS full_path FROM p)
SELECT page_id, h AS sha256, size_bytes,
  CASE WHEN length(full_path) > 255 THEN 'raw/' || sha256(full_path) ELSE full_path END AS parcel_dir,
  raw_id IS NULL AS id_missing
FROM q"""
)
def raw_manifest(spark: SparkSession, sf: str) -> DataFrame:
    page = load(spark, sf, "pages").select(
        "page_id", "html", F.lit("1").alias("tier"),
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+/(.*)$", 1).alias("raw_id"),
        F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("saved_at"),
    )
    manifest = C.raw_manifest(page, "raw", ["tier", "scheme", "host"], "raw_id", "html", "saved_at")
    return manifest.select("page_id", "sha256", "size_bytes", "parcel_dir", "id_missing")


# --- sources and sinks --------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two column orders, read by name."""
    path = fresh_dir(spark, "csv")
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    part = load(spark, sf, "part")
    odd = F.col("p_partkey") % 2 == 1
    part.where(odd).select(*columns).write.option("header", True).csv(f"{path}/a")
    part.where(~odd).select(*columns[::-1]).write.option("header", True).csv(f"{path}/b")
    rows = files.read_csv_source(spark, [f"{path}/a", f"{path}/b"], columns=columns, by_name=True)
    profile = M.BulkProfile(
        mappings={c: c for c in columns},
        transforms={"p_partkey": "to_int", "p_size": "to_int", "p_retailprice": "to_float"},
    )
    return M.bulk_map(rows, profile)


@query(
    """SELECT CAST(4 AS BIGINT) AS columns, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (WHERE s_nationkey = 7) AS BIGINT) AS wide_rows,
  count(*) FILTER (WHERE s_nationkey = 7) = 0 AND count(*) > 0 AS is_valid FROM supplier"""
)
def csv_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one nation have a field too many."""
    path = fresh_dir(spark, "csv")
    fields = F.concat_ws(";", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    lines = load(spark, sf, "supplier").select(F.concat(fields, F.when(F.col("s_nationkey") == 7, ";extra").otherwise("")).alias("value"))
    header = "s_suppkey;s_name;s_nationkey;s_acctbal"
    lines.select(F.col("value").alias(header)).write.options(header=True, quote="", maxRecordsPerFile=200_000, sep="\u0001").csv(path)
    return files.csv_profile(spark, path, delimiter=";")


@query(
    """
SELECT o_orderkey AS "order.key", o_orderpriority AS "order.meta.priority", o_custkey, o_totalprice AS price FROM orders"""
)
def jsonl_source(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "jsonl")
    load(spark, sf, "orders").select(
        F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderpriority").alias("priority")).alias("meta")).alias("order"),
        "o_custkey", F.col("o_totalprice").alias("price"),
    ).write.json(path)
    return files.read_json_source(spark, path, "lines", ORDER_LINES, flatten=True)


ORDER_LINES = "order struct<key:bigint,meta:struct<priority:string>>, o_custkey bigint, price double"


@query(
    """SELECT CAST(count(*) FILTER (WHERE o_orderkey % 10 <> 3) AS BIGINT) AS rows,
  CAST(sum(o_totalprice) FILTER (WHERE o_orderkey % 10 <> 3) AS DECIMAL(20, 2)) AS price,
  CAST(count(*) FILTER (WHERE o_orderkey % 10 = 3) AS BIGINT) AS bad_lines,
  CAST(sum(o_orderkey) FILTER (WHERE o_orderkey % 10 = 3) AS BIGINT) AS bad_keys FROM orders"""
)
def jsonl_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth line is cut off: the rest is read, the cut ones are kept and counted."""
    path = fresh_dir(spark, "jsonl")
    line = F.to_json(
        F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("order"), "o_custkey", F.col("o_totalprice").alias("price"))
    )
    cut = F.when(F.col("o_orderkey") % 10 == 3, F.substring(line, 1, 30)).otherwise(line)
    load(spark, sf, "orders").select(cut.alias("value")).write.text(path)
    rows, rejects = files.split_json_lines(spark, path, ORDER_LINES)
    key = F.regexp_extract("line", r'"key":(\d+)', 1).cast("bigint")
    both = rows.select(F.col("price").cast("decimal(12,2)").alias("price"), F.lit(None).cast("bigint").alias("bad_key"), F.lit(False).alias("bad"))
    both = both.unionAll(rejects.select(F.lit(None).cast("decimal(12,2)"), key, F.lit(True)))
    return both.agg(
        F.count_if(~F.col("bad")).alias("rows"),
        F.sum("price").cast("decimal(20,2)").alias("price"),
        F.count_if("bad").alias("bad_lines"),
        F.sum("bad_key").alias("bad_keys"),
    )


@query(
    """
SELECT c_custkey AS parcel, c_name AS owner, CASE WHEN c_custkey <> 0 THEN CAST(c_custkey AS VARCHAR) END AS feature_id,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) + 0.5 END AS longitude,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS latitude
FROM customer"""
)
def geojson_source(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "geojson")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), (F.col("c_nationkey") + 0.5).cast("double").cast("string"), F.lit(","), F.col("c_acctbal").cast("string"), F.lit("]}"))
    shape = F.when(F.col("c_mktsegment") == "BUILDING", F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')).otherwise(point)
    line = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","id":'), F.col("c_custkey").cast("string"),
        F.lit(',"geometry":'), shape, F.lit(',"properties":'),
        F.to_json(F.struct(F.col("c_custkey").alias("parcel"), F.col("c_name").alias("owner"))), F.lit("}]}"),
    )
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return files.read_geojson(spark, path, "parcel bigint, owner string", lines=True)


def _documents(items: DataFrame, key: str, before: str, after: str, path: str) -> None:
    """Items (key, json) as files that hold one document each, of at most 5000 items."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(key, "json"))), lambda item: item["json"])
    files_of = items.groupBy((F.col(key) / 5000).cast("bigint").alias("part"))
    text = F.concat(F.lit(before), F.array_join(ordered, ",\n  "), F.lit(after))
    files_of.agg(text.alias("value")).write.partitionBy("part").text(path)


@query("""SELECT o_orderkey AS "order.key", 'a } "quoted" ] \\ ' || o_orderpriority AS "order.note", o_totalprice AS price FROM orders""")
def json_array_source(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of orders over many lines, with brackets, quotes and backslashes in their strings."""
    path = fresh_dir(spark, "json")
    note = F.concat(F.lit('a } "quoted" ] \\ '), "o_orderpriority")
    order = F.struct(F.col("o_orderkey").alias("key"), note.alias("note"))
    body = F.to_json(F.struct(order.alias("order"), F.col("o_totalprice").alias("price")))
    items = load(spark, sf, "orders").select("o_orderkey", body.alias("json"))
    _documents(items, "o_orderkey", "[\n  ", "\n]\n", path)
    schema = "order struct<key:bigint,note:string>, price double"
    return files.read_json_source(spark, path, "array", schema, flatten=True)


@query(
    """SELECT s_suppkey AS parcel, s_name AS owner, 'S' || s_suppkey AS feature_id,
  CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) + 0.5 END AS longitude,
  CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END AS latitude FROM supplier"""
)
def geojson_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Collections whose features are cut out between other members that hold objects too."""
    path = fresh_dir(spark, "geojson")
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', (F.col("s_nationkey") + 0.5).cast("double").cast("string"), F.col("s_acctbal").cast("string"))
    shape = F.when(F.col("s_nationkey") % 2 == 0, point).otherwise('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    body = F.concat(
        F.lit('{"type":"Feature","id":"S'), F.col("s_suppkey").cast("string"), F.lit('",\n"geometry":'), shape, F.lit(',"properties":'),
        F.to_json(F.struct(F.col("s_suppkey").alias("parcel"), F.col("s_name").alias("owner"))), F.lit("}"),
    )
    before = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"x"}},\n"features": ['
    _documents(load(spark, sf, "supplier").select("s_suppkey", body.alias("json")), "s_suppkey", before, '],"notes":[{"n":{"m":1}},{"n":2}]}', path)
    return files.read_geojson(spark, path, "parcel bigint, owner string")


@query(
    """
SELECT sha256(url) AS id, url, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'web' END AS platform,
  'pending' AS status, CAST(page_id % 7 AS INT) AS priority, CAST(0 AS INT) AS retry_count
FROM pages"""
)
def seed_frontier(spark: SparkSession, sf: str) -> DataFrame:
    from parcelweave.operators.frontier import new_tasks

    path = f"{fresh_dir(spark, 'seeds')}.jsonl"
    load(spark, sf, "pages").select(
        "url", F.when(F.col("url").startswith("https"), "secure").alias("platform"), (F.col("page_id") % 7).alias("priority")
    ).write.json(path)
    seeds = files.seed_load(spark, path, "web", schema="url string, platform string, priority bigint")
    return new_tasks(seeds, F.lit("2024-01-01").cast("timestamp_ntz"), F.col("priority")).drop("created_at")


@query(
    """
WITH r AS (SELECT o_orderpriority AS platform, 'bulk_' || o_custkey AS id, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT platform, id, o_orderkey, o_totalprice FROM r WHERE rn = 1"""
)
def results_written(spark: SparkSession, sf: str) -> DataFrame:
    """Results written by platform, newest per id, and read back."""
    path = fresh_dir(spark, "results")
    records = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("platform"),
        sinks.result_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"),
        "o_orderkey", "o_totalprice", "o_orderdate",
    )
    sinks.write_results(records, path, ["o_orderdate", "o_orderkey"])
    back = spark.read.option("basePath", path).parquet(path)
    return back.select("platform", "id", "o_orderkey", "o_totalprice")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_orderpriority AS platform, 'bulk_' || o_custkey AS id, o_orderkey FROM r
WHERE rn = 1 AND o_custkey IN (0, 3) AND o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def result_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Single results by platform and id, out of all that were written."""
    path = fresh_dir(spark, "results")
    records = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("platform"),
        sinks.result_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"),
        "o_orderkey", "o_orderdate",
    )
    sinks.write_results(records, path, ["o_orderdate", "o_orderkey"])
    found = [
        sinks.read_result(spark, path, platform, record_id).select("platform", "id", "o_orderkey")
        for platform in ("1-URGENT", "2-HIGH")
        for record_id in ("bulk_0", "bulk_3")
    ]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def appended_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one CSV sink, read back."""
    path = fresh_dir(spark, "appended")
    supplier = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    for half in (0, 1):
        sinks.append_csv_sink(supplier.where(F.col("s_suppkey") % 2 == half), path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").csv(path)


@query("SELECT c_mktsegment AS folder, count(DISTINCT c_custkey % 4) AS files, true AS sized FROM customer GROUP BY 1")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a tree by folder, listed without reading them."""
    path = fresh_dir(spark, "tree")
    parted = load(spark, sf, "customer").withColumn("part", F.col("c_custkey") % 4)
    # Rows of a folder and part meet in one task, which writes one file of them.
    parted.repartition("c_mktsegment", "part").write.partitionBy("c_mktsegment", "part").csv(path)
    listed = files.list_source_files(spark, path, "*.csv", recursive=True)
    folder = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1).alias("folder")
    return listed.groupBy(folder).agg(F.count("*").alias("files"), F.min(F.col("length") > 0).alias("sized"))


@query(
    """SELECT o_orderkey, CASE WHEN age >= 365 THEN 'archive' WHEN age >= 30 THEN 'compress' ELSE 'keep' END AS class
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS age FROM orders)"""
)
def retention_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Orders rewritten by retention class, each class with its codec."""
    path = fresh_dir(spark, "retention")
    as_of = F.lit("2001-08-02").cast("timestamp_ntz")
    sinks.rewrite_by_retention(load(spark, sf, "orders"), "o_orderdate", as_of, path)
    return spark.read.parquet(path).select("o_orderkey", "class")


@query(
    """SELECT c_custkey, upper(reverse(c_name)) || '!' AS shouted,
  CASE WHEN c_custkey % 2 = 1 THEN 'Field ''c_custkey'' must be even' ELSE '' END AS errors FROM customer"""
)
def registered_extensions(spark: SparkSession, sf: str) -> DataFrame:
    """A transform and a rule of the user's own, used by name like the built-in ones."""
    register_transform("shout_backwards", lambda value, config: F.concat(F.upper(F.reverse(value)), F.lit(config.get("mark", ""))))
    register_rule("even", lambda field, value, wanted: F.when(value % 2 != 0, F.lit(f"Field '{field}' must be even")))
    shouted = transform_column("shout_backwards", F.col("c_name"), {"mark": "!"})
    rows = load(spark, sf, "customer").select("c_custkey", shouted.alias("shouted"))
    checked = V.validate_records(rows, {"fields": {"c_custkey": {"even": True}}})
    return checked.select("c_custkey", "shouted", F.array_join("errors", "; ").alias("errors"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def source_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return files.source_row_count(load(spark, sf, "orders"))


@query("SELECT c_custkey, c_name, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2")
def ingest_new_files(spark: SparkSession, sf: str) -> DataFrame:
    """A drop delivered twice beside one that the ledger holds: files known by content are left out."""
    base = fresh_dir(spark, "drops")
    drop = load(spark, sf, "customer").select("c_custkey", "c_name")
    known = F.col("c_custkey") % 3 == 0
    for delivery, rows in (("first", ~known), ("second", ~known), ("earlier", known), ("again", known)):
        drop.where(rows).write.options(header=True, maxRecordsPerFile=200_000).csv(f"{base}/{delivery}")
    hashes = files.file_hashes(spark, base, "*.csv", recursive=True)
    ledger = hashes.where(F.col("path").contains("/earlier/"))
    fresh = files.new_files(hashes, ledger)
    rows = (
        spark.read.options(header=True, recursiveFileLookup=True).schema("c_custkey bigint, c_name string").csv(base)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    kept = salted_join(rows, fresh.select("path"), ["path"], "left_semi", spread="all")
    return kept.groupBy("c_custkey", "c_name").agg(F.count("*").alias("n"))
