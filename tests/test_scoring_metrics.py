import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from parcelweave.functions import signing
from parcelweave.operators import lifecycle as L
from parcelweave.operators import metrics as I
from parcelweave.operators import scoring as G

T0 = datetime(2024, 1, 1)


def test_task_priority(spark):
    df = spark.createDataFrame(
        [("OWNER", T0 - timedelta(hours=3, minutes=59), 2), (None, T0 - timedelta(days=9), 0), ("x", None, None)],
        "rel string, at timestamp_ntz, tries int",
    )
    score = G.task_priority(F.col("rel"), F.col("at"), F.col("tries"), F.lit(T0).cast("timestamp_ntz"), boost=1)
    assert [r[0] for r in df.select(score).collect()] == [5 + 3 + 4 + 1, 10 + 1, 1]
    moved = spark.range(1).select(G.boost_priority(F.lit(7)), G.boost_priority(F.lit(90)), G.decay_priority(F.lit(19)), G.decay_priority(F.lit(1), least=3)).first()
    assert tuple(moved) == (10, 110, 17, 3)


def test_delinquency_score(spark):
    df = spark.createDataFrame(
        [("delinquent", "AZ", 100.0, 4.0, T0 - timedelta(hours=1), T0 - timedelta(days=2)), ("paid_no_liens", "FL", 1.0, 0.0, None, T0 - timedelta(days=99)), ("odd", "FL", None, None, None, None)],
        "status string, state string, market_value double, tax_due double, last_viewed_at timestamp_ntz, last_scraped_at timestamp_ntz",
    )
    got = [(r["raw_score"], r["priority_score"], r["tier"]) for r in G.delinquency_score(df, F.lit(T0).cast("timestamp_ntz")).collect()]
    assert got[0] == (pytest.approx(5 * 2 * 1.5 * 5 + 0.2), 10.0, "HIGH")
    assert got[1] == (pytest.approx(1.1), pytest.approx(1.1), "HIBERNATION")
    assert got[2] == (None, None, None)


def test_tiers(spark):
    tiers = spark.createDataFrame([(t,) for t in ("LOW", "HIGH", "CRITICAL")], "t string")
    assert [r[0] for r in tiers.select(G.at_least(F.col("t"), "HIGH")).collect()] == ["HIGH", "HIGH", "CRITICAL"]
    tags, priority = G.risk_tags(F.lit(1.0), F.lit(2), F.lit("AZ"), F.lit(7))
    row = spark.range(1).select(tags.alias("t"), priority.alias("p")).first()
    assert (row["t"], row["p"]) == (["delinquent", "stacking", "auction_feb_2026"], 200)
    near = [r[0] for r in spark.createDataFrame([(T0,), (T0 + timedelta(14),), (T0 - timedelta(1),)], "a timestamp_ntz").select(G.auction_proximity(F.col("a"), F.lit(T0))).collect()]
    assert near == [10.0, pytest.approx(10 / 2.718281828), 0.0]


def test_event_triggers(spark, no_broadcast):
    parcels = spark.createDataFrame([(1, "FL", "Clay", "paid_no_liens", "LOW"), (2, "FL", "Clay", "delinquent", "LOW"), (3, "FL", "Dade", "paid_no_liens", "LOW"), (4, "FL", None, "x", "LOW")], "parcel_id int, state string, county string, status string, tier string")
    calendar = spark.createDataFrame([("FL", "Clay", T0 - timedelta(1)), ("FL", "Dade", T0)], "state string, county string, due_date timestamp_ntz")
    files = spark.createDataFrame([(4, T0), (4, T0), (3, T0 + timedelta(1))], "parcel_id int, released_at timestamp_ntz")
    got = G.event_triggers(parcels, calendar, files, F.lit(T0).cast("timestamp_ntz"))
    assert rows(got, "parcel_id", "tier") == [(1, "HIGH"), (2, "LOW"), (3, "LOW"), (4, "CRITICAL")]


def test_signing(spark):
    messages = ['{"a":1}', "naïve ☃", ""]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    for secret in ("k", "s" * 64, "s" * 100, "clé"):
        got = [r[0] for r in df.select(signing.sign(F.col("m"), secret)).collect()]
        assert got == ["sha256=" + hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for m in messages]
        keyed = df.withColumn("k", F.lit(secret)).select(signing.sign(F.col("m"), F.col("k")))
        assert [r[0] for r in keyed.collect()] == got
    bare = spark.createDataFrame([("sha256=ab",), ("sha256:ab",), ("ab",), ("a:b=c",)], "h string")
    assert [r[0] for r in bare.select(signing.bare_signature(F.col("h"))).collect()] == ["ab", "ab", "ab", "c"]


def test_outbox_payload(spark):
    df = spark.createDataFrame([("1", "task.failed", "p", "boom")], "task_id string, event string, platform string, error string")
    row = L.notification_outbox(df, "k").first()
    assert row["payload"] == json.dumps(json.loads(row["payload"]), sort_keys=True, separators=(",", ":"))
    assert json.loads(row["payload"])["stats"] is None and row["signature"].startswith("sha256=")


def test_payload_equals_what_a_receiver_rebuilds(spark):
    result = {"b": 1, "a": {"z": [{"y": "ñ", "x": None}], "k": "tab\t\x1f\x0b \U0001f600 \x7f \\u001F"}}
    schema = (
        "task_id string, event string, result struct<b:int,a:struct<z:array<struct<y:string,x:string>>,k:string>>, "
        "stats map<string,struct<q:int,p:int>>"
    )
    rows_ = [("7", "task.completed", result, {"ü": {"q": 1, "p": 2}, "a": None}), ("8", "task.failed", None, None)]
    df = spark.createDataFrame([(i, e, json.loads(json.dumps(r)) if r else None, m) for i, e, r, m in rows_], schema)
    for row in L.notification_outbox(df, "k").collect():
        rebuilt = json.dumps(json.loads(row["payload"]), sort_keys=True, separators=(",", ":"))
        assert row["payload"] == rebuilt
        assert row["signature"] == "sha256=" + hmac.new(b"k", rebuilt.encode(), hashlib.sha256).hexdigest()
    assert json.loads(L.notification_outbox(df).where("task_id = '7'").first()["payload"])["result"] == result


def test_retention(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    df = spark.createDataFrame([(d, T0 - timedelta(d)) for d in (0, 29, 30, 364, 365)], "d int, at timestamp_ntz")
    assert [r[0] for r in df.orderBy("d").select(L.retention_class(F.col("at"), now)).collect()] == ["keep", "keep", "compress", "compress", "archive"]
    assert L.expire_by_age(df, "at", now, 30).count() == 3
    outcomes = spark.createDataFrame([(1, T0, 1, False), (1, T0, 2, True), (2, T0, 1, True), (2, T0, 2, False), (2, T0, 3, False)], "parcel_id int, ts timestamp_ntz, seq int, ok boolean")
    assert rows(L.keep_last_failure(outcomes), "parcel_id", "seq") == [(2, 3)]


def test_running_level_and_alert(spark):
    events = [(T0 + timedelta(minutes=m), k) for m, k in [(0, "started"), (0, "started"), (1, "succeeded"), (1500, "started"), (1502, "failed"), (1502, "sent")]]
    level = I.running_level(spark.createDataFrame(events, "ts timestamp_ntz, type string"))
    got = [(int((r["minute"] - T0).total_seconds() // 60), r["level"]) for r in level.orderBy("minute").collect()]
    assert got == [(0, 2), (1, 1), (1500, 2), (1502, 1)]
    alert = I.sustained_alert(level.select("minute", "level"), 1)
    assert [(r["lowest"], r["alert"]) for r in alert.orderBy("minute").collect()] == [(2, True), (1, False), (2, True), (1, False)]


def test_histogram_quantile(spark):
    counts = [F.lit(c) for c in (10, 30, 40, 50)]
    q = lambda p: spark.range(1).select(I.histogram_quantile(p, counts, [1.0, 2.0, 4.0])).first()[0]
    assert q(0.1) == 0.5 and q(0.5) == 1.75 and q(0.75) == 3.5 and q(0.99) == 4.0


def test_queue_alerts(spark):
    df = spark.range(101).selectExpr("'pending' AS status", "1 AS level", "'p' AS platform")
    got = {(r["level"], r["platform"]): (r["depth"], r["alert"]) for r in I.queue_depth(df).collect()}
    assert got == {(1, "p"): (101, "ok"), (1, None): (101, "warning"), (None, None): (101, "ok")}


def test_unknown_dimensions_are_no_subtotals(spark):
    rows = [("succeeded", None, "p", 3.0), ("succeeded", "t", "p", 1.0), ("failed", "t", None, 5.0), ("failed", None, None, 9.0)]
    events = spark.createDataFrame(rows, "type string, task_type string, platform string, runtime double").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    stats = I.range_stats(events, F.lit("2024-01-01 00:00:10").cast("timestamp")).where("range = '1h'").collect()
    got = {(r["grouping"], r["task_type"], r["platform"]): (r["total"], r["median_runtime"]) for r in stats}
    assert len(stats) == len(got) and got == {
        (0, None, "p"): (1, 3.0), (0, "t", "p"): (1, 1.0), (0, "t", None): (1, 5.0), (0, None, None): (1, 9.0),
        (1, None, None): (2, 6.0), (1, "t", None): (2, 3.0), (2, None, "p"): (2, 2.0), (2, None, None): (2, 7.0), (3, None, None): (4, 4.0),
    }
    queue = spark.createDataFrame([("pending", 1, None), ("pending", None, "p"), ("pending", None, None)], "status string, level int, platform string")
    depth = {(r["grouping"], r["level"], r["platform"]): r["depth"] for r in I.queue_depth(queue).collect()}
    assert depth == {(0, 1, None): 1, (0, None, "p"): 1, (0, None, None): 1, (1, 1, None): 1, (1, None, None): 2, (3, None, None): 3}


def test_fractions_are_written_as_a_receiver_writes_them(spark):
    import json
    import random
    import struct

    pick = random.Random(6)
    values = [struct.unpack("<d", struct.pack("<Q", pick.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    values += [pick.uniform(-1e6, 1e6) for _ in range(2000)] + [round(pick.uniform(0, 1e9), 2) for _ in range(3000)]
    values += [float(f"{pick.randint(1, 999)}e{pick.randint(-30, 30)}") for _ in range(1500)]
    values += [0.0, -0.0, 1e16, 9999999999999998.0, 1e-4, 9.999e-5, 8.41e21, 2e23, 5e-324, 1.7976931348623157e308, 12500000.0, 100.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(4)
    got = {r["i"]: r["t"] for r in df.select("i", L.plain_number(F.col("v")).alias("t")).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != json.dumps(v)]
    assert not wrong, wrong[:5]


def test_payloads_with_fractions_at_every_depth(spark):
    import json

    rows = [("7", 12500000.0, 0.00001, "say \"number-\" 1.0E7")]
    df = spark.createDataFrame(rows, "task_id string, a double, b double, c string").select(
        "task_id", F.lit("task.completed").alias("event"),
        F.struct(
            F.col("a").alias("assessed"), F.array("a", "b", F.lit(None).cast("double")).alias("list"), F.create_map(F.col("c"), F.col("b")).alias("map"),
            F.lit("12.50").cast("decimal(10,2)").alias("money"), F.lit(3).cast("decimal(10,0)").alias("whole"), F.lit(0.1).cast("float").alias("f"),
            F.lit(float("nan")).alias("nan"), F.col("c").alias("c"),
        ).alias("result"),
    )
    payload = L.notification_outbox(df).first()["payload"]
    read = json.loads(payload)
    assert payload == json.dumps(read, sort_keys=True, separators=(",", ":"))
    assert read["result"]["assessed"] == 12500000.0 and read["result"]["list"] == [12500000.0, 1e-05, None] and read["result"]["f"] == 0.1
    assert '"money":12.5,' in payload and '"whole":3' in payload and '"nan":NaN' in payload
