from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from parcelweave.operators import frontier as R
from parcelweave.streaming import jobs as K

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, seq int, type string, detail string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture()
def feed(spark, tmp_path):
    """Directory whose files arrive one per batch, in order."""
    source = tmp_path / "in"
    source.mkdir()

    def add(data, schema=SCHEMA):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))

    def stream(schema=SCHEMA):
        kind = spark.createDataFrame([], schema).schema
        return K.read_stream(spark, str(source), kind, files_per_trigger=1)

    return add, stream, str(tmp_path)


def test_late_rows_are_dropped_and_windows_close(feed):
    add, stream, base = feed
    metrics = lambda: K.stream_metrics(stream().drop("id"), "5 minutes", late="10 minutes")
    add([(1, at(0), 1, "started", None), (1, at(1), 2, "succeeded", None)])
    K.drain_to(metrics(), f"{base}/out", f"{base}/cp")
    add([(1, at(60), 3, "failed", None)])
    K.drain_to(metrics(), f"{base}/out", f"{base}/cp")
    add([(1, at(2), 4, "failed", None), (1, at(120), 5, "started", None)])
    out = K.drain_to(metrics(), f"{base}/out", f"{base}/cp")
    got = sorted((r["started"], r["succeeded"], r["failed"], r["success_rate"]) for r in out.collect())
    assert got == [(0, 0, 1, 0.0), (1, 1, 0, 1.0)]


@pytest.mark.parametrize("spread_by", [None, "seq"])
def test_dedup_across_restarts(feed, spread_by):
    add, stream, base = feed
    arrivals = lambda: stream().select("detail", "ts", "seq")
    unique = lambda: K.stream_dedup(arrivals(), "ts", "1 day", ["detail"], spread_by).select("detail")
    add([(1, at(0), 1, "x", "u1"), (2, at(0), 2, "x", "u1"), (3, at(0), 3, "x", "u2")])
    K.drain_to(unique(), f"{base}/out", f"{base}/cp")
    add([(4, at(5), 4, "x", "u1"), (5, at(5), 5, "x", "u3")])
    assert rows(K.drain_to(unique(), f"{base}/out", f"{base}/cp")) == [("u1",), ("u2",), ("u3",)]


def test_sessions(feed):
    add, stream, base = feed
    add([(7, at(0), 1, "x", None), (7, at(0.25), 2, "x", None), (7, at(3), 3, "x", None), (8, at(90), 4, "x", None)])
    sessions = K.worker_sessions(stream().select(F.col("id").alias("worker"), "ts"))
    out = K.drain_to(sessions, f"{base}/out", f"{base}/cp")
    assert rows(out, "worker", "events") == [(7, 1), (7, 2)]


def test_upsert_deltas_resolve_to_the_last_write(spark, feed):
    add, stream, base = feed
    run = lambda: K.stream_upsert(stream(), ["id"], ["ts", "seq"], f"{base}/d", f"{base}/cp").awaitTermination()
    add([(1, at(0), 1, "a", "x"), (1, at(1), 2, "b", "y"), (None, at(1), 3, "c", "z")])
    run()
    add([(1, at(2), 4, "d", None), (2, at(2), 5, "e", "w")])
    run()
    assert rows(K.read_upserted(spark, f"{base}/d", ["id"]), "id", "type", "detail") == [(1, "d", None), (2, "e", "w")]
    old = spark.createDataFrame([(2, "kept"), (3, "alone")], "id int, extra string")
    merged = K.read_upserted(spark, f"{base}/d", ["id"], base=old)
    assert rows(merged, "id", "extra", "type") == [(1, None, "d"), (2, "kept", "e"), (3, "alone", None)]


def test_task_state_equals_the_batch_fold(spark, feed):
    add, stream, base = feed
    kinds = ["start", "fail", "retry", "start", "complete", "start", "retry", "start"]
    data = [(i % 3, at(n), n, kinds[(n * 7 + i) % 8], None) for n in range(12) for i in range(3)]
    for part in (data[:10], data[10:11], data[11:]):
        add(part)
        K.write_updates(K.stream_task_state(stream()), f"{base}/d", f"{base}/cp").awaitTermination()
    got = K.read_upserted(spark, f"{base}/d", ["id"])
    want = R.task_state_fold(spark.createDataFrame(data, SCHEMA))
    assert rows(got, "id", "status", "retry_count") == rows(want, "id", "status", "retry_count")


def test_signal_join_honours_validity(feed):
    add, stream, base = feed
    add([(1, at(0), 1, "signal", "A"), (2, at(30), 2, "task", "A"), (3, at(61), 3, "task", "A"), (4, at(10), 4, "task", "B")])
    tasks = stream().where("type = 'task'").select("id", F.col("detail").alias("county"), "ts")
    signals = stream().where("type = 'signal'").select(F.col("id").alias("sid"), F.col("detail").alias("region"), F.col("ts").alias("signal_ts"))
    out = K.drain_to(K.signal_join(tasks, signals).select("id", "sid"), f"{base}/out", f"{base}/cp")
    assert rows(out) == [(2, 1)]


def test_compaction_changes_no_row_and_skips_old_deltas(spark, feed, capsys):
    add, stream, base = feed
    run = lambda: K.stream_upsert(stream(), ["id"], ["ts", "seq"], f"{base}/d", f"{base}/cp").awaitTermination()
    read = lambda: K.read_upserted(spark, f"{base}/d", ["id"], order=["ts", "seq"])
    add([(1, at(0), 1, "a", None), (2, at(0), 1, "a", None)])
    run()
    add([(1, at(5), 2, "b", None)])
    run()
    before = rows(read())
    assert K.compact(spark, f"{base}/d", ["id"], ["ts", "seq"]) == 1
    assert rows(read()) == before and K.compact(spark, f"{base}/d", ["id"], ["ts", "seq"]) == 1
    add([(2, at(9), 3, "c", None), (1, at(1), 9, "late", None), (3, at(1), 1, "n", None)])
    run()
    assert rows(read(), "id", "type") == [(1, "b"), (2, "c"), (3, "n")]
    read().explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert any("batch#" in line and "> 1)" in line for line in filters), filters
    assert K.compact(spark, f"{base}/d", ["id"], ["ts", "seq"]) == 2 and rows(read(), "id", "type") == [(1, "b"), (2, "c"), (3, "n")]


def test_silent_tasks_leave_the_state(spark, feed):
    add, stream, base = feed
    state = lambda: K.expiring_task_state(stream(), silence="1 hour", late="1 minute")
    run = lambda: K.write_updates(state(), f"{base}/d", f"{base}/cp").awaitTermination()
    add([(1, at(0), 1, "retry", None), (1, at(1), 2, "start", None), (2, at(1), 1, "complete", None)])
    run()
    assert rows(K.read_upserted(spark, f"{base}/d", ["id"])) == [(1, "processing", 1), (2, "completed", 0)]
    add([(1, at(30), 3, "retry", None)])
    run()
    add([(3, at(300), 1, "start", None)])
    run()
    add([(1, at(301), 4, "retry", None), (3, at(301), 2, "fail", None)])
    run()
    # Task 1 was silent for hours: its two tries are forgotten.
    assert rows(K.read_upserted(spark, f"{base}/d", ["id"])) == [(1, "pending", 1), (2, "completed", 0), (3, "failed", 0)]


def test_deltas_of_a_base_may_go(spark, feed, tmp_path):
    """Reading and compacting need no delta that the base holds, and see no base that isn't published."""
    import shutil
    from pathlib import Path

    add, stream, base = feed
    key, order = ["id"], ["ts", "seq"]
    run = lambda: K.stream_upsert(stream(), key, order, f"{base}/d", f"{base}/cp").awaitTermination()
    read = lambda: rows(K.read_upserted(spark, f"{base}/d", key, order=order), "id", "type")
    assert K.drop_deltas(spark, f"{base}/none") == []
    add([(1, at(0), 1, "a", None), (2, at(0), 1, "a", None)])
    run()
    add([(1, at(5), 2, "b", None)])
    run()
    # A base that is still being written has no row in the manifest.
    spark.createDataFrame([(9,)], "id int").write.parquet(f"{base}/d/_base/upto=7")
    assert read() == [(1, "b"), (2, "a")] and K.compact(spark, f"{base}/d", key, order) == 1
    assert K.drop_deltas(spark, f"{base}/d") == [0, 1] and K.drop_deltas(spark, f"{base}/d") == []
    assert read() == [(1, "b"), (2, "a")] and K.compact(spark, f"{base}/d", key, order) == 1
    for delta in Path(f"{base}/d").glob("batch=*"):
        shutil.rmtree(delta)
    assert read() == [(1, "b"), (2, "a")] and K.compact(spark, f"{base}/d", key, order) == 1
    add([(2, at(9), 3, "c", None), (1, at(1), 9, "late", None), (3, at(1), 1, "n", None)])
    run()
    assert read() == [(1, "b"), (2, "c"), (3, "n")] and K.compact(spark, f"{base}/d", key, order) == 2
    shutil.rmtree(f"{base}/d/batch=2")
    assert read() == [(1, "b"), (2, "c"), (3, "n")]
    with pytest.raises(ValueError):
        spark.createDataFrame([], "id int").write.parquet(f"{tmp_path}/void")
        K.compact(spark, f"{tmp_path}/void", key)


def test_compaction_writes_touched_buckets_only(spark, tmp_path):
    """Buckets without newer deltas keep their files; rows equal those of one resolved table."""
    from pathlib import Path

    path, key, order = f"{tmp_path}/t", ["id", "county"], ["seq"]
    state = {}

    def delta(batch, keys, seq):
        data = [(k, None if k % 7 == 0 else f"c{k % 3}", seq, f"v{seq}") for k in keys]
        spark.createDataFrame(data, "id int, county string, seq int, v string").write.parquet(f"{path}/batch={batch}")
        state.update({(k, county): (seq, v) for k, county, seq, v in data if seq >= state.get((k, county), (0,))[0]})

    def files():
        return {str(f.relative_to(path)) for f in Path(path).glob("_base/*/*/*.parquet")}

    def check():
        got = K.read_upserted(spark, path, key, order=order).collect()
        assert len(got) == len(state) and {(r["id"], r["county"]): (r["seq"], r["v"]) for r in got} == state

    delta(0, range(200), 1)
    assert K.superseded(spark, path) == []
    assert K.compact(spark, path, key, order, buckets=8) == 0
    first = files()
    assert len({f.split("/")[2] for f in first}) == 8
    check()
    delta(1, [5, 500], 2)
    delta(2, [5], 1)  # older than what is there
    check()
    assert K.compact(spark, path, key, order) == 2
    second = files()
    rewritten = {f.split("/")[2] for f in second - first}
    assert first <= second and 1 <= len(rewritten) <= 2
    old = {s.removeprefix(f"{path}/") for s in K.superseded(spark, path)}
    assert old and {o.split("/")[2] for o in old} <= rewritten and all("version=0" in o for o in old)
    check()
    delta(3, [9], 3)
    assert K.compact(spark, path, key, order, buckets=3) == 3
    assert {f.split("/")[2] for f in files() - second} == {f"__bucket={b}" for b in range(3)}
    check()
    assert K.drop_deltas(spark, path) == [0, 1, 2, 3]
    check()
    assert K.compact(spark, path, key, order) == 3
