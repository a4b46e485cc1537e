import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from parcelweave.operators import frontier as R
from parcelweave.operators import lifecycle as L
from parcelweave.operators import strategies as S

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tasks(spark):
    data = [
        ("1", "low", "test", "pending", 1, T0), ("2", "high", "test", "pending", 10, T0), ("3", "med", "test", "pending", 5, T0),
        ("4", "late", "test", "pending", 10, T0 + timedelta(1)), ("5", "busy", "other", "processing", 99, T0), ("6", "o", "other", "pending", 0, T0),
    ]
    return spark.createDataFrame(data, "id string, url string, platform string, status string, priority int, created_at timestamp_ntz")


def test_pull_order(tasks):
    assert [r["url"] for r in R.next_tasks(tasks, 3).collect()] == ["high", "late", "med"]
    assert [r["url"] for r in R.next_tasks(tasks, 9, "other").collect()] == ["o"]
    assert rows(R.next_tasks_per_platform(tasks, 1), "url") == [("high",), ("o",)]
    assert [r["id"] for r in R.list_tasks(tasks, limit=2).collect()] == ["4", "1"]


def brute_fold(events):
    state, retries, started = "pending", 0, None
    for ts, seq, kind in sorted(events):
        if kind == "start":
            if state == "pending":
                state, started = "processing", ts
        elif kind == "complete":
            state = "completed"
        elif kind == "fail":
            state = "failed"
        elif kind == "retry":
            state, retries = "pending", retries + 1
    return state, retries, started


@pytest.mark.parametrize("chunk", ["1 hour", "2 minutes", "10 days"])
def test_state_fold_matches_brute_force(spark, chunk):
    rng = random.Random(5)
    logs = {}
    for task in range(60):
        n = 400 if task == 0 else rng.randint(1, 12)
        logs[task] = [
            (T0 + timedelta(seconds=rng.randint(0, 7200)), i, rng.choice(["start", "start", "complete", "fail", "retry", "noise"]))
            for i in range(n)
        ]
    flat = [(k, ts, s, t, None) for k, es in logs.items() for ts, s, t in es]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "id int, ts timestamp_ntz, seq int, type string, detail string")
    got = {r["id"]: (r["status"], r["retry_count"], r["started_at"]) for r in R.task_state_fold(df, chunk=chunk).collect()}
    for task, events in logs.items():
        if any(t != "noise" for _, _, t in events):
            assert got[task] == brute_fold(events), task


def test_retries(spark):
    df = spark.createDataFrame([(0,), (2,), (3,)], "retry_count int")
    assert rows(R.retry_decision(df), "status", "retry_count") == [("failed", 3), ("pending", 1), ("pending", 3)]
    waits = [r[0] for r in spark.range(8).select(R.retry_delay(F.col("id"), 1.0, 60.0)).collect()]
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60]
    jittered = spark.range(1).select(R.retry_delay(F.lit(3), jitter=F.lit(0.5))).first()[0]
    assert jittered == 8 * 0.875


def test_cancel_expand_recover(spark, tasks):
    ids = spark.createDataFrame([("5",), ("6",), ("6",)], "id string")
    assert rows(R.cancel_tasks(tasks, ids), "id") == [(i,) for i in "12345"]
    assert rows(R.delete_tasks(tasks, ids), "id") == [(i,) for i in "1234"]
    links = spark.createDataFrame(
        [("s2", "new", "p", 5, T0), ("s1", "new", "p", 2, T0), ("s1", "high", "p", 9, T0)],
        "source_id string, url string, platform string, priority_delta int, added_at timestamp_ntz",
    )
    added = R.expand_frontier(links, R.known_urls(tasks), F.lit(T0), base_priority=1)
    assert rows(added, "url", "priority", "status") == [("new", 3, "pending")]
    again = R.expand_frontier(links, R.known_urls(tasks, added), F.lit(T0))
    assert again.count() == 0
    started = tasks.withColumn("started_at", F.col("created_at"))
    assert R.recover_stale(started, F.lit(T0 + timedelta(hours=2)), 3600).where("status = 'processing'").count() == 0


def brute_ripple(edges, seeds, hops):
    seen = {s: (0, 0) for s in seeds}
    wave = dict.fromkeys(seeds, 0)
    for hop in range(1, hops + 1):
        found = {}
        for a, b, d in edges:
            if a in wave and b not in seen:
                found[b] = max(found.get(b, -(10**9)), wave[a] + d)
        for node, delta in found.items():
            seen[node] = (hop, delta)
        wave = found
    return seen


@pytest.mark.parametrize("broadcast", [True, False])
def test_ripple_with_cycles_and_parallel_edges(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(1)
    edges = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(-2, 5)) for _ in range(120)] + [(3, i, 1) for i in range(41)]
    df = spark.createDataFrame(edges, "parent_id int, child_id int, delta int")
    seeds = spark.createDataFrame([(3,), (3,), (99,)], "id int")
    got = {r["id"]: (r["hop"], r["delta"]) for r in R.ripple(df, seeds, 4).collect()}
    assert got == brute_ripple(edges, [3, 99], 4)


def test_links(spark):
    data = [("s1", "u1", 1, T0, False), ("s1", "u2", 5, T0, False), ("s2", "u1", 5, T0 - timedelta(1), False), ("s2", "u3", 0, T0, True)]
    links = spark.createDataFrame(data, "source_id string, url string, priority_delta int, added_at timestamp_ntz, processed boolean")
    assert [(r["source_id"], r["url"]) for r in R.unprocessed_links(links).collect()] == [("s2", "u1"), ("s1", "u2"), ("s1", "u1")]
    assert R.unprocessed_links(links, 1, "s1").first()["url"] == "u2"
    done = spark.createDataFrame([("u1",), ("u1",)], "url string")
    assert R.count_unprocessed(R.mark_processed(links, done)).first()["n"] == 1
    assert R.links_by_source(links, "s2").count() == 2
    gone = spark.createDataFrame([("s1",)], "source_id string")
    assert R.delete_by_source(links, gone).count() == 2


def test_add_links_and_enqueue(spark, tasks):
    links = spark.createDataFrame([("s", "u")], "source_id string, url string")
    more = spark.createDataFrame([("s", "v", False)], "source_id string, url string, processed boolean")
    assert R.add_links(links, more).count() == 2
    added = R.new_tasks(spark.createDataFrame([("z", "p")], "url string, platform string"), F.lit(T0))
    queued = R.enqueue(tasks, added)
    assert queued.where("status = 'pending' AND priority = 0 AND url = 'z'").count() == 1


def test_sync(spark):
    now = T0 + timedelta(seconds=100)
    data = [(1, False, 0, None), (2, False, 1, T0), (3, False, 2, T0), (4, True, 0, None)]
    results = spark.createDataFrame(data, "id int, synced boolean, sync_attempts int, last_attempt_at timestamp_ntz")
    due = R.unsynced_results(results, F.lit(now))
    assert rows(due, "id") == [(1,), (2,)]
    assert R.mark_synced(results, due).where("synced").count() == 3


def test_inbound(spark, tasks):
    own = tasks.withColumn("retry_count", F.lit(0))
    events = spark.createDataFrame(
        [("task.create", None, "n1", None, None), ("task.create", None, "n1", None, 4), ("task.create", None, "", None, 1), ("task.cancel", "5", None, None, None), ("task.cancel", "1", None, None, None)],
        "event string, task_id string, url string, platform string, priority int",
    )
    after = L.apply_inbound_events(own, events, F.lit(T0), "web")
    assert rows(after.where("platform = 'web'"), "url", "priority") == [("n1", 4)]
    assert "1" not in [r["id"] for r in after.collect()] and after.where("id = '5'").count() == 1


# --- strategies ---------------------------------------------------------------------------


def test_quotas():
    assert S.quotas({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    assert S.quotas({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert S.quotas({"hot": 0.98, "chronos": 0.02}, 50, {"chronos": 0.1}) == {"hot": 45, "chronos": 5}
    assert sum(S.quotas({"a": 0.37, "b": 0.61, "c": 0.02}, 7).values()) == 7


def test_hotspot_ignores_repeated_and_old_signals(spark, no_broadcast):
    tasks = spark.createDataFrame([(1, "A", None), (2, "B", T0), (3, "C", T0)], "id int, county string, last_scraped_at timestamp_ntz")
    signals = spark.createDataFrame(
        [("A", 5, T0), ("A", 9, T0), ("B", 50, T0), ("C", 99, T0 - timedelta(hours=1))],
        "region string, signal_strength int, created_at timestamp_ntz",
    )
    hot = S.hotspot(tasks, signals, F.lit(T0), 10)
    assert [(r["id"], r["signal_strength"]) for r in hot.collect()] == [(2, 50), (1, 9)]


def test_gaps_of_dense_and_sparse_ids(spark):
    sparse = [10_000_000 * i for i in range(1, 200)]
    ids = spark.createDataFrame(
        [("r", i) for i in (1, 2, 5, 9, 10, 30, 30)] + [("q", 4)] + [("s", i) for i in sparse], "region string, id long"
    )
    want = [("r", 3, 4), ("r", 6, 8), ("r", 11, 29)] + [("s", a + 1, b - 1) for a, b in zip(sparse, sparse[1:])]
    assert rows(S.sweeper_gaps(ids.repartition(3))) == sorted(want, key=repr)


def test_starvation(spark):
    picks = [("a", c, 0) for c in range(12)] + [("b", c, 1 if c == 1 else 0) for c in range(12)]
    got = {(r["strategy"], r["cycle"]): r["forced"] for r in S.starvation_check(spark.createDataFrame(picks, "strategy string, cycle long, picks long")).collect()}
    assert len(got) == 24
    assert [c for c in range(12) if got["a", c]] == [9, 10, 11] and [c for c in range(12) if got["b", c]] == [11]


def test_seeded_and_targeted(spark):
    docs = spark.createDataFrame([(1, "The Smith Trust smith"), (2, "blacksmith")], "id int, text string")
    words = spark.createDataFrame([("Smith",), ("trust",)], "keyword string")
    assert rows(S.seeded(docs, "text", words)) == [(1, 2)]
    tasks = spark.createDataFrame([(1, '{"auction_date":"2024-01-20"}'), (2, '{"auction_date":"2024-03-01"}'), (3, "{}"), (4, '{"auction_date":"soon"}')], "id int, tags string")
    assert rows(S.targeted(tasks, F.lit(T0)), "id") == [(1,)]


def test_mix_gives_a_url_to_the_first_strategy(spark):
    pool = spark.createDataFrame([(i, f"u{i}", i) for i in range(20)], "id int, url string, p int")
    mixed = S.strategy_mix({"risk": (pool, [F.col("p").desc()]), "chronos": (pool, [F.col("p").desc()])}, 8, {"risk": 0.5, "chronos": 0.5})
    assert rows(mixed, "id", "strategy") == [(i, "chronos" if i < 16 else "risk") for i in range(12, 20)]


def test_mix_fills_its_limit_when_a_url_repeats(spark):
    hot = [(i, "hot", 1000 - i) for i in range(50)]
    pool = spark.createDataFrame([*hot, *[(100 + i, f"u{i}", 20 - i) for i in range(20)]], "id int, url string, p int")
    order = [F.col("p").desc()]
    mixed = S.strategy_mix({"risk": (pool, order), "chronos": (pool, order)}, 10, {"risk": 0.5, "chronos": 0.5}, {})
    want = [(0, "risk"), *[(100 + i, "risk" if i < 4 else "chronos") for i in range(9)]]
    assert rows(mixed, "id", "strategy") == want


def test_mix_fills_its_limit_and_forces_the_starved(spark):
    pool = spark.createDataFrame([(i, f"u{i}", i) for i in range(20)], "id int, url string, p int")
    order = [F.col("p").desc()]
    lists = {"risk": (pool.where("p > 17"), order), "ripple": (pool.where("p < 0"), order), "chronos": (pool, order)}
    mixed = S.strategy_mix(lists, 10, {"risk": 0.5, "ripple": 0.3, "chronos": 0.2}, {})
    assert rows(mixed, "id", "strategy") == [(i, "chronos" if i < 18 else "risk") for i in range(10, 20)]
    short = S.strategy_mix({"risk": (pool.limit(4), order)}, 10, {"risk": 1.0}, {})
    assert short.count() == 4
    weights = {"risk": 1.0, "ripple": 0.0}
    both = {"risk": (pool, order), "ripple": (pool, order)}
    assert {r["strategy"] for r in S.strategy_mix(both, 10, weights, {}).collect()} == {"risk"}
    forced = S.strategy_mix(both, 10, weights, {}, forced=["ripple"])
    assert rows(forced.groupBy("strategy").count()) == [("ripple", 1), ("risk", 9)]


def _hot_list(spark, repeats):
    data = [(i, "hot", 50) for i in range(repeats)] + [(1000 + i, f"u{i % 60}", i // 7) for i in range(100)]
    return spark.createDataFrame(data, "id int, url string, p int").repartition(3), [F.col("p").desc()]


@pytest.mark.parametrize("repeats, tries", [(0, 1), (30, 2), (900, 4)])
def test_best_urls_widen_until_there_are_enough(spark, monkeypatch, repeats, tries):
    """One URL in up to nine of ten rows, ties, and a list shorter than asked for; the table is not shuffled by URL."""
    looked = []
    at_hand = [(r["url"], r["id"]) for r in S.best_urls(*_hot_list(spark, repeats), 6).orderBy("__pos").collect()]
    monkeypatch.setattr(S, "AT_HAND", 0)

    def cut(df):
        looked.append(df._jdf.queryExecution().toString())
        return df.limit(10_000)

    monkeypatch.setattr(S, "cut_lineage", cut)
    df, order = _hot_list(spark, repeats)
    plain = {}
    for i, url, _ in sorted(df.collect(), key=lambda r: (-r["p"], r["id"])):
        plain.setdefault(url, i)
    got = [(r["url"], r["id"]) for r in S.best_urls(df, order, 6).orderBy("__pos").collect()]
    assert got == at_hand == list(plain.items())[:6]
    assert len(looked) == min(tries, len(S.WIDENINGS))
    assert all("TakeOrderedAndProject" in plan and "hashpartitioning(url" not in plan for plan in looked)
    every = [(r["url"], r["id"]) for r in S.best_urls(df, order, 2000).orderBy("__pos").collect()]
    assert every == list(plain.items())
