"""Skew-proof helpers against plain joins and NumPy, with one key holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from parcelweave.operators import ranking
from parcelweave.operators.ranking import exact_quantiles, global_rank, top_per_group
from parcelweave import session
from parcelweave.session import heavy_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") < 1000, 7).when(F.col("id") < 1050, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(3000).select(key.cast("int").alias("k"), F.col("id").alias("v")).cache()


def test_heavy_keys_follow_from_rows_per_partition(spark, skewed):
    """A third of the rows and nulls in 50 of 3000: more partitions find more keys and more parts."""
    assert list(heavy_keys(skewed, ["k"], parts=10).values()) == [4]
    assert sorted(heavy_keys(skewed, ["k"], parts=100).values()) == [2, 34]
    assert heavy_keys(skewed.limit(0), ["k"]) == {}


def test_a_hot_key_of_equal_rows_is_dealt_out(spark, no_broadcast):
    """Half the rows hold one key, and their other column has two values: ``unique`` splits them all the same."""
    big = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 4).alias("r"), "id")
    small = big.select("k").distinct().withColumn("w", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(big, small, ["k"], unique="id")
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count()
        most = per_task.agg(F.max("count")).first()[0]
        assert joined.count() == 20_000 and most < 4 * 20_000 / 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_copies_of_a_row_are_made_in_steps(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(session, "COPIES", 7)
    keys = spark.createDataFrame([(1,)] * 50 + [(2,)] * 7 + [(3,)], "k int")
    small = spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string")
    got = salted_join(keys, small, ["k"], "left").groupBy("k", "w").count()
    assert rows(got) == [(1, "x", 50), (2, "y", 7), (3, None, 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("spread", ["hot", "all"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, skewed, no_broadcast, how, spread, null_safe):
    small = spark.createDataFrame([(7, "x"), (8, "y"), (7000, "z"), (None, "n")], "k long, w string")
    got = salted_join(skewed, small, ["k"], how, spread=spread, salts=4, null_safe=null_safe)
    other = small.withColumnRenamed("k", "j")
    same = F.col("k").eqNullSafe(F.col("j")) if null_safe else F.col("k") == F.col("j")
    want = skewed.join(other, same, how).drop("j")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_of_bare_keys(spark, skewed, no_broadcast, how):
    small = spark.createDataFrame([(7, "x"), (7, "y"), (8, "z")], "k int, w string")
    keys = skewed.select("k")
    assert rows(salted_join(keys, small, ["k"], how)) == rows(keys.join(small, ["k"], how))


def test_salted_join_keeps_map_columns(spark, skewed, no_broadcast):
    small = spark.createDataFrame([(7, "x")], "k int, w string")
    big = skewed.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert salted_join(big, small, ["k"], spread="all").count() == skewed.where("k = 7").count()


def test_salting_spreads_the_heavy_key(spark, skewed, no_broadcast):
    small = spark.createDataFrame([(7, "x")], "k int, w string")
    plan = salted_join(skewed, small, ["k"], salts=4)._jdf.queryExecution().toString()
    assert "__salt" in plan


def test_global_rank(spark, skewed):
    df = skewed.repartition(5)
    got = global_rank(df, ["k"], [F.col("v").desc()])
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    want = {(k, v): i + 1 for k, vs in groups.items() for i, v in enumerate(sorted(vs, reverse=True))}
    assert {(r["k"], r["v"]): r["rn"] for r in got.collect()} == want


def test_running_sum(skewed):
    got = ranking.running_sum(skewed.repartition(5), ["k"], [F.col("v").asc()], "v", "total")
    sums, want = {}, {}
    for k, v in sorted(((r["k"], r["v"]) for r in skewed.collect()), key=lambda r: r[1]):
        sums[k] = want[k, v] = sums.get(k, 0) + v
    assert {(r["k"], r["v"]): r["total"] for r in got.collect()} == want


def test_top_per_group_limits_before_the_shuffle(skewed):
    top = top_per_group(skewed, ["k"], [F.col("v").asc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.where("k = 7").count() == 2
    many = top_per_group(skewed.where("k IS NOT NULL"), ["k"], [F.col("v").asc()], 1001)
    assert many.where("k = 7").count() == 1001


@pytest.mark.parametrize("accuracy", [50, 10_000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_quantiles(spark, accuracy, broadcast, request, monkeypatch):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
        monkeypatch.setattr(ranking, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(ranking, "WINDOW_ROWS", 0)
    rng = np.random.default_rng(3)
    data = {"a": rng.lognormal(0, 3, 6000), "b": np.repeat([1.0, 2.0], [900, 100]), None: rng.normal(size=777), "c": np.array([5.0])}
    flat = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(flat, "k string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, accuracy).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q)), (k, name)


def test_exact_quantiles_of_everything(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert tuple(exact_quantiles(df, [], "v", {"p25": 0.25, "p50": 0.5}, accuracy=100).first()) == (2500.0, 5000.0)


@pytest.mark.parametrize("many", [False, True])
def test_rolled_up_quantiles(spark, monkeypatch, many):
    """Medians of cells, of their unions and of everything, from sketches and counts inside brackets."""
    import random
    import statistics

    from parcelweave.operators import ranking

    if many:
        monkeypatch.setattr(ranking, "WINDOW_ROWS", 10)
        monkeypatch.setattr(ranking, "BROADCAST_KEYS", 0)
    pick = random.Random(3)
    data = [(pick.choice(["a", "b", None]), pick.choice([1, 2, 2, 2, None]), pick.choice([pick.gauss(0, 9), 4.0])) for _ in range(30_000)]
    data += [("lone", 1, 5.0), ("none", 1, None), ("none", 2, float("nan"))]
    df = spark.createDataFrame(data, "s string, i int, v double").repartition(4)
    sketched = df.groupBy("s", "i").agg(*ranking.cell_sketch(F.col("v")))

    def spread(rows):
        rest = [c for c in rows.columns if c not in ("s", "i")]
        kinds = F.array(
            F.struct(F.lit(0).alias("g"), F.col("s").alias("s"), F.col("i").alias("i")),
            F.struct(F.lit(1).alias("g"), F.lit(None).cast("string").alias("s"), F.col("i").alias("i")),
            F.struct(F.lit(2).alias("g"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("int").alias("i")),
        )
        return rows.select(F.explode(kinds).alias("k"), *rest).select("k.g", "k.s", "k.i", *rest)

    found = ranking.rolled_up_quantile(df, ["s", "i"], sketched, ["g", "s", "i"], spread, "v", 0.5, "median")
    got = {(r["g"], r["s"], r["i"]): r["median"] for r in found.collect()}
    groups = {}
    for s, i, v in data:
        if v is not None and v == v:
            for key in ((0, s, i), (1, None, i), (2, None, None)):
                groups.setdefault(key, []).append(v)
    assert got.keys() == groups.keys()
    assert all(abs(got[k] - statistics.median(vs)) < 1e-9 for k, vs in groups.items())
    none = ranking.rolled_up_quantile(
        df.where("false"), ["s", "i"], sketched.where("false"), ["g", "s", "i"], spread, "v", 0.5, "median"
    )
    assert none.columns == ["g", "s", "i", "median"] and none.count() == 0
