import pytest

from conftest import rows
from parcelweave.operators import content as C
from parcelweave.operators import upsert as U
from parcelweave.operators.mapping import BulkProfile
from parcelweave.plans.bulk import bulk_load


@pytest.fixture(scope="module")
def tables(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, x double")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, name string, y string")
    return old, new


def test_replace_and_merge(tables):
    old, new = tables
    assert rows(U.upsert(old, new, ["id"], "replace")) == [(1, "a", 1.0, None), (2, None, None, "n"), (3, "c", None, "m")]
    assert rows(U.upsert(old, new, ["id"], "merge")) == [(1, "a", 1.0, None), (2, None, 2.0, "n"), (3, "c", None, "m")]
    assert (2, "b", 2.0, "n") in rows(U.upsert_merge(old, new, ["id"], ignore_nulls=True))
    with pytest.raises(ValueError):
        U.upsert(old, new, ["id"], "append")


def test_repeating_an_upsert_changes_nothing(tables):
    old, new = tables
    once = U.upsert(old, new, ["id"], "merge")
    assert rows(U.upsert(once, new, ["id"], "merge")) == rows(once)


def test_actions_and_duplicates(spark, tables):
    old, new = tables
    assert rows(U.batch_upsert(old, new, ["id"]), "id", "action") == [(2, "updated"), (3, "inserted")]
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "y", 3)], "a int, b string, seq int")
    assert rows(U.detect_duplicates(df, ["a", "b"])) == [(1, "x", 1, 2), (1, "x", 2, 2)]
    assert rows(U.last_write_wins(df, ["a", "b"], ["seq"])) == [(1, "x", 2), (2, "y", 3)]
    assert rows(U.first_write_wins(df, ["a", "b"], ["seq"])) == [(1, "x", 1), (2, "y", 3)]


def test_keys(spark):
    df = spark.createDataFrame([("7", None, "FL"), ("", "Clay", "FL"), ("7", "Clay", "FL")], "parcel_id string, county string, state string")
    keys = [r[0] for r in df.select(U.compute_key([*U.PARCEL_KEY, "zz"], df.columns)).collect()]
    assert keys == ["7||FL|", "|Clay|FL|", "7|Clay|FL|"]
    missing = [r[0] for r in df.select(U.missing_key_fields([*U.PARCEL_KEY, "zz"], df.columns)).collect()]
    assert missing == [["county", "zz"], ["parcel_id", "zz"], ["zz"]]
    assert U.reject_keyless(df, U.PARCEL_KEY).count() == 1


def test_consolidate_prefers_earlier_sources(spark):
    df = spark.createDataFrame(
        [(1, "gis", "g", None), (1, "tax", None, 5.0), (1, "tax", "t", 4.0), (2, "odd", "o", None)],
        "id int, kind string, owner string, amount double",
    )
    got = U.consolidate_sources(df, ["id"], "kind", ["tax", "gis"], ["owner", "amount"])
    assert rows(got) == [(1, True, True, "t", 4.0), (2, False, False, "o", None)]


def test_bulk_load(spark):
    existing = spark.createDataFrame([("1", "FL", "old", 9.0)], "parcel_id string, state string, owner string, tax double")
    source = spark.createDataFrame([("1", "new", 1), ("2", "a", 2), ("2", "b", 3), (None, "c", 4), ("", "d", 5)], "PARCEL string, owner string, seq int")
    profile = BulkProfile({"PARCEL": "parcel_id"}, constants={"state": "FL"}, required=["parcel_id"], key=["parcel_id", "state"])
    load = bulk_load(source, existing, profile, ["seq"])
    assert rows(load.merged) == [("1", "FL", "new", 9.0), ("2", "FL", "b", None)]
    assert load.rejected.count() == 2
    assert tuple(load.report.first())[:4] == (5, 3, 5, 2)


def test_content(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, t string")
    assert rows(C.distinct_content(df, "id", "t"), "id", "copies", "t") == [(1, 2, "x"), (2, 1, "y")]
    assert C.dedupe_rate(df, "t").first()["dedupe_rate"] == 0.333333
    assert C.dedupe_rate(df.limit(0), "t").first()["dedupe_rate"] == 0.0


def test_manifest_paths(spark):
    long_id = "9" * 300
    df = spark.createDataFrame([("a/b:c", "x"), (None, "yé"), (long_id, "z")], "pid string, html string").selectExpr(
        "*", "'FL' AS state", "timestamp_ntz'2024-01-02 03:04:05' AS at"
    )
    got = C.raw_manifest(df, "raw", ["state"], "pid", "html", "at").collect()
    assert got[0]["parcel_dir"] == "raw/FL/a_b_c" and not got[0]["id_missing"]
    assert got[1]["parcel_dir"].startswith("raw/FL/20240102T030405_") and got[1]["size_bytes"] == 3
    assert len(got[2]["parcel_dir"]) == 4 + 64
