"""Transforms: expected values as literals, and properties."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parcelweave.functions import transforms as T
from parcelweave.operators.mapping import (
    BulkProfile,
    apply_mapping,
    bulk_map,
    normalize_columns,
    resolve_overrides,
    suggest_mapping,
)

#: Text, and what it is as a parcel id, a name, a decimal and an integer.
CLEANED = [
    ("", "", "", None, None),
    (" ", "", "", None, None),
    ("APN: 908-177", "908-177", "Apn: 908-177", None, None),
    ("apn:77", "77", "Apn:77", None, 77),
    ("IDAHO-1", "AHO-1", "Idaho-1", None, -1),
    ("ID_5_x", "-5-X", "Id_5_X", None, 5),
    ("Parcel  9/8 b", "98B", "Parcel 9/8 B", None, 98),
    ("MARIE CURIE LLC", "MARIECURIELLC", "Marie Curie", None, None),
    ("o'brien mc-donald", "OBRIENMC-DONALD", "O'Brien Mc-Donald", None, None),
    ("ACME  corp.", "ACMECORP", "Acme", None, None),
    ("Trust", "TRUST", "Trust", None, None),
    ("The Trust", "THETRUST", "The", None, None),
    ("éCOLE élan", "ÉCOLEÉLAN", "École Élan", None, None),
    ("straße ßa", "STRASSESSA", "Straße Ssa", None, None),
    ("a1b2 c3d", "A1B2C3D", "A1B2 C3D", None, 123),
    ("$9,876.54", "987654", "$9,876.54", 9876.54, 987654),
    ("(5)", "5", "(5)", None, 5),
    ("1_000", "1-000", "1_000", 1000.0, 1000),
    ("1.0d", "10D", "1.0D", None, 10),
    ("nan", "NAN", "Nan", float("nan"), None),
    ("-inf", "-INF", "-Inf", float("-inf"), None),
    ("12.50", "1250", "12.50", 12.5, 1250),
    ("1-2", "1-2", "1-2", None, None),
    ("0", "0", "0", 0.0, 0),
    ("-7", "-7", "-7", -7.0, -7),
    ("1e3", "1E3", "1E3", 1000.0, 13),
    (".5", "5", ".5", 0.5, 5),
    ("5.", "5", "5.", 5.0, 5),
    ("_1", "-1", "_1", None, 1),
    ("1__0", "1--0", "1__0", None, 10),
    ("  42 ", "42", "42", 42.0, 42),
    ("\t tab\x1f", "TAB", "Tab", None, None),
    ("2024-02-30", "2024-02-30", "2024-02-30", None, None),
    ("2/3/2024", "232024", "2/3/2024", None, 232024),
    ("02/03/2024", "02032024", "02/03/2024", None, 2032024),
    ("2024-02-03", "2024-02-03", "2024-02-03", None, None),
    ("中文 字", "中文字", "中文 字", None, None),
    ("x,y,,z", "XYZ", "X,Y,,Z", None, None),
    ("＄", "", "＄", None, None),
    ("l.l.c.", "LLC", "L.L.C.", None, None),
    ("Foo L.L.C.", "FOOLLC", "Foo", None, None),
    ("ab co", "ABCO", "Ab", None, None),
    ("123abc", "123ABC", "123Abc", None, 123),
]
TEXTS = [row[0] for row in CLEANED]


def py_date(s):
    try:
        return datetime.strptime(s, "%m/%d/%Y").isoformat()
    except ValueError:
        return s or None


RESTATED = {
    "to_date": (T.to_date, py_date, {"format": "%m/%d/%Y"}),
    "trim": (lambda v, c: T.strip(v), lambda s: s.strip(), {}),
    "title": (lambda v, c: T.title_case(v), lambda s: s.title(), {}),
    "split": (T.split_text, lambda s: s.split(",") if s else [], {"delimiter": ","}),
    "concat": (T.concat_literals, lambda s: "-".join(([s] if s else []) + ["a", "b"]), {"with": ["a", "b"], "separator": "-"}),
    "default": (T.default_if_empty, lambda s: s or "d", {"default": "d"}),
    "regex": (T.regex_extract, lambda s: (m.group(1) if (m := re.search(r"(\d+)", s)) else s) or None, {"pattern": r"(\d+)"}),
}


def cleaned(spark):
    columns = [build(F.col("t"), {}) for build in (T.clean_parcel_id, T.normalize_name, T.to_decimal, T.to_integer)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_cleaned_values(spark):
    for (text, *want), got in zip(CLEANED, cleaned(spark)):
        assert all(a == b or (a != a and b != b) for a, b in zip(want, got)), (text, want, got)


def test_properties_of_cleaned_values(spark):
    found = cleaned(spark)
    for parcel, name, _, _ in found:
        assert not re.search(r"[^\w-]|_", parcel) and parcel == parcel.upper()
        assert name == name.strip() and "  " not in name
    again = spark.createDataFrame([(i, p, n) for i, (p, n, _, _) in enumerate(found)], "i int, p string, n string")
    row = again.select("i", "p", "n", T.strip(F.col("n")).alias("stripped"), T.normalize_name(F.col("n"), {}).alias("name")).orderBy("i").collect()
    assert all(r["n"] == r["stripped"] for r in row)
    assert all(r["name"] == r["n"] for r in row if not re.search(r"(?i)\b(trust|co|corp|inc|llc)\W*$", r["n"]))


@pytest.mark.parametrize("name", list(RESTATED))
def test_transform_matches_restatement(spark, name):
    build, restated, config = RESTATED[name]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", build(F.col("t"), config).alias("v")).collect()}
    for i, t in enumerate(TEXTS):
        want = restated(t)
        if isinstance(want, float) and want != want:
            assert got[i] != got[i], (t, got[i])
        else:
            assert got[i] == want, (t, got[i], want)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    for name in ("clean_parcel_id", "normalize_name", "to_decimal", "to_integer", "to_date", "trim", "title", "upper"):
        assert df.select(T.transform_column(name, F.col("t"), {})).first()[0] is None


def test_strict_prefix_and_unknown_transform(spark):
    df = spark.createDataFrame([("IDAHO-1",)], "t string")
    assert df.select(T.clean_parcel_id(F.col("t"), {"strict": True})).first()[0] == "IDAHO-1"
    assert df.select(T.transform_column("no such", F.col("t"), {})).first()[0] == "IDAHO-1"


@pytest.mark.parametrize(
    ("text", "form", "want"),
    [
        ("Jan 5 24", "%b %d %y", datetime(2024, 1, 5)),
        ("5 December 1999", "%d %B %Y", datetime(1999, 12, 5)),
        ("2024-02-29 11:05:09 PM", "%Y-%m-%d %I:%M:%S %p", datetime(2024, 2, 29, 23, 5, 9)),
        ("2024-02-30", "%Y-%m-%d", None),
        ("2024-02-03x", "%Y-%m-%d", None),
    ],
)
def test_typed_timestamps(spark, text, form, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.timestamp_from(F.col("t"), form)).first()[0] == want


def test_registered_transform(spark):
    T.register_transform("shout", lambda v, c: F.concat(F.upper(v), F.lit(c.get("mark", "!"))))
    df = spark.createDataFrame([("hi",)], "t string")
    out = apply_mapping(df, {"x": {"source": "t", "transform": "shout", "mark": "?"}})
    assert out.first()["x"] == "HI?"


def test_mapping_order_of_rules(spark):
    df = spark.createDataFrame([("", "7"), (None, "x")], "a string, b string")
    fields = {
        "a": {"source": "a", "default": "none"},
        "n": {"source": "b", "transform": "to_integer", "default": 9},
        "c": {"source": "a", "const": "k", "transform": "upper"},
        "m": {"source": "zzz"},
    }
    got = [tuple(r) for r in apply_mapping(df, fields).collect()]
    assert got == [("none", 7, None, None), ("none", 9, "K", None)]


def test_bulk_map_keeps_unmapped_columns(spark):
    df = spark.createDataFrame([("7", " x ", "12.0", True, 12.7)], "PARCEL string, owner string, n string, f boolean, d double")
    profile = BulkProfile(
        mappings={"PARCEL": "parcel_id", "n": "count", "f": "flag", "d": "whole", "nope": "gone"},
        transforms={"parcel_id": "to_int", "count": "to_int", "flag": "to_bool", "whole": "to_int"},
        constants={"state": "FL", "owner": "unused"},
    )
    out = bulk_map(df, profile)
    assert out.columns == ["parcel_id", "count", "flag", "whole", "owner", "state"]
    assert tuple(out.first()) == (7, None, True, 12, " x ", "FL")


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "pin int, ParcelID int")
    assert normalize_columns(df).columns == ["parcel_id", "ParcelID"]
    headers = spark.createDataFrame([("Parcel ID",), ("OwnerName",)], "header string")
    best = {r["header"]: r["target"] for r in suggest_mapping(headers, ["parcel_id", "owner_name"]).collect()}
    assert best == {"Parcel ID": "parcel_id", "OwnerName": "owner_name"}


def test_overrides_default_and_null(spark, no_broadcast):
    df = spark.createDataFrame([(1, "Clay"), (2, "Cook"), (3, None)], "id int, county string")
    overrides = spark.createDataFrame([("Clay", 5, None)], "county string, delay int, tier string")
    out = resolve_overrides(df, overrides, ["county"], {"delay": 1, "tier": "t"})
    assert sorted(tuple(r) for r in out.select("id", "delay", "tier").collect()) == [(1, 5, "t"), (2, 1, "t"), (3, 1, "t")]
