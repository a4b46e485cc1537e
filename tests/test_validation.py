from pyspark.sql import functions as F

from parcelweave.functions.validators import register_rule
from parcelweave.operators.validation import bulk_job_report, quarantine, validate_records, validation_summary

RULES = {
    "required": ["id", "gone"],
    "fields": {
        "id": {"required": True, "pattern": r"\d{3}"},
        "size": {"min_value": 1, "max_value": 9.5},
        "kind": {"enum": ["a", "b"], "min_length": 1, "max_length": 3},
        "mail": {"email": True},
        "web": {"url": True},
        "tel": {"phone": True},
    },
}


def test_errors_in_order(spark):
    df = spark.createDataFrame(
        [
            ("123x", "5", "a", "a@b.co", "http://x", "+1 (2)"),
            ("x123", "0", "abcd", "a@b", "ftp://x", "12a"),
            ("", "big", None, None, None, None),
            (None, "nan", "b", None, None, None),
        ],
        "id string, size string, kind string, mail string, web string, tel string",
    )
    got = [r["errors"] for r in validate_records(df, RULES).collect()]
    gone = "Missing required field: gone"
    assert got[0] == [gone]
    assert got[1] == [
        gone,
        "Field 'id' does not match pattern",
        "Field 'size' must be at least 1",
        "Field 'kind' must be one of: ['a', 'b']",
        "Field 'kind' must be at most 3 characters",
        "Field 'mail' must be a valid email",
        "Field 'web' must be a valid URL",
        "Field 'tel' must be a valid phone number",
    ]
    assert got[2] == [
        "Missing required field: id",
        gone,
        "Field 'id' is required",
        "Field 'id' does not match pattern",
        "Field 'size' must be a number",
        "Field 'size' must be a number",
    ]
    assert got[3] == ["Missing required field: id", gone]


def test_quarantine_and_report(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, name string")
    checked = validate_records(df, {"required": ["name"]})
    good, bad = quarantine(checked)
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]
    assert [tuple(r) for r in validation_summary(checked).collect()] == [("Missing required field: name", 2)]
    report = bulk_job_report(checked).first()
    assert (report["total_rows"], report["error_rows"], report["progress_percent"]) == (3, 2, 100.0)
    empty = bulk_job_report(checked.limit(0)).first()
    assert empty["progress_percent"] == 0.0


def test_registered_rule(spark):
    register_rule("even", lambda f, v, on: F.when(v % 2 != 0, F.lit(f"{f} is odd")) if on else None)
    df = spark.createDataFrame([(1,), (2,)], "n int")
    got = [r["errors"] for r in validate_records(df, {"fields": {"n": {"even": True}}}).collect()]
    assert got == [["n is odd"], []]
