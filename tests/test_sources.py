import pytest
from pyspark.sql import functions as F

from conftest import rows
from parcelweave.operators.validation import validate_records
from parcelweave.sources import files, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,name\n1,"x, ""y"""\n2\n')
    df = files.read_csv_source(spark, path)
    assert rows(df) == [("1", 'x, "y"'), ("2", None)]
    assert files.source_columns(df) == ["id", "name"] and files.source_row_count(df).first()["rows"] == 2
    quoted = put(tmp_path, "q.csv", 'id;name\n1;"two\nlines"\n')
    assert rows(files.read_csv_source(spark, quoted, delimiter=";", multiline=True)) == [("1", "two\nlines")]


def test_csv_columns_go_by_name(spark, tmp_path):
    for name, text in (("1.csv", "id,name\n1,ann\n"), ("2.csv", 'name,id\n"bob, b",2\n'), ("3.csv", "id\n3\n")):
        put(tmp_path, f"d/{name}", text)
    path = str(tmp_path / "d")
    want = [("1", "ann"), ("2", "bob, b"), ("3", None)]
    assert rows(files.read_csv_source(spark, path, by_name=True, columns=["id", "name"])) == want
    assert rows(files.read_csv_source(spark, path, by_name=True), "id", "name") == want
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv_source(spark, path, columns=["id", "name"]).collect()
    with pytest.raises(ValueError, match="headers"):
        files.csv_profile(spark, path)


def test_bad_json_lines_are_kept(spark, tmp_path):
    text = '{"a":1}\n\n{"a":\nnot json\n{"a":"x"}\n{"a":2,"b":{"c":"y"}}\n'
    good, bad = files.split_json_lines(spark, put(tmp_path, "l.jsonl", text), "a int, b struct<c:string>", flatten=True)
    assert rows(good) == [(1, None), (2, "y")]
    assert sorted(r["line"] for r in bad.collect()) == ["not json", '{"a":', '{"a":"x"}']
    assert all(r["file"].endswith("l.jsonl") for r in bad.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a,b\n1,2\n", (2, 1, 0, True)),
        ("a,b\n1\n", (2, 1, 0, True)),
        ("a,b\n1,2,3\n4,5\n", (2, 2, 1, False)),
        ("a,b\n", (2, 0, 0, False)),
    ],
)
def test_csv_profile(spark, tmp_path, text, want):
    assert tuple(files.csv_profile(spark, put(tmp_path, "p.csv", text)).first()) == want


def test_json_forms(spark, tmp_path):
    schema = "a int, b struct<c:string,d:array<int>>"
    lines = put(tmp_path, "l.jsonl", '{"a":1,"b":{"c":"x","d":[1,2]}}\n\nnot json\n{"a":2}\n')
    flat = files.read_json_source(spark, lines, "lines", schema, flatten=True)
    assert flat.columns == ["a", "b.c", "b.d"]
    assert rows(flat) == [(1, "x", [1, 2]), (2, None, None)]
    array = put(tmp_path, "a.json", '[{"a":1},\n {"a":3}]')
    assert rows(files.read_source(spark, array, schema="a int")) == [(1,), (3,)]
    single = put(tmp_path, "o.json", '{\n"a": 5\n}')
    assert rows(files.read_json_source(spark, single, "object", "a int")) == [(5,)]
    with pytest.raises(ValueError):
        files.read_json_source(spark, single, "guess")


def test_geojson(spark, tmp_path):
    text = """{"type":"FeatureCollection","features":[
    {"type":"Feature","id":"f1","geometry":{"type":"Point","coordinates":[-112.5,33.25]},"properties":{"p":1}},
    {"type":"Feature","id":0,"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]},"properties":{"p":2}},
    {"type":"Feature","geometry":null,"properties":{"p":3}}]}"""
    df = files.read_source(spark, put(tmp_path, "g.geojson", text), properties="p int")
    assert rows(df) == [(1, "f1", -112.5, 33.25), (2, None, None, None), (3, None, None, None)]


def test_routes():
    assert files.route_by_extension("/x/Y.CSV") == "csv"
    for bad in ("/x/y.shp", "/x/y"):
        with pytest.raises(ValueError):
            files.route_by_extension(bad)


def test_file_ledger(spark, tmp_path):
    put(tmp_path, "in/a.csv", "same")
    put(tmp_path, "in/b.csv", "same")
    put(tmp_path, "in/c.csv", "new")
    put(tmp_path, "in/sub/d.csv", "deep")
    base = str(tmp_path / "in")
    assert files.list_source_files(spark, base, "*.csv").count() == 3
    assert files.list_source_files(spark, base, "*.csv", recursive=True).count() == 4
    hashes = files.file_hashes(spark, base, "*.csv")
    first = files.new_files(hashes, hashes.limit(0))
    assert sorted(r["path"].split("/")[-1] for r in first.collect()) == ["a.csv", "c.csv"]
    assert files.new_files(hashes, first).count() == 0


def test_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib

    from parcelweave.sources import streams

    monkeypatch.setattr(streams, "PIECE", 1000)
    body = bytes(range(256)) * 40
    (tmp_path / "a b%20.bin").write_bytes(body)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r["path"].split("/")[-1]: r["file_hash"] for r in files.file_hashes(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"a b%20.bin": hashlib.sha256(body).hexdigest()}  # a listing leaves empty files out
    assert streams.digest(f"file:{tmp_path}/a b%20.bin") == hashlib.sha256(body).hexdigest()
    monkeypatch.setattr(streams, "FIRST", 3)
    put(tmp_path, "h.csv", '\n"a, b",name\r\n1,2\n')
    (tmp_path / "h.csv.gz").write_bytes(gzip.compress(b"x,y\n" + b"1,2\n" * 100_000))
    put(tmp_path, "none.csv", "")
    found = [streams.header(f"{tmp_path}/{name}", ",") for name in ("h.csv", "h.csv.gz", "none.csv")]
    assert found == [["a, b", "name"], ["x", "y"], []]
    assert streams.can_stream("/x") and streams.can_stream("s3a://b/x") and not streams.can_stream("wasb://b/x")


def test_seeds(spark, tmp_path):
    path = put(tmp_path, "s.csv", "url,priority\nhttp://a,5\n,1\nhttp://b,x\n")
    assert rows(files.seed_load(spark, path, "web")) == [("http://a", "web", 5), ("http://b", "web", 0)]


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([("p", "1", 1, "old"), ("p", "1", 2, "new"), ("q", "1", 1, "x")], "platform string, id string, seq int, v string")
    sinks.write_results(df, path, ["seq"])
    assert [r["v"] for r in sinks.read_result(spark, path, "p", "1").collect()] == ["new"]
    plan = sinks.read_result(spark, path, "p", "1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan and "EqualTo(id,1)" in plan
    ids = spark.createDataFrame([("7", "a"), ("", "b"), (None, "b")], "pid string, fb string")
    got = [r[0] for r in ids.select(sinks.result_id(F.col("pid"), F.col("fb"))).collect()]
    assert got[0] == "bulk_7" and got[1] == got[2] and len(got[1]) == 64


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    sinks.append_csv_sink(df, path)
    sinks.append_csv_sink(df, path)
    assert rows(spark.read.csv(path)) == [("1", "a")] * 2


def test_checked_write_reads_the_source_once(spark, tmp_path):
    path = str(tmp_path / "checked")
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "i int, s string")
    counts = sinks.write_checked(validate_records(df, {"required": ["s"]}), path)
    assert counts == {"total_rows": 3, "error_rows": 1}
    good, bad = sinks.read_checked(spark, path)
    assert rows(good) == [(1, "a"), (3, "c")] and rows(bad, "i", "errors") == [(2, ["Missing required field: s"])]
