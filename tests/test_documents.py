"""Documents cut by many tasks hold what one parser finds in them."""

import json
import random

import pytest

from parcelweave.sources.documents import split_document
from parcelweave.sources import files


@pytest.fixture(params=["2000", "134217728"])
def block_size(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for name in names:
        spark.conf.set(name, request.param)
    yield int(request.param)
    for name, value in before.items():
        spark.conf.set(name, value)


def value(r, deep=0):
    kind = r.random()
    if kind < 0.4:
        return "".join(r.choice('a}{][",\\\n é') for _ in range(r.randint(0, 30))) + r.choice(["", '"features":['])
    if kind < 0.6 or deep > 3:
        return r.choice([None, True, r.randint(-5, 5)])
    if kind < 0.8:
        return [value(r, deep + 1) for _ in range(r.randint(0, 4))]
    return {str(i) + r.choice(['"', "}", "x", "\\"]): value(r, deep + 1) for i in range(r.randint(0, 3))}


def item(r, i):
    return {"id": i, "v": {"features": [value(r, 1)]}, "w": value(r, 1)}


def found(spark, folder):
    return sorted(json.dumps(json.loads(x["value"]), sort_keys=True) for x in spark.read.text(folder).collect())


def put(path, document, r):
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps(document, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5))


def test_arrays(spark, tmp_path, block_size):
    r, want = random.Random(3), []
    for name, n in (("a", 60), ("b", 0), ("c", 1), ("d", 40)):
        items = [item(r, i) if r.random() < 0.8 else r.choice([1, None, 'x}{["\\', "]", "", {}]) for i in range(n)]
        put(tmp_path / "in" / f"{name}.json", items, r)
        want += [x for x in items if isinstance(x, dict)]
    (tmp_path / "in" / "e.json").write_text("")
    (tmp_path / "in" / "f.json").write_text('﻿ {"only":\r\n{"one": "}"}}\n')
    want.append({"only": {"one": "}"}})
    assert found(spark, split_document(spark, str(tmp_path / "in"))) == sorted(json.dumps(x, sort_keys=True) for x in want)


def test_members(spark, tmp_path, block_size):
    r, want = random.Random(4), []
    for name, n in (("a", 60), ("b", 0), ("c", 1), ("d", 40)):
        features = [item(r, i) for i in range(n)]
        around = {"meta": {"features": [{"z": 1}, {"y": 2}]}, "crs": {"p": {"q": "x"}}, "say": '"features":[{'}
        after = {"other": [{"n": 1}, {"n": {"m": 2}}], "tail": {"a": {"b": 1}}}
        put(tmp_path / "in" / f"{name}.json", {**around, "features": features, **after}, r)
        want += features
    put(tmp_path / "in" / "without.json", {"meta": {"features": [{"z": 1}]}}, r)
    assert found(spark, split_document(spark, str(tmp_path / "in"), "features")) == sorted(json.dumps(x, sort_keys=True) for x in want)


def test_defined_faults(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a":1},{"a":2},{"a"')
    assert found(spark, split_document(spark, str(tmp_path / "cut.json"))) == ['{"a": 1}', '{"a": 2}']
    (tmp_path / "cut.json").write_text('[{"a":1},{"a":2')
    assert found(spark, split_document(spark, str(tmp_path / "cut.json"))) == ['{"a": 1}']
    (tmp_path / "nested.json").write_text('[{"a":1},[{"a":2}],{"a":3}]')
    with pytest.raises(Exception, match="an array itself"):
        split_document(spark, str(tmp_path / "nested.json"))


def test_same_rows_as_one_task(spark, tmp_path, block_size):
    items = [{"a": i, "b": {"c": "x" * (i % 50)}} for i in range(500)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(items))
    schema = "a int, b struct<c:string>"
    one = spark.read.schema(schema).option("multiLine", True).json(str(path))
    many = files.read_source(spark, str(path), schema=schema)
    assert sorted(many.collect()) == sorted(one.collect())
    assert dict(files.read_source(spark, str(path)).dtypes) == {"a": "bigint", "b": "struct<c:string>"}
