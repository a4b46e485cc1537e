"""Merkle manifest: proofs by descent against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parcelweave.llm import merkle
from parcelweave.llm.queries import LEAF_FIELDS, QUERIES
from tests.llm.conftest import SF

KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def together(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_leaf(row, text):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return together(*values)


def plain_tree(level):
    """The last digest, and for every leaf its siblings (before, after) level by level."""
    paths, places = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, at in zip(paths, places):
            first = at // 16 * 16
            path.append((level[first:at], level[at + 1 : first + 16]))
        level = [together(*level[i : i + 16]) for i in range(0, len(level), 16)]
        places = [at // 16 for at in places]
    return level[0], paths


def plain_rows(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees.append((own, *plain_tree([plain_leaf(r, r[4]) for r in own])))
    if not trees:
        return []
    root, tops = plain_tree([subroot for _, subroot, _ in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for row, path in zip(own, paths):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            folded = plain_leaf(row, text)
            for before, after in path + top:
                folded = together(*before, folded, *after)
            proof = together(*[d for before, after in path + top for d in before + after])
            out.append((row[0], plain_leaf(row, row[4]), subroot, root, proof, folded, folded == root))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*LEAF_FIELDS).collect()]


def run_on(spark, rows, tmp_path):
    spark.createDataFrame(rows, KINDS).withColumn("rank", F.lit("clash")).withColumn("leaf", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=repr)


def test_query_against_plain_trees(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    found = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_rows(rows), key=repr)
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 1), (17, 3, 1), (257, 16, 2, 1), (300, *[1] * 17)])
def test_trees_of_every_height(spark, tmp_path, sizes):
    rows = [(i, f"s{s}", "en", 3, f"Text {i}") for s, n in enumerate(sizes) for i in range(s * 1000, s * 1000 + n)]
    assert run_on(spark, rows, tmp_path) == sorted(plain_rows(rows), key=repr)


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None, None), (None, None, "en", 0, ""), (None, "", "", 1, "A"), (2, "é", "x", 5, "É ABC \U0001f600"), (-7, "é", "x", 5, "ab"),
        (5, "z", "en", 1, "Tie"), (5, "z", "en", 1, "Other tie"), (5, "a", "en", 9, "X" * 300_000),
        *[(9, "z", "en", 1, "Same Row")] * 40,
    ]
    assert run_on(spark, rows, tmp_path) == sorted(plain_rows(rows), key=repr)


def test_empty_table(spark, tmp_path):
    assert run_on(spark, [], tmp_path) == []
    manifest = merkle.build(spark.read.parquet(f"{tmp_path}/documents.parquet"), LEAF_FIELDS, "source", "doc_id")
    assert manifest.root is None


def test_requests_for_some_leaves_only(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(700)], KINDS)
    manifest = merkle.build(docs, LEAF_FIELDS, "source", "doc_id", {"id": F.col("doc_id")})
    every = manifest.leaves(spark).select("tree", "rank", "c_id")
    asked = every.filter("c_id in (0, 1, 333, 699)").unionByName(spark.createDataFrame([(0, 5000, -1), (9, 0, -2)], every.schema))
    found = merkle.proofs(spark, manifest, asked).withColumn("root", merkle.fold(merkle.hexadecimal(F.col("leaf")), F.col("path"))).collect()
    assert sorted(r["c_id"] for r in found) == [0, 1, 333, 699]
    assert {r["root"] for r in found} == {manifest.root}


def test_records_hold_each_digest_once(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "same")] * 512, KINDS)
    manifest = merkle.build(docs, LEAF_FIELDS, "source", "doc_id")
    assert [manifest.records(spark, "group", h).count() for h in (1, 2, 3)] == [1, 1, 1]
