"""Prefix trie against plain Python over dictionaries of sequences."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.llm import trie
from parcelweave.llm.queries import QUERIES
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "conv_id long, turn long, role string, text string"


def said(turn):
    return hashlib.sha256(f"{len(turn[1].encode())}:{turn[1]}{turn[2]}".encode()).digest()


def plain_nodes(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    ordered = {
        c: [t[1:] for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), said(t)))] for c, turns in own.items()
    }
    built = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = tuple(ordered.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        own = members[node]
        below = children[node]
        saved = sum(out[c][6] for c in below) + ((len(own) - 1) * len(WORD.findall(node[-1][1])) if node else 0)
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(node))))
        out[node] = (
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(below),
            sum(out[c][5] for c in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def run_on(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, KINDS).withColumn("conv", F.lit("clash")).withColumn("digest", F.lit(0)).repartition(5)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()), key=repr)


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, SF).collect()), key=repr)
    assert found == plain_nodes(rows)


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations_with_shared_beginnings(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    stems = [[(f"r{rng.integers(2)}", " ".join(["w"] * rng.integers(0, 4))) for _ in range(14)] for _ in range(3)]
    rows = []
    for c in range(-45, 160):
        if rng.random() < 0.2:
            continue
        stem, keep = stems[rng.integers(3)], rng.integers(0, 14)
        turns = stem[:keep] + [("u", f"x {rng.integers(3)}") for _ in range(rng.integers(0, 6))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    assert run_on(spark, rows, tmp_path) == plain_nodes(rows)


def test_odd_rows(spark, tmp_path):
    long = [(60, i, "user", "a b") for i in range(400)]
    rows = [
        (None, 0, "user", "no id"), (None, None, None, None), (1, None, None, None), (1, None, "user", "null turn"), (1, 3, "user", ""),
        (2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "assistant", "tie a"), (3, 0, "user", "same"), (3, 0, "user", "same"),
        (23, 0, "user", "base is absent"), (40, 5, "user", "x " * 50_000), (41, -1, "é", "\U0001f600 ok"), *long, *[(61, i, r, t) for _, i, r, t in long[:-1]],
    ]
    assert run_on(spark, rows, tmp_path) == plain_nodes(rows)


def test_conversation_of_turns_that_go_away(spark, tmp_path):
    """A conversation without a base may lose all its turns; it stays a member of the root."""
    alone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "gone") for c in alone]
    found = run_on(spark, rows, tmp_path)
    assert found == plain_nodes(rows) == [(min(alone), 0, None, len(alone), 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_empty_table(spark, tmp_path):
    assert run_on(spark, [], tmp_path) == []
    assert run_on(spark, [(None, 1, "user", "x")], f"{tmp_path}/null") == []


def test_many_copies_and_one_long_conversation_over_many_ranges(spark):
    """Copies end at one node, and one key spans several ranges."""
    rows = [(c, i, "user", f"t{i}") for c in range(300) for i in range(3)] + [(5000, i, "user", f"t{i}") for i in range(1500)]
    turns = trie.turns_of(spark.createDataFrame(rows, KINDS).repartition(8))
    assert turns.filter("conv = 5000").agg(F.max("place")).first()[0] == 1499
    found = trie.prefix_trie(turns, turns.filter("place = 0").select("conv")).collect()
    by_depth = {r["depth"]: r for r in found}
    assert len(found) == 1501 and by_depth[3]["n_convs"] == 301 and by_depth[1499]["n_convs"] == 1
    assert by_depth[0]["n_leaves"] == 1 and by_depth[1]["saved_tokens"] == 900
    assert by_depth[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
