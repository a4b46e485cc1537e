"""Jaccard join, exact top-k, sharding and preferences against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelweave.llm import near, preference, sharding, topk
from tests.llm.conftest import texts_of, words


def plain_set(text, n=5):
    found, word = [], ""
    for c in (text or "") + " ":
        low = c.lower() if len(c.lower()) == 1 else c
        if low.isalpha() or low.isnumeric():
            word += low
        elif word:
            found.append(word)
            word = ""
    grams = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
    return frozenset(grams or ({tuple(found)} if found else ()))


def plain_classes(texts, threshold=0.8):
    """(id, class, links) of every row by comparing all sets that share an n-gram."""
    sets = [plain_set(t) for _, t in texts]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    holders = defaultdict(list)
    for i, s in enumerate(distinct):
        for gram in s:
            holders[gram].append(i)
    parent, links = list(range(len(distinct))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(distinct):
        for j in {j for gram in s for j in holders[gram] if j > i}:
            both = len(s & distinct[j])
            if both >= threshold * (len(s) + len(distinct[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    at = {s: i for i, s in enumerate(distinct)}
    ids = defaultdict(list)
    for (own, _), s in zip(texts, sets):
        if s:
            ids[root(at[s])].append(own)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((own, least[root(at[s])] if s else own, links[at[s]] if s else 0) for (own, _), s in zip(texts, sets))


def near_copies(n):
    """A crowd around one text, each copy with other edits, plus pairs, chains and strangers."""
    base = words(50, 300).split()
    rows = []
    for i in range(n):
        copy = list(base)
        copy[(7 * i) % 300] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    for i in range(40):
        own = words(100 + i, 80)
        rows += [(1000 + 3 * i, own), (1001 + 3 * i, own + " tail"), (1002 + 3 * i, own.upper() + "!")]
    chain = words(7, 120).split()
    for i in range(10):
        rows.append((2000 + i, " ".join(chain)))
        chain[12 * i] = f"link{i}"
    return rows


def result(docs, **settings):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near.near_duplicates(docs, settings=near.Settings(**settings)).collect())


@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_classes_and_links_on_tables(request, which):
    docs = request.getfixturevalue(which)
    assert result(docs) == plain_classes(texts_of(docs))


@pytest.mark.parametrize("small,block,hashes", [(32, 256, 500_000), (4, 8, 500_000), (1, 1000, 900)])
def test_crowds_and_pairs_give_the_same(spark, monkeypatch, small, block, hashes):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_HASHES", hashes)
    rows = near_copies(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(docs)
    assert got == plain_classes(rows)
    assert len({c for i, c, _ in got if i < 60}) == 1


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.9999)):
        bands, rows = near.Settings(threshold=threshold, recall=recall).bands()
        assert bands * rows <= 160 and 1 - (1 - threshold**rows) ** bands >= recall


def test_one_of_each_class_stays(spark, odd_docs, odd_texts):
    rows = near_copies(40)
    docs = spark.createDataFrame([(i, t, "kept") for i, t in [*rows, rows[0], rows[1]]], "doc_id long, text string, kept string")
    kept = near.keep_one(docs)
    assert kept.schema == docs.schema
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({c for _, c, _ in plain_classes(rows)})
    odd = near.keep_one(odd_docs)
    left = Counter(t for _, t in texts_of(odd) if plain_set(t))
    assert max(left.values()) == 1
    assert Counter(t for _, t in texts_of(odd) if not plain_set(t)) == Counter(t for _, t in odd_texts if not plain_set(t))


def plain_top(vectors, k=20, scale=64):
    rows = []
    for own, v in vectors:
        if own is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((own, [math.floor(scale * x) for x in v]))
    out = []
    for at, (own, q) in enumerate(rows):
        if own % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), other) for place, (other, c) in enumerate(rows) if place != at)
            out += [(own, rank, other, -score) for rank, (score, other) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(4096, 2048), (37, 5)])
def test_top_k(spark, block, queries):
    import random

    pick = random.Random(9)
    scale = [3.0, 1.0, 1.0, 0.1, 0.1, 0.01, 0.01, 0.0]
    vectors = [(i, [pick.gauss(0, s) for s in scale]) for i in range(300)]
    vectors += [(300 + i, [0.5] * 8) for i in range(60)] + [(400, [0.0] * 8), (420, None), (440, [1.0, None] * 4), (460, [float("nan")] * 8)]
    vectors += [(None, [1.0] * 8), (480, [float("inf")] * 8), (500, [0.25] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, settings=topk.Settings(block=block, queries=queries))
    assert sorted(map(tuple, got.collect())) == plain_top(vectors)


@pytest.mark.parametrize("id_col", ["id", "norm", "block", "vec_id"])
def test_top_k_of_repeated_rows_under_any_name(spark, id_col):
    import random

    pick = random.Random(3)
    vectors = [(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    vectors += [vectors[0]] * 3 + [vectors[20]] + [(40, [5.0, 0.0, 0.0, 0.0])] + [vectors[7]] * 30
    df = spark.createDataFrame(vectors, f"{id_col} long, embedding array<double>").repartition(4)
    few = topk.Settings(block=10, queries=2, group=2, chunk=2)
    got = topk.top_k(df, F.col(id_col) % 20 == 0, id_col=id_col, settings=few)
    assert got.columns == ["query_id", "rank", id_col, "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(vectors)


def test_top_k_refuses_clashing_names_and_skips_the_rotation_of_wide_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, -2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, settings=topk.Settings(widest=2))
    assert sorted(map(tuple, got.collect())) == plain_top([tuple(r) for r in df.collect()])
    for name in ("rank", "__row"):
        with pytest.raises(ValueError):
            topk.top_k(df.withColumnRenamed("vec_id", name), F.col(name) % 20 == 0, id_col=name)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, [0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(few, schema), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain_top(few)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame(few[2:], schema), F.col("vec_id") % 20 == 0).collect() == []


def plain_shards(texts, limit):
    def bits(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) >> 2

    rows = [(i, len((t or "").encode()), bits("" if i is None else str(i)) << 30 | bits(t or "")) for i, t in texts]
    sums, out, dealt = Counter(), Counter(), Counter()
    for _, size, h in rows:
        for depth in range(61):
            sums[depth, h >> (60 - depth)] += size
    for i, size, h in rows:
        depth = min((d for d in range(61) if sums[d, h >> (60 - d)] <= limit), default=60)
        whole = sums[depth, h >> (60 - depth)]
        part = 0
        if whole > limit:
            part = dealt[h] // max(limit // max(size, 1), 1)
            dealt[h] += 1
        out[i, size, depth, h >> (60 - depth), part, whole] += 1
    return out


@pytest.mark.parametrize("limit", [500, 20_000, 10_000_000])
@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_shards(request, which, limit):
    docs = request.getfixturevalue(which)
    rows = sharding.shard_rows(docs, limit).collect()
    got = Counter((r["doc_id"], r["bytes"], r["depth"], r["prefix"], r["part"], r["shard_bytes"]) for r in rows)
    assert got == plain_shards(texts_of(docs), limit)


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DEAL", 7)
    docs = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y")], "doc_id long, text string")
    rows = sharding.shard_rows(docs, 250).collect()
    assert Counter((r["doc_id"], r["part"]) for r in rows) == Counter({(2, 0): 1, **{(1, p): 2 for p in range(25)}})


def test_shard_files(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"), 30_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.drop("shard").exceptAll(documents).isEmpty() and back.count() == documents.count()
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 30_000 or r["n"] == 1 for r in sizes)


def test_shard_files_of_equal_rows_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    same = spark.createDataFrame([(1, "x" * 1000, i % 2) for i in range(40)] + [(2, "y", 0)], "doc_id long, text string, extra int").repartition(4)
    sharding.write_shards(same, f"{tmp_path}/same", 2000)
    back = spark.read.parquet(f"{tmp_path}/same")
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert back.drop("shard").exceptAll(same).isEmpty() and back.count() == 41 and len(sizes) >= 20 and all(r["b"] <= 2000 for r in sizes)
    sharding.write_shards(odd_docs, f"{tmp_path}/odd", 5000)
    odd = spark.read.schema(odd_docs.schema).parquet(f"{tmp_path}/odd")
    assert odd.drop("shard").exceptAll(odd_docs).isEmpty() and odd.count() == odd_docs.count()
    sharding.write_shards(no_docs, f"{tmp_path}/none", 5000)
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
    for name in ("shard", "__hash"):
        with pytest.raises(ValueError):
            sharding.write_shards(same.withColumnRenamed("extra", name), f"{tmp_path}/refused", 2000)


def plain_preference(chosen, rejected):
    def render(turns, base):
        text, mask = "", []
        for role, body in turns:
            head = f"<|{role}|>\n"
            if role == "assistant":
                mask.append((len(text) + len(head), len(text) + len(head) + len(body) + 8))
            text += head + body + "<|end|>\n"
        return (text, [] if base else mask)

    common = 0
    while common < min(len(chosen), len(rejected)) and chosen[common] == rejected[common]:
        common += 1
    prompt, _ = render(chosen[:common], True)
    out = [common, prompt]
    sides = [render(s[common:], False) for s in (chosen, rejected)]
    out += [s[0] if turns else None for s, turns in zip(sides, (chosen, rejected))]
    return (*out, *[tuple(s[1]) for s in sides])


CONVERSATIONS = {
    1: ([("user", "hi"), ("assistant", "good")], [("user", "hi"), ("assistant", "bad"), ("user", "why")]),
    2: ([("user", "a")], [("user", "a")]), 3: ([("user", None)], [("user", "")]), 4: ([], [("assistant", "alone")]),
    5: ([("assistant", "x"), ("user", "y"), ("assistant", "z")], [("user", "other")]), 6: ([(None, "r")], []),
    7: ([("user", "a"), ("assistant", "b")], [("user", "a")]),
}


def test_preferences(spark):
    frames = []
    for side in (0, 1):
        rows = [(i, n, r, t, "x") for i, pair in CONVERSATIONS.items() for n, (r, t) in enumerate(pair[side])]
        rows += rows[:2] + [(None, 0, "user", "x", "x"), (1, None, "user", "x", "x")]
        df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, pair string")
        frames.append(preference.turns_of(df, "conv"))
    got = {
        r["pair"]: (
            r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"],
            *[tuple((m["begin"], m["end"]) for m in r[f"{s}_mask"]) for s in preference.SIDES],
        )
        for r in preference.format_preferences(*frames).collect()
    }
    clean = {i: tuple([(r or "", t or "") for r, t in side] for side in pair) for i, pair in CONVERSATIONS.items()}
    assert got == {i: plain_preference(*pair) for i, pair in clean.items()}
    empty = preference.turns_of(spark.createDataFrame([], "conv long, turn int, role string, text string"), "conv")
    assert preference.format_preferences(empty, empty).collect() == []
    assert preference.swapped_answers(empty).collect() == []


def test_swapped_answers(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "bye"), (3, 0, "assistant", "b"), (5, 0, "assistant", "c")]
    turns = preference.turns_of(spark.createDataFrame(rows, "conv long, turn int, role string, text string"), "conv")
    got = sorted(map(tuple, preference.swapped_answers(turns).collect()))
    assert got == [(2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "assistant", "a")]


def test_gathered_and_row_forms_agree(spark):
    """Examples from arrays of turns equal those from rows of turns, for sides that are absent, equal, prefixes or long."""
    pick = random.Random(8)
    rows = []
    for conv in range(120):
        if conv % 11 == 0:
            continue
        for turn in range(pick.randint(1, 9)):
            # Conversations of two neighbours often say the same.
            text = pick.choice(["a", "b", "", None, "\u00e9\U0001f600" * pick.randint(0, 400)])
            rows.append((conv, turn * 2, pick.choice(["user", "assistant", None]), text))
    rows += rows[:40]
    rows.append((7, 2, "assistant", "two turns of one number"))
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string").repartition(3)
    turns = preference.turns_of(df, "conv")
    plain = preference.examples(preference.segments(turns, preference.swapped_answers(turns)))
    pairs = preference.swapped_pairs(preference.gathered(turns))
    columns = plain.columns
    want = sorted(map(repr, plain.collect()))
    assert want == sorted(map(repr, preference.paired_examples(pairs).select(columns).collect()))
    assert want == sorted(map(repr, preference.format_preferences(turns, preference.swapped_answers(turns)).select(columns).collect()))
    half = turns.filter("pair % 2 = 0")
    want = sorted(map(repr, preference.examples(preference.segments(half, turns)).collect()))
    assert want == sorted(map(repr, preference.format_preferences(half, turns).collect()))
    assert preference.paired_examples(preference.swapped_pairs(preference.gathered(turns.limit(0)))).collect() == []
