"""Pairwise ranking: features and strengths by the book, planted quality, cuts by quantiles, odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelweave.llm import ranker
from parcelweave.llm.arrays import Texts
from parcelweave.llm.queries import QUERIES
from tests.llm.conftest import texts_of

#: Labels enough to learn from: the smallest tables hold some sixty.
SF = "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    """The measures that need no class of characters, by plain Python."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    counts = Counter(words)
    couples = list(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    share = lambda a, b: a / b if b else 0.0
    entropy = math.log(n) - sum(c * math.log(c) for c in counts.values()) / n if n > 1 else 0.0
    return [
        math.log1p(n), math.log1p(len(text)), math.log1p(share(sum(map(len, words)), n)), share(len(counts), n),
        share(max(counts.values(), default=0), n), share(sum(a == b for a, b in couples), n), share(len(set(couples)), len(couples)),
        entropy / math.log(max(n, 2)), math.log1p(len(lines)), share(len(lines) - len(set(lines)), len(lines)), math.log1p(share(n, len(lines))),
    ]


def test_measures_by_plain_python(odd_texts, documents):
    texts = [t for _, t in odd_texts] + [t for _, t in texts_of(documents)[:60]]
    rows = ranker.features(Texts(pa.array(texts)))
    assert rows.shape == (len(texts), ranker.WIDTH)
    for text, row in zip(texts, rows):
        np.testing.assert_allclose(row[:11], plain_measures(text), atol=2e-5)


def test_class_pairs_and_kinds_of_words():
    row = ranker.features(Texts(pa.array(["aB cD", "", "1 -- É"])))
    pairs = row[:, ranker.MEASURES :].reshape(3, ranker.KINDS, ranker.KINDS) ** 2
    assert np.isclose(pairs[0, ranker.LOWER, ranker.UPPER], 2 / 4) and np.isclose(pairs[0, ranker.SPACE, ranker.LOWER], 1 / 4)
    assert not row[1].any() and np.allclose(pairs.reshape(3, -1).sum(axis=1), [1, 0, 1])
    assert np.isclose(row[2, 11], 2 / 3)


def test_fit_minimises_the_pairwise_loss():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(60, ranker.WIDTH)).astype(np.float32)
    rows[:, 5:] = 0
    strength = rows[:, 0] - 2 * rows[:, 3]
    a, b = rng.integers(0, 60, (2, 800))
    wins = rng.random(800) < 1 / (1 + np.exp(strength[b] - strength[a]))
    better, worse = np.where(wins, a, b)[a != b], np.where(wins, b, a)[a != b]
    model = ranker.fit(rows, better, worse)

    def loss(weight):
        wide = ranker.unfold(rows, model.knots)
        scale = wide.std(axis=0)
        apart = (wide[better] - wide[worse]) @ weight
        return np.log1p(np.exp(-apart)).mean() + ranker.Settings().ridge / 2 * ((weight * scale) ** 2).sum()

    least = loss(model.weight)
    for at in np.flatnonzero(model.weight):
        for step in (-1e-3, 1e-3):
            moved = model.weight.copy()
            moved[at] += step
            assert loss(moved) >= least - 1e-12
    assert np.corrcoef(model.strengths(rows), strength)[0, 1] > 0.95


def noisy(n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(20, 120))]
        bad = i % 5 == 0
        kind = i % 4
        if bad:
            words = [w.upper() + "!!" for w in words] if kind == 0 else words[:2] * 30 if kind == 1 else [w + "$$" for w in words]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame(noisy(900), "doc_id long, text string, quality int").repartition(3)


def test_quality_on_held_out_rows(spark, rated):
    held = ranker.is_held_out(F.col("doc_id"))
    model, sample = ranker.train(rated.drop("quality"), rated.filter(~held).select("doc_id", "quality"))
    scored = ranker.strengths(rated, model)
    cut = ranker.strength_cut(scored, sample)
    assert 0.15 < cut.level < 0.25
    kept = ranker.keep_best(rated, model, cut)
    assert kept.schema == rated.schema and kept.filter(held).exceptAll(rated.filter(held & (F.col("quality") == 1))).count() == 0
    assert kept.filter("quality = 1").count() == 720


def test_given_pairs_teach_the_same_order(spark, rated):
    good, bad = rated.filter("quality = 1").select(F.col("doc_id").alias("better")), rated.filter("quality = 0").select(F.col("doc_id").alias("worse"))
    pairs = good.join(bad, F.col("better") % 36 == F.col("worse") % 36)
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 3), (999_999, 1)], "better long, worse long")
    model = ranker.train_on_pairs(rated, pairs.unionByName(odd))
    rows = ranker.strengths(rated, model).join(rated.select("doc_id", "quality"), "doc_id").collect()
    assert min(r["strength"] for r in rows if r["quality"]) > max(r["strength"] for r in rows if not r["quality"])
    nothing = ranker.train_on_pairs(rated, odd)
    assert not nothing.weight.any()


@pytest.mark.parametrize("level", [0.0, 0.1, 0.5, 0.99])
def test_cut_at_a_given_quantile(spark, level):
    values = [float(v) for v in np.random.default_rng(2).integers(-400, 400, 3000) / 16]
    scored = spark.createDataFrame([(v,) for v in values], "strength double")
    cut = ranker.strength_cut(scored, settings=ranker.Settings(level=level))
    below = sum(v < cut.strength for v in values) / len(values)
    assert below <= level and math.isclose(below, cut.level)
    above = sorted(v for v in values if v >= cut.strength)
    assert sum(v <= above[0] for v in values) / len(values) > level


def test_odd_rows_and_missing_labels(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (None, 1), (9, None), (12, 0), (404, 1)], "doc_id long, quality int")
    model, sample = ranker.train(odd_docs, labels)
    rows = ranker.strengths(odd_docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd_texts) and all(math.isfinite(r["strength"]) for r in rows)
    kept = ranker.keep_best(odd_docs, model, ranker.strength_cut(ranker.strengths(odd_docs, model), sample))
    assert kept.columns == odd_docs.columns
    for few in ([], [(1, None)], [(1, 1), (2, 1)], [(404, 0), (404, 1)]):
        model, sample = ranker.train(odd_docs, spark.createDataFrame(few, "doc_id long, quality int"))
        scored = ranker.strengths(odd_docs, model)
        cut = ranker.strength_cut(scored, sample)
        assert ranker.keep_best(odd_docs, model, cut).count() == len(odd_texts)
        assert {r[0] for r in scored.select(ranker.chance(F.col("strength"), cut, 0.3)).collect()} == {0.5}
    model, sample = ranker.train(no_docs, labels)
    assert ranker.strength_cut(ranker.strengths(no_docs, model), sample).level == 0 and ranker.strengths(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        ranker.strengths(odd_docs.withColumnRenamed("doc_id", "strength_").withColumn("strength", F.lit(1)), model, id_col="strength")


def test_query_follows_its_contract(spark):
    rows = QUERIES["op11_pairwise_quality"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    right = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        right += r["doc_id"] in labels and r["held_out"] and r["predicted"] == labels[r["doc_id"]]
    assert right >= 0.9 * sum(r["held_out"] and r["doc_id"] in labels for r in rows)
