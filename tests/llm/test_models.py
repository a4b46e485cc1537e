"""Toxicity and language-model scores: brute force, held-out accuracy, odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.llm import lm, toxicity
from parcelweave.llm.queries import QUERIES
from tests.llm.conftest import SF, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def plain_model(rows, settings):
    """Counts and weights by the book: ``rows`` are (text, learn, dev)."""

    def counts(texts):
        total = [Counter() for _ in range(settings.order)]
        for text in texts:
            tokens = plain_tokens(text)
            for i in range(len(tokens)):
                for k in range(1, settings.order + 1):
                    total[k - 1][gram(tokens, i, k)] += 1
        return total

    def gram(tokens, i, k):
        return ("^",) * max(0, k - 1 - i) + tuple(tokens[max(0, i - k + 1) : i + 1])

    def parts(tokens, i, table, n, learnt):
        share = [1 / (len(table[0]) + 1), table[0][gram(tokens, i, 1)] / max(n, 1)]
        context = n
        for k in range(2, settings.order + 1):
            context = learnt if i == 0 else table[k - 2][gram(tokens, i - 1, k - 1)]
            share.append(table[k - 1][gram(tokens, i, k)] / max(context, 1))
        return share, 1 + int(math.log2(context)) if context else 0

    main = [t for t, learn, dev in rows if learn and not dev]
    table = counts(main)
    n = sum(table[0].values())
    events = [parts(tokens, i, table, n, len(main)) for t, learn, dev in rows if learn and dev for tokens in [plain_tokens(t)] for i in range(len(tokens))]
    weights = lm.first_weights(settings)
    for _ in range(settings.rounds):
        before, gain = weights.copy(), {}
        for share, level in events:
            p = weights[level] * share
            gain[level] = gain.get(level, 0) + p / p.sum()
        for level, g in gain.items():
            weights[level] = g / g.sum()
        if np.abs(weights - before).max() < settings.still:
            break
    seen = sorted(level for level in gain if level) if events else []
    for level in range(1, settings.levels + 1):
        if seen and level not in seen:
            weights[level] = weights[min(seen, key=lambda s: (abs(s - level), s))]
    weights = np.maximum(weights, 1e-6 * (lm.first_weights(settings) > 0))
    weights /= weights.sum(axis=1, keepdims=True)
    learn = [t for t, learn, _ in rows if learn]
    table = counts(learn)
    n, v = sum(table[0].values()), len(table[0])

    def score(text):
        tokens, total, base, known = plain_tokens(text), 0.0, 0.0, 0
        for i in range(len(tokens)):
            share, level = parts(tokens, i, table, n, len(learn))
            total += math.log10(float(np.dot(weights[level], share)))
            c = table[0][gram(tokens, i, 1)]
            base += math.log10((c + 1) / (n + v + 1))
            known += c > 0
        return len(tokens), known, n, base, total

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_interpolation(spark, documents, order):
    settings = lm.Settings(order=order, dev_folds=4, rounds=6)
    docs = documents.limit(60).cache()
    dev = F.col("doc_id") % 5 == 1
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 7 != 2, settings=settings, dev=dev).collect()}
    texts = texts_of(docs)
    plain = plain_model([(t, i % 7 != 2, i % 5 == 1) for i, t in texts], settings)
    assert len(got) == len(texts) == 60
    for i, t in texts:
        r = got[i]
        n, known, total, base, score = plain(t)
        assert (r["learnt"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 7 != 2, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)
    docs.unpersist()


def test_small_records_and_ranges_change_nothing(spark, documents, monkeypatch):
    docs = documents.limit(40).cache()
    learn = F.col("doc_id") % 7 != 2
    whole = {r["doc_id"]: r for r in lm.score(docs, learn).collect()}
    monkeypatch.setattr(lm, "RANGE_KEYS", 500)
    records = lm.token_records(docs.repartition(7), "doc_id", "text", learn, F.lit(False))
    assert records.count() >= 4
    parts = {r["doc_id"]: r for r in lm.score(docs.repartition(7), learn).collect()}
    for i, row in whole.items():
        assert parts[i]["score"] == pytest.approx(row["score"], rel=1e-6)
        assert parts[i]["n_known"] == row["n_known"]
    docs.unpersist()


def test_odd_and_empty_tables(odd_docs, odd_texts, no_docs):
    got = lm.score(odd_docs, F.lit(True)).collect()
    plain = Counter((i, len(plain_tokens(t))) for i, t in odd_texts)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == plain
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    nothing = lm.score(odd_docs, F.lit(None).cast("boolean")).collect()
    assert len(nothing) == len(odd_texts) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nothing)
    assert lm.score(no_docs, F.lit(True)).collect() == []


def test_held_out_texts_score_above_the_base(spark):
    rows = QUERIES["op2_interpolation"](spark, SF).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


TOXIC = ["zorky", "blurf", "quastik"]


def toxic_rows(n):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 60, 2):
                words[at] = TOXIC[rng.integers(0, 3)] + ("ed" if at % 2 else "")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    docs = spark.createDataFrame(toxic_rows(1200), "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    held = toxicity.is_held_out(F.col("doc_id"))
    model = toxicity.train(docs.drop("toxic"), labels.filter(~held))
    rows = toxicity.score(docs, model).join(labels.filter(held), "doc_id").collect()
    assert len(rows) > 150
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows)
    kept = toxicity.keep_civil(docs, model)
    assert kept.schema == docs.schema and kept.filter("toxic = 1").count() <= 2 and kept.filter("toxic = 0").count() == 900


def test_pairs_say_what_single_terms_do_not():
    """Neither of two terms alone is toxic, both together are: only the factors can tell."""
    settings = toxicity.Settings(bits=4, clear=0.0, least=1, epochs=200, weight=1.0)
    texts = [[1], [2], [3], [1, 2]] * 200
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    label = np.array([float(len(t) == 2) for t in texts])
    model = toxicity.fit(owner, np.concatenate(texts), label, np.array([1, 2, 3]), settings)
    margin = model.margin(np.array([0, 1, 2, 3, 3]), model.index[np.array([1, 2, 3, 1, 2])], 4)
    assert (margin[:3] < 0).all() and margin[3] > 0


def pair_rows(seed, n=4000):
    """A tenth is toxic: most by a word of their own, some by two words that clean texts hold as often, one at a time."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 900, 40)]
        kind = i % 100
        if kind < 2:
            words[3], words[30] = "marrow", "kindle"
        elif kind < 10:
            words[5] = "zorky"
        elif kind < 28:
            words[7] = "marrow"
        elif kind < 46:
            words[9] = "kindle"
        rows.append((i, " ".join(words), int(kind < 10), kind))
    return rows


def test_pairs_of_neutral_terms_are_learnt_with_the_default_settings(spark):
    learnt = spark.createDataFrame(pair_rows(1), "doc_id long, text string, toxic int, kind int")
    held = spark.createDataFrame(pair_rows(2), "doc_id long, text string, toxic int, kind int")
    model = toxicity.train(learnt.select("doc_id", "text"), learnt.select("doc_id", "toxic"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(held, model).collect()}
    assert all((scores[i] >= 0.5) == bool(toxic) for i, _, toxic, _ in pair_rows(2))


def told(rows, label, clear=()):
    """``telling_pairs`` of a sample of term places, in two shares as tasks would test them."""
    settings = toxicity.Settings()
    owner, place = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    rare = toxicity.rarer(label)
    prior, have, bad = rare.mean(), np.bincount(place), np.bincount(place, weights=rare[owner])
    bound = np.log(max((have >= settings.least).sum() ** 2 / 2, 1) / settings.chance)
    among = np.flatnonzero((have >= settings.least) & (bad * -np.log(prior) >= bound))
    able = np.isin(place, np.union1d(among, clear))
    order = np.argsort(place[able], kind="stable")
    sample = toxicity.Sample(label, prior, bound, among, np.array(clear, np.int64), owner[able][order], place[able][order])
    halves = [place % 2 == half for half in (0, 1)]
    return np.unique(np.concatenate([toxicity.telling_pairs(owner[h], place[h], sample, settings, block=7) for h in halves])), sample


def plain_told(rows, label, clear=()):
    """The same by a loop over all pairs of places."""
    settings, rare = toxicity.Settings(), toxicity.rarer(label)
    sets = {}
    for i, row in enumerate(rows):
        for p in row:
            sets.setdefault(int(p), set()).add(i)
    held = sorted(p for p, texts in sets.items() if len(texts) >= settings.least)
    prior, hits_of = rare.mean(), {p: sum(rare[i] for i in sets[p]) for p in held}
    bound, odds = math.log(max(len(held) ** 2 / 2, 1) / settings.chance), math.log(prior / (1 - prior))

    def alone(hits, n):
        share = (hits + 2 * prior) / (n + 2)
        return math.log(share / (1 - share)) - odds

    out = set()
    for x, a in enumerate(held):
        for b in held[x + 1 :]:
            common = sets[a] & sets[b]
            n, hits = len(common), sum(rare[i] for i in common)
            if not n:
                continue
            share = hits / n
            sum_odds = odds + sum(alone(hits_of[p] - hits, len(sets[p]) - n) for p in (a, b))
            product = 1 / (1 + math.exp(-sum_odds))
            tests = []
            if share > prior:
                tests.append(min(max(product, prior, *[hits_of[p] / len(sets[p]) for p in (a, b)]), 1 - 1e-9))
            for p in (a, b):
                q = min(product, hits_of[p] / len(sets[p]), 1 - 1e-9)
                if p in clear and n >= settings.least and q > prior:
                    tests.append(-q)
            for q in tests:
                if (share > q) if q > 0 else (share < -q):
                    q = abs(q)
                    gain = (share * math.log(share / q) if share else 0) + ((1 - share) * math.log((1 - share) / (1 - q)) if share < 1 else 0)
                    if n * gain >= bound:
                        out |= {a, b}
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_telling_pairs_by_a_loop_over_all_pairs(seed):
    rng = np.random.default_rng(seed)
    rows, label = [], []
    for i in range(900):
        terms = set(rng.integers(10, 40, 6).tolist())
        kind = i % 20
        terms |= {1, 2} if kind == 0 else {1} if kind < 4 else {2} if kind < 7 else {3} if kind == 7 else {3, 4} if kind == 8 else {4} if kind < 12 else set()
        rows.append(np.array(sorted(terms)))
        label.append(float(kind in (0, 7) or rng.random() < 0.02))
    label = np.array(label)
    found, _ = told(rows, label, clear=[3])
    assert found.tolist() == plain_told(rows, label, clear=[3]) and {1, 2, 3, 4} <= set(found.tolist())


def test_margin_is_the_double_sum_over_pairs(spark):
    """Terms by plain Python, margins by the definition, and with them the scores of the operator."""
    docs = spark.createDataFrame(pair_rows(1, 800), "doc_id long, text string, toxic int, kind int")
    settings = toxicity.Settings()
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), settings=settings)
    texts = dict(texts_of(docs)) | {-1: "ZORKY zorky marrow kindle quastik", -2: "", -3: None}

    def place(term, length):
        import pyarrow as pa

        from parcelweave.llm.arrays import Texts

        one = Texts(pa.array([term]))
        return int(one.hashes(np.array([0]), np.array([len(term)]))[0] * np.uint64(2 * length + 1) >> np.uint64(64 - settings.bits))

    def score(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        terms = {(w, 0) for w in words} | {(w[:k], k) for w in words for k in settings.prefixes if len(w) > k}
        rows = sorted({int(model.index[place(t, k)]) for t, k in terms} - {-1})
        unit = 1 / math.sqrt(len(rows)) if rows else 0
        margin = model.bias + sum(model.weight[r] * unit for r in rows)
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                margin += float(model.factor[a] @ model.factor[b]) * unit * unit
        return 1 / (1 + math.exp(-margin))

    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        assert math.isclose(r["score"], score(texts[r["doc_id"]]), rel_tol=1e-9)


def test_pairs_that_tell_nothing_stay_out():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.zipf(1.3, 60) % 3000) for _ in range(2000)]
    label = (rng.random(2000) < 0.1).astype(float)
    assert told(rows, label)[0].tolist() == []


def test_a_second_term_can_redeem_a_first():
    rows = [[1]] * 150 + [[2]] * 400 + [[1, 2]] * 60 + [[3]] * 1500
    label = np.array([1.0] * 150 + [0.0] * 1960)
    label[150:190] = 1  # term 2 alone is as toxic as all texts
    assert told([np.array(r) for r in rows], label, clear=[1])[0].tolist() == [1, 2]


def test_terms_are_pairs_once(spark):
    import pyarrow as pa

    from parcelweave.llm.arrays import Texts

    settings = toxicity.Settings()
    owner, place = toxicity.text_terms(Texts(pa.array(["Same same SAME", None, "", "same", "x"])), settings)
    assert owner.tolist() == [0, 3, 4] and place[0] == place[1]
    long = toxicity.text_terms(Texts(pa.array(["longerword", "longerwood"])), settings)
    assert np.bincount(long[0]).tolist() == [5, 5] and len(set(long[1].tolist())) == 6


def test_odd_rows_and_missing_labels(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (None, 1), (9, None), (12, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd_texts)
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.train(odd_docs, labels.filter("false"))
    assert all(r["score"] <= 0.5 for r in toxicity.score(odd_docs, none).collect())
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, None), (2, None)], [(999, 1)], [(1, 1), (2, 1)], [(1, 1), (2, 0), (8, 0)]])
def test_nothing_learnt_drops_nothing(spark, odd_docs, odd_texts, labels):
    model = toxicity.train(odd_docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert Counter(texts_of(toxicity.keep_civil(odd_docs, model))) == Counter(odd_texts)


def test_query_learns_from_no_held_out_label(spark):
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_sorted_hashes_travel_as_steps():
    import numpy as np

    from parcelweave.llm import lm

    r = np.random.default_rng(5)
    for n, bits, span in ((1, 0, 0), (1, 3, 7), (2, 60, 9), (300, 0, 0), (5000, 7, 127), (40, 13, 1)):
        base = span << (64 - bits)
        keys = np.unique(r.integers(0, 1 << (64 - bits), n, dtype=np.uint64, endpoint=False) if bits else r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        keys = keys + np.uint64(base)
        assert (lm._unpack_keys(lm._pack_keys(keys, base), base) == keys).all()
    whole = np.array([0, 2**64 - 1], np.uint64)
    assert (lm._unpack_keys(lm._pack_keys(whole, 0), 0) == whole).all()
