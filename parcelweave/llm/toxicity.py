"""Toxicity by a factorization machine over hashed terms.

Terms are words, in lower case, and their beginnings of several lengths. Each is hashed to one of
``2 ** bits`` places. A place takes part if its own share of toxic texts departs clearly from the
rest, or as one of two whose common texts do so clearly more than the two alone explain
(``telling_pairs``). The machine adds a bias, a weight per term and, for every pair of terms of a text, the inner
product of their factors, so that two terms can say together what neither says alone.

Labels are learnt from a bounded sample of labelled rows (``Settings.sample``); every text is
scored whole. Null and empty texts have no terms and get the bias. A null label teaches nothing;
of several labels of one id the highest counts, and of several texts of one id in the sample the
first by term order. Without any usable label, with labels of one kind alone, or if no term takes
part, nothing was learnt: every score is the same and 0.25 or below, so all texts stay. Rows that
repeat are scored each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from parcelweave.llm.arrays import Texts, blocks, lower
from parcelweave.llm.pretoken import LETTER, NUMBER, classes
from parcelweave.llm.ship import ship
from parcelweave.session import fresh_dir


@dataclass(frozen=True)
class Settings:
    #: At most so many labelled ids are learnt from: those with the smallest hash.
    sample: int = 8000
    bits: int = 20
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    #: Least departure, in standard errors, of a term's share of toxic texts.
    clear: float = 5.0
    #: Least number of texts that hold a term.
    least: int = 5
    #: Chance that among all pairs of terms one takes part that tells nothing.
    chance: float = 0.05
    factors: int = 4
    epochs: int = 30
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    #: How many times a toxic text counts in the loss: most texts are clean, a miss costs more.
    weight: float = 6.0
    seed: int = 7


def text_terms(texts: Texts, settings: Settings, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term place) pairs of a block, in that order; with ``known``, only its terms."""
    low = lower(texts.codes)
    kind = classes()[low]
    begins, ends = texts.runs((kind == LETTER) | (kind == NUMBER))
    size = ends - begins
    wide = np.uint64(64 - settings.bits)
    places, at = [], []
    for length in (0, *settings.prefixes):
        which = np.arange(len(begins)) if not length else np.flatnonzero(size > length)
        stop = ends if not length else begins[which] + length
        place = (texts.hashes(begins[which], stop, low) * np.uint64(2 * length + 1) >> wide).astype(np.int64)
        if known is not None:
            hit = known[place]
            place, which = place[hit], which[hit]
        places.append(place)
        at.append(which)
    owner = texts.owners(begins[np.concatenate(at)])
    pairs = np.unique((owner << settings.bits) | np.concatenate(places))
    return pairs >> settings.bits, pairs & ((1 << settings.bits) - 1)


@dataclass
class Machine:
    """A fitted model: ``index`` maps a term place to a row of weights, or -1."""

    index: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, owner: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Values of the machine; every term of a text counts one over the root of their number."""
        value = unit(owner, n)
        sums = np.zeros((n, self.factor.shape[1]))
        squares, linear = np.zeros(n), np.zeros(n)
        np.add.at(sums, owner, self.factor[row] * value[:, None])
        np.add.at(squares, owner, (self.factor[row] ** 2).sum(axis=1) * value**2)
        np.add.at(linear, owner, self.weight[row] * value)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    def scores(self, texts: Texts, settings: Settings) -> np.ndarray:
        owner, place = text_terms(texts, settings, self.index >= 0)
        return sigmoid(self.margin(owner, self.index[place], texts.n))


def unit(owner: np.ndarray, n: int) -> np.ndarray:
    return 1.0 / np.sqrt(np.bincount(owner, minlength=n))[owner]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sample:
    """What the counts of the sample say: its labels by text number, and which places may take part.

    ``owner`` and ``place`` are the entries (text, term place) of the places in ``among`` and ``clear`` alone, by place. Pairs that
    raise the share of the rarer label are sought among the places in ``among``, those that lower it between
    ``clear`` ones, which tell by themselves, and all others. ``bound`` is what a pair's departure must reach.
    """

    label: np.ndarray
    prior: float
    bound: float
    among: np.ndarray
    clear: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def rarer(label: np.ndarray) -> np.ndarray:
    return label if 2 * label.sum() <= len(label) else 1 - label


def tables(owner: np.ndarray, place: np.ndarray, chosen: np.ndarray, turn: np.ndarray, block: int):
    """Reads the texts (in the order ``turn`` gives) by one block of the chosen places as 0 and 1; entries ascend by place."""
    begin, end = np.searchsorted(place, chosen), np.searchsorted(place, chosen, "right")

    def read(k: int) -> np.ndarray:
        first, size = begin[k * block : (k + 1) * block], (end - begin)[k * block : (k + 1) * block]
        rows = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        table = np.zeros((len(turn), len(size)), np.float32)
        table[turn[owner[rows]], np.repeat(np.arange(len(size)), size)] = 1
        return table

    return read, -(-len(chosen) // block)


def telling_pairs(owner: np.ndarray, place: np.ndarray, sample: Sample, settings: Settings, block: int = 512) -> np.ndarray:
    """Places that belong to a pair that says together what neither says alone, of pairs with one of the given places.

    ``owner`` and ``place`` are all entries of some places; every place must come whole. Of a pair's N common texts a
    share r has the rarer label. Expected is a share q: what the odds of the two places in their other texts make
    together, and not less than the share of either place. By the Chernoff bound so clear a departure has a chance of
    exp(-N * KL(r, q)) at most, which must stay below ``chance`` over the number of pairs. A pair of two places in
    ``among`` is met from the greater one. Counts come in blocks of pairs.
    """
    label, prior, bound = rarer(sample.label), sample.prior, sample.bound
    turn = np.argsort(np.argsort(-label, kind="stable"))  # texts of the rarer label first
    few = int(label.sum())
    odds = np.log(prior / (1 - prior))
    width = 1 << settings.bits
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    have, bad = np.bincount(sample.place, minlength=width), np.bincount(sample.place, weights=label[sample.owner], minlength=width)
    own, times = np.unique(place, return_counts=True)
    have[own] = times
    bad[own] = np.bincount(place, weights=label[owner], minlength=width)[own]
    own = own[times >= settings.least]

    def alone(bad: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Log odds beyond the prior's, drawn to it by two texts."""
        share = (bad + 2 * prior) / (have + 2)
        return np.log(share / (1 - share)) - odds

    # A pair that lowers the share has at least so many common texts: even if none of them has the label, fewer can't reach the bound.
    need = np.zeros(width)
    need[sample.clear] = bound / -np.log1p(-np.minimum(bad[sample.clear] / have[sample.clear], 1 - 1e-9)) * (1 - 1e-9)
    telling = [np.zeros(0, np.int64)]
    for raises, ones, twos in ((True, sample.among, own[np.isin(own, sample.among)]), (False, sample.clear, own)):
        if raises:
            ones = ones[ones <= twos[-1]] if len(twos) else ones[:0]
        elif len(ones):
            twos = twos[have[twos] >= need[ones].min()]
        (one, m_one), (two, m_two) = tables(sample.owner, sample.place, ones, turn, block), tables(owner, place, twos, turn, block)
        for j in range(m_two):
            right = two(j)
            for i in range(m_one):
                left = one(i)
                hits = left[:few].T @ right[:few]
                if raises and hits.max() * -np.log(prior) < bound:
                    continue
                common = left.T @ right
                if raises:
                    a, b = np.nonzero((hits * -np.log(prior) >= bound) & (hits > common * prior))
                else:
                    a, b = np.nonzero(common >= np.maximum(settings.least, need[ones[i * block : (i + 1) * block]])[:, None])
                both, hit = common[a, b].astype(np.float64), hits[a, b].astype(np.float64)
                a, b = ones[i * block + a], twos[j * block + b]
                share = hit / both
                log_odds = odds + alone(bad[a] - hit, have[a] - both) + alone(bad[b] - hit, have[b] - both)
                expected = sigmoid(log_odds)
                if raises:
                    expected = np.maximum.reduce([expected, np.full(len(a), prior), bad[a] / have[a], bad[b] / have[b]])
                    expected = np.minimum(expected, 1 - 1e-9)
                    fits = share > expected
                else:
                    expected = np.minimum(expected, np.minimum(bad[a] / have[a], 1 - 1e-9))
                    fits = (share < expected) & (expected > prior)
                a, b, both, share, expected = (v[fits] for v in (a, b, both, share, expected))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(share > 0, share * np.log(share / expected), 0)
                    gain += np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - expected)), 0)
                told = both * gain >= bound
                telling += [a[told], b[told]]
    return np.unique(np.concatenate(telling))


def fit(owner: np.ndarray, place: np.ndarray, label: np.ndarray, chosen: np.ndarray, settings: Settings) -> Machine:
    """Fit on the (text, term) pairs of the sample, sorted by text, and one 0/1 label per text.

    ``chosen`` are the places that take part; entries of others are left out.
    """
    n, width = len(label), 1 << settings.bits
    toxic = int(label.sum())
    prior = np.log((toxic + 0.5) / (n - toxic + 0.5)) if toxic < n - toxic else 0.0
    index = np.full(width, -1, np.int64)
    none = Machine(index, float(min(prior, -np.log(3))), np.zeros(0), np.zeros((0, settings.factors)))
    if not toxic or toxic == n:
        return none
    if not len(chosen):
        return none
    index[chosen] = np.arange(len(chosen))
    hit = index[place] >= 0
    owner, row = owner[hit], index[place[hit]]
    m = len(chosen)
    rng = np.random.default_rng(settings.seed)
    model = Machine(index, float(prior), np.zeros(m), rng.normal(0, 0.01, (m, settings.factors)))
    cuts = np.searchsorted(owner, np.arange(n + 1))
    seen_w, seen_v, seen_b = np.full(m, 1e-6), np.full((m, settings.factors), 1e-6), 1e-6
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for begin in range(0, n, settings.batch):
            chosen = order[begin : begin + settings.batch]
            size = cuts[chosen + 1] - cuts[chosen]
            local = np.repeat(np.arange(len(chosen)), size)
            at = np.arange(len(local)) + np.repeat(cuts[chosen] - np.cumsum(size) + size, size)
            rows = row[at]
            unit_value = unit(local, len(chosen))
            values = model.factor[rows] * unit_value[:, None]
            sums = np.zeros((len(chosen), settings.factors))
            np.add.at(sums, local, values)
            slope = sigmoid(model.margin(local, rows, len(chosen))) - label[chosen]
            slope *= np.where(label[chosen] > 0, settings.weight, 1.0) / len(chosen)
            used, back = np.unique(rows, return_inverse=True)
            grad_w, grad_v = np.zeros(len(used)), np.zeros((len(used), settings.factors))
            np.add.at(grad_w, back, slope[local] * unit_value)
            np.add.at(grad_v, back, (slope[local] * unit_value)[:, None] * (sums[local] - values))
            grad_w += settings.decay * model.weight[used]
            grad_v += settings.decay * model.factor[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += slope.sum() ** 2
            model.weight[used] -= settings.rate * grad_w / np.sqrt(seen_w[used])
            model.factor[used] -= settings.rate * grad_v / np.sqrt(seen_v[used]) * 0.3
            model.bias -= settings.rate * slope.sum() / np.sqrt(seen_b)
    return model


def is_held_out(id_column: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def entries(rows: DataFrame, wanted: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The (text, place) entries of the sample whose place is wanted, by text and place."""
    known = np.zeros(1 << settings.bits, bool)
    known[wanted] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = known[batch.column(1).to_numpy()]
            yield batch.filter(pa.array(hit))

    found = rows.select("__at", F.explode("__terms").alias("__place")).mapInArrow(run, "__at int, __place int").toArrow()
    owner, place = (found.column(c).to_numpy() for c in ("__at", "__place"))
    order = np.lexsort((place, owner))
    return owner[order], place[order]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings = Settings(),
) -> Machine:
    """Fit on the labelled sample; runs jobs when called. ``labels`` decides what may be learnt from.

    The sample's terms lie in a table of the shared folder. Places are counted by one aggregate, pairs in tasks that
    hold a share of the places each; the driver sees the places that can take part and their entries.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(settings.sample)
    )
    # A broadcast of at most ``sample`` ids.
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    found = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("__id", "__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 2):
                owner, place = text_terms(Texts(block.column(2)), settings)
                cuts = np.searchsorted(owner, np.arange(block.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*block.columns[:2], lists], names=["__id", "__label", "__terms"])

    schema = StructType([found.schema["__id"], StructField("__label", IntegerType()), StructField("__terms", ArrayType(IntegerType()))])
    ship(spark)
    at = fresh_dir(spark, "sample")
    once = found.mapInArrow(run, schema).groupBy("__id").agg(F.max("__label").alias("__label"), F.min("__terms").alias("__terms"))
    once.write.parquet(f"{at}/terms")
    terms = spark.read.parquet(f"{at}/terms")
    ids = terms.select("__id", "__label").orderBy(F.xxhash64("__id"), "__id").toArrow()  # at most ``sample`` rows
    label = np.array(ids.column("__label").to_pylist(), np.float64)
    numbers = spark.createDataFrame(
        [(i, n) for n, i in enumerate(ids.column("__id").to_pylist())], StructType([terms.schema["__id"], StructField("__at", IntegerType())])
    )
    rows = terms.join(F.broadcast(numbers), "__id").select("__at", "__label", "__terms")
    n, toxic = len(label), int(label.sum())
    none = np.zeros(0, np.int64)
    if not toxic or toxic == n:
        return fit(none, none, label, none, settings)

    prior = float(rarer(label).mean())
    rare = F.col("__label") if 2 * toxic <= n else 1 - F.col("__label")
    counts = (
        rows.select(F.explode("__terms").alias("__place"), F.col("__label"), rare.alias("__rare"))
        .groupBy("__place")
        .agg(F.count("*").alias("have"), F.sum("__label").alias("toxic"), F.sum("__rare").alias("rare"))
        .filter(F.col("have") >= settings.least)
    )
    counts.write.parquet(f"{at}/counts")
    counts = spark.read.parquet(f"{at}/counts")
    bound = float(np.log(max(counts.count() ** 2 / 2, 1) / settings.chance))
    share = F.col("have") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / toxic + 1 / (n - toxic)))
    apart = F.abs(F.col("toxic") / toxic - (F.col("have") - F.col("toxic")) / (n - toxic)) >= settings.clear * error
    able = counts.select("__place", (F.col("rare") * -float(np.log(prior)) >= bound).alias("among"), apart.alias("clear"))
    able = able.filter("among OR clear").orderBy("__place").toArrow()
    place = able.column("__place").to_numpy().astype(np.int64)
    among, clear = (place[able.column(c).to_numpy(zero_copy_only=False)] for c in ("among", "clear"))
    owner, held = entries(rows, place, settings)
    order = np.argsort(held, kind="stable")
    sample = Sample(label, prior, bound, among, clear, owner[order], held[order])
    told = place_pairs(rows, sample, settings)
    taking_part = np.union1d(clear, told)
    return fit(*entries(rows, taking_part, settings), label, taking_part, settings)


def place_pairs(rows: DataFrame, sample: Sample, settings: Settings) -> np.ndarray:
    """``telling_pairs`` over all places of the sample: each task tests a share of the places against the sample's able ones.

    What travels to the tasks is bounded by the sample, as is a group: the sample's texts with 2 ** 13 places.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(sample)

    def test(group: pa.Table) -> pa.Table:
        owner, place = (group.column(c).to_numpy() for c in ("__at", "__place"))
        return pa.table({"__place": pa.array(telling_pairs(owner, place, shared.value, settings), pa.int64())})

    dealt = rows.select("__at", F.explode("__terms").alias("__place")).withColumn("__share", F.shiftright("__place", 13))
    # By number, as a share is little to read and much to compute.
    shares = dealt.repartition(1 << max(settings.bits - 13, 0), "__share").groupBy("__share")
    told = shares.applyInArrow(test, "__place long").distinct().toArrow().column("__place").to_numpy()
    shared.destroy()
    return np.sort(told)


def score(
    docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                values = model.scores(Texts(block.column(1)), settings)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(values)], names=[id_col, "score"])

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("score", DoubleType())])
    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_civil(
    docs: DataFrame, model: Machine, text_col: str = "text", limit: float = 0.5, settings: Settings = Settings()
) -> DataFrame:
    """The rows that score below ``limit``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                yield block.filter(pa.array(model.scores(Texts(block.column(at)), settings) < limit))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
