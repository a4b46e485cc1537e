"""Document quality by Bradley-Terry pairwise ranking, cut at a quantile of all scores.

A text has a strength, a weighted sum of its features; the chance that one text is preferred to another
is the logistic function of the difference of their strengths. Weights are learnt by logistic loss
on differences of features over preference pairs, so no bias is learnt and only the order of
texts matters. Pairs are given (``train_on_pairs``) or drawn from labels (``train``: a text labelled 1 is
preferred to one labelled 0).

Features describe form, not topic: how often one class of characters follows another, how much words,
word pairs and lines repeat, and lengths, the last two also beyond their sample quantiles.

What is kept is decided by a quantile of the strengths of all texts (``strength_cut``): a given share goes, or
the share whose cut best tells the labelled sample apart. Learning reads a bounded sample of labelled
rows (``Settings.sample``) or pairs (``Settings.pairs``); quantiles are counted over all rows.

Null and empty texts have all features zero and are scored like any other. A null label or id teaches
nothing; of several labels of one id the highest counts, and of several texts of one id in the
sample the first by features. Without labels of both kinds, or without pairs, nothing is learnt: all
strengths are 0, all texts are kept. Rows that repeat are scored each, texts whole, whatever their
length; ties lie on one side of the cut. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from parcelweave.llm.arrays import BACK, BASE, Texts, blocks, mix, per_text, powers
from parcelweave.llm.ship import ship


@dataclass(frozen=True)
class Settings:
    #: At most so many labelled ids are learnt from: those with the smallest hash.
    sample: int = 8000
    #: At most so many preference pairs are learnt from.
    pairs: int = 60_000
    #: Weight of the squared weights in the loss.
    ridge: float = 1e-3
    steps: int = 15
    seed: int = 11
    #: Share of all texts that goes; None: the share whose cut best tells the sample apart.
    level: float | None = None
    #: Strengths are counted in steps of one over this, between plus and minus ``reach``.
    grid: int = 256
    reach: int = 64


#: Characters that have a class of their own.
OWN = "\n.,!?#$%&*|<>-"
LOWER, UPPER, LETTER, DIGIT, SPACE, MARK, OTHER = range(7)
KINDS = 7 + len(OWN)
MEASURES = 13
#: Quantiles of the sample beyond which a measure counts anew.
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
WIDTH = MEASURES + KINDS * KINDS


def _kinds() -> np.ndarray:
    """Class of every code point of the basic plane."""
    table = np.full(65536, OTHER, np.uint8)
    for code in range(65536):
        kind = unicodedata.category(chr(code))
        if kind in ("Ll", "Lu"):
            table[code] = LOWER if kind == "Ll" else UPPER
        elif kind[0] in "LM":
            table[code] = LETTER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif kind == "Zs" or 9 <= code <= 13:
            table[code] = SPACE
        elif kind[0] in "PS":
            table[code] = MARK
    for i, own in enumerate(OWN):
        table[ord(own)] = 7 + i
    return table


_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _KINDS:
        _KINDS.append(_kinds())
    return _KINDS[0]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct values, occurrences of the most frequent one, and the sum of c * log(c) over their counts."""
    key = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    held_by = owner[order[first]]
    most = np.zeros(n)
    np.maximum.at(most, held_by, times)
    return (
        np.bincount(held_by, minlength=n).astype(float),
        most,
        np.bincount(held_by, weights=times * np.log(times), minlength=n),
    )


def features(texts: Texts) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text: the measures, then roots of the shares of class pairs."""
    n = texts.n
    size = np.diff(texts.bounds).astype(float)
    kind = kinds()[np.minimum(texts.codes, 65535)]
    kind[texts.codes > 65535] = OTHER

    owner = np.repeat(np.arange(n), np.diff(texts.bounds))
    inside = owner[1:] == owner[:-1]
    step = owner[:-1].astype(np.int64) * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    follows = np.bincount(step[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
    shares = np.sqrt(_share(follows.ravel().astype(float), np.repeat(np.maximum(size - 1, 0), KINDS * KINDS))).reshape(n, -1)

    begins, ends = texts.words()
    word_owner, length = texts.owners(begins), ends - begins
    words = per_text(word_owner, n).astype(float)
    hashes = texts.hashes(begins, ends)
    distinct, most, spread = _repeats(word_owner, hashes, n)
    near = word_owner[1:] == word_owner[:-1]
    twice = near & (hashes[1:] == hashes[:-1])
    sums = np.zeros(len(begins) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(begins)), out=sums[1:])
    at = np.flatnonzero(near)
    couples = (sums[at + 2] - sums[at]) * powers(BACK, len(begins) + 1)[at]
    couples_distinct, _, _ = _repeats(word_owner[at], couples, n)

    def count_before(mask: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(mask)))

    letters = count_before(kind <= LETTER)
    upper = count_before(kind == UPPER)
    word_letters, word_upper = letters[ends] - letters[begins], upper[ends] - upper[begins]
    first, last = texts.runs(texts.codes != 10)
    held = np.searchsorted(begins, last) > np.searchsorted(begins, first)
    first, last = first[held], last[held]
    line_owner = texts.owners(first)
    lines = per_text(line_owner, n).astype(float)
    line_distinct, _, _ = _repeats(line_owner, texts.hashes(first, last), n)
    rooms = np.log(np.maximum(words, 2))

    def in_text(mask: np.ndarray) -> np.ndarray:
        return _share(per_text(word_owner[mask], n).astype(float), words)

    measures = np.column_stack([
        np.log1p(words),
        np.log1p(size),
        np.log1p(_share(per_text(word_owner, n, length).astype(float), words)),
        _share(distinct, words),
        _share(most, words),
        _share(per_text(word_owner[1:][twice], n).astype(float), words),
        _share(couples_distinct, np.maximum(words - 1, 0)),
        # Entropy of the words over that of words that differ all.
        np.where(words > 1, (np.log(np.maximum(words, 1)) - _share(spread, words)) / rooms, 0),
        np.log1p(lines),
        _share(lines - line_distinct, lines),
        np.log1p(_share(words, lines)),
        in_text(word_letters == 0),
        in_text((word_upper == word_letters) & (word_letters > 1)),
    ])
    return np.hstack([measures, shares]).astype(np.float32)


@dataclass
class Ranker:
    """Weights over features as ``unfold`` lays them out; strengths are relative to a mean text."""

    knots: np.ndarray
    center: np.ndarray
    weight: np.ndarray

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return (unfold(rows, self.knots) - self.center) @ self.weight


def unfold(rows: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Features, and for every measure and knot what the measure exceeds it by."""
    rows = rows.astype(np.float64)
    beyond = np.maximum(rows[:, :MEASURES, None] - knots.T[None], 0).reshape(len(rows), -1)
    return np.hstack([rows, beyond])


def nothing_learnt() -> Ranker:
    wide = WIDTH + MEASURES * len(KNOTS)
    return Ranker(np.zeros((len(KNOTS), MEASURES)), np.zeros(wide), np.zeros(wide))


def fit(rows: np.ndarray, better: np.ndarray, worse: np.ndarray, settings: Settings = Settings()) -> Ranker:
    """Newton steps on the logistic loss of feature differences; row ``better[i]`` is preferred to ``worse[i]``."""
    if not len(better):
        return nothing_learnt()
    knots = np.quantile(rows[:, :MEASURES].astype(np.float64), KNOTS, axis=0)
    wide = unfold(rows, knots)
    center, scale = wide.mean(axis=0), wide.std(axis=0)
    used = scale > 1e-6
    plain = (wide[:, used] - center[used]) / scale[used]
    weight = np.zeros(plain.shape[1])
    for _ in range(settings.steps):
        slope, bend = settings.ridge * weight, settings.ridge * np.eye(len(weight))
        for begin in range(0, len(better), 4096):
            part = slice(begin, begin + 4096)
            apart = plain[better[part]] - plain[worse[part]]
            missed = 1 / (1 + np.exp(np.clip(apart @ weight, -40, 40)))
            slope -= apart.T @ missed / len(better)
            bend += (apart * (missed * (1 - missed))[:, None]).T @ apart / len(better)
        step = np.linalg.solve(bend, slope)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    full = np.zeros(len(center))
    full[used] = weight / scale[used]
    return Ranker(knots, center, full)


def is_held_out(id_column: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features of the documents whose ids are ``chosen`` (column ``__id``, a bounded number), by id."""
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    found = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                rows = features(Texts(block.column(1)))
                cuts = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * WIDTH)
                lists = pa.ListArray.from_arrays(cuts, pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), lists], names=["__id", "__rows"])

    ship(docs.sparkSession)
    schema = StructType([found.schema["__id"], StructField("__rows", ArrayType(FloatType()))])
    once = found.mapInArrow(run, schema).groupBy("__id").agg(F.min("__rows").alias("__rows")).orderBy("__id")
    table = once.toArrow()
    ids = np.array(table.column("__id").to_pylist())
    parts = [chunk.flatten().to_numpy() for chunk in table.column("__rows").chunks]
    return ids, (np.concatenate(parts) if parts else np.zeros(0, np.float32)).reshape(-1, WIDTH)


@dataclass
class Sample:
    """Strengths and labels of the texts that were learnt from, for the choice of a cut."""

    strength: np.ndarray
    label: np.ndarray


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
) -> tuple[Ranker, Sample]:
    """Learn from pairs of a text labelled 1 and one labelled 0; runs jobs when called.

    ``labels`` decides what may be learnt from. Pairs are drawn evenly from all of them, up to ``Settings.pairs``.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(settings.sample)
    )
    known = {row["__id"]: row["__label"] for row in chosen.collect()}  # at most ``sample`` rows
    if not known:
        return nothing_learnt(), Sample(np.zeros(0), np.zeros(0))
    held = docs.sparkSession.createDataFrame([(i,) for i in known], StructType([StructField("__id", chosen.schema["__id"].dataType)]))
    ids, rows = sample_rows(docs, held, id_col, text_col)
    label = np.array([known[i] for i in ids.tolist()], np.int64)
    good, bad = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    if not len(good) or not len(bad):
        return nothing_learnt(), Sample(np.zeros(len(label)), label)
    draw = np.random.default_rng(settings.seed)
    if len(good) * len(bad) <= settings.pairs:
        better, worse = np.repeat(good, len(bad)), np.tile(bad, len(good))
    else:
        better, worse = draw.choice(good, settings.pairs), draw.choice(bad, settings.pairs)
    ranker = fit(rows, better, worse, settings)
    return ranker, Sample(ranker.strengths(rows), label)


def train_on_pairs(
    docs: DataFrame,
    preferences: DataFrame,
    better_col: str = "better",
    worse_col: str = "worse",
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> Ranker:
    """Learn from rows that name a preferred document and the other one; runs jobs when called.

    At most ``Settings.pairs`` pairs are learnt from, those with the smallest hash. Pairs with a null, of a
    document with itself, or of documents that aren't there teach nothing.
    """
    chosen = (
        preferences.select(F.col(better_col).alias("__better"), F.col(worse_col).alias("__worse"))
        .filter("__better IS NOT NULL AND __worse IS NOT NULL AND __better <> __worse")
        .orderBy(F.xxhash64("__better", "__worse"), "__better", "__worse")
        .limit(settings.pairs)
    )
    pairs = [tuple(row) for row in chosen.collect()]  # at most ``pairs`` rows
    if not pairs:
        return nothing_learnt()
    kind = chosen.schema["__better"].dataType
    held = docs.sparkSession.createDataFrame(
        [(i,) for i in sorted({i for pair in pairs for i in pair})], StructType([StructField("__id", kind)])
    )
    ids, rows = sample_rows(docs, held, id_col, text_col)
    place = {i: at for at, i in enumerate(ids.tolist())}
    there = [(place[a], place[b]) for a, b in pairs if a in place and b in place]
    both = np.array(there, np.int64).reshape(-1, 2)
    return fit(rows, both[:, 0], both[:, 1], settings)


def strengths(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``strength`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                values = ranker.strengths(features(Texts(block.column(1))))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(values)], names=[id_col, "strength"])

    if id_col == "strength":
        raise ValueError("the id column can't be called strength")
    ship(docs.sparkSession)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("strength", DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Cut:
    """Texts of at least this strength are kept; ``level`` is the share of all texts below it."""

    strength: float
    level: float


def strength_cut(scored: DataFrame, sample: Sample | None = None, settings: Settings = Settings()) -> Cut:
    """The quantile of the strengths of all rows at which to cut; runs one job when called.

    Strengths are counted on a grid, so the driver gets a bounded number of counts. A quantile lies halfway
    between two neighbouring strengths that occur. With ``Settings.level`` it is the highest quantile
    that at most this share lies below; otherwise the one that keeps the largest share of the sample's texts
    labelled 1 less the share of those labelled 0. Of equally good ones the widest gap counts, then the lowest.
    """
    last = 2 * settings.reach * settings.grid
    place = F.floor((F.col("strength") + settings.reach) * settings.grid)
    counts = scored.groupBy(F.least(F.greatest(place, F.lit(0)), F.lit(last)).alias("bin")).agg(F.count("*").alias("n"))
    table = np.array(sorted((row["bin"], row["n"]) for row in counts.collect()), np.int64).reshape(-1, 2)
    if len(table) < 2:
        return Cut(-np.inf, 0.0)
    below = np.cumsum(table[:, 1])[:-1] / table[:, 1].sum()
    # The upper edge of one strength's step and the lower edge of the next.
    left, right = table[:-1, 0] + 1, table[1:, 0]
    cuts = (left + right) / (2 * settings.grid) - settings.reach
    if settings.level is not None:
        fits = np.flatnonzero(below <= settings.level)
        return Cut(float(cuts[fits[-1]]), float(below[fits[-1]])) if len(fits) else Cut(-np.inf, 0.0)
    if sample is None or not (sample.label > 0).any() or not (sample.label <= 0).any():
        return Cut(-np.inf, 0.0)
    good, bad = np.sort(sample.strength[sample.label > 0]), np.sort(sample.strength[sample.label <= 0])
    gain = np.searchsorted(bad, cuts) / len(bad) - np.searchsorted(good, cuts) / len(good)
    if gain.max() <= 0:
        return Cut(-np.inf, 0.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[np.argmax((right - left)[best])]
    return Cut(float(cuts[at]), float(below[at]))


def chance(strength: Column, cut: Cut, at: float) -> Column:
    """Score from 0 to 1 that is ``at`` where the cut lies; without a cut, one half for all."""
    if not np.isfinite(cut.strength):
        return F.when(strength.isNotNull(), F.lit(0.5))
    return 1 / (1 + F.exp(F.lit(cut.strength - np.log(at / (1 - at))) - strength))


def keep_best(docs: DataFrame, ranker: Ranker, cut: Cut, text_col: str = "text") -> DataFrame:
    """The rows whose text has at least the strength of the cut, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                rows = features(Texts(block.column(at)))
                yield block.filter(pa.array(ranker.strengths(rows) >= cut.strength))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
