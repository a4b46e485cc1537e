"""Repetition coverage: characters inside repeated n-grams and repeated lines, per text.

Hashes of n-grams of every length come from differences of one running sum over word hashes, so
each further length costs one subtraction per word. A word counts once for a length, however
many repeated n-grams cover it. Only later occurrences count as repeated, so text that is said
once costs nothing.

Null and empty texts have no words and fail the base rule. Texts are measured whole, whatever
their length; rows that repeat are measured each; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from parcelweave.llm.arrays import BACK, BASE, Texts, blocks, mix, per_text, powers
from parcelweave.llm.ship import ship

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Largest shares, in percent of the characters in words, that a kept text may have."""

    least_words: int = 50
    #: Words in 3-word windows found twice or more, in percent of the words.
    most_repeat_words: int = 50
    #: By n-gram length: characters in later occurrences.
    repeated: dict[int, int] = field(default_factory=lambda: {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20})
    #: By n-gram length: characters in all occurrences of the most frequent n-gram.
    top: dict[int, int] = field(default_factory=lambda: {2: 30, 3: 28, 4: 26})
    #: Characters of words in lines equal to an earlier line.
    repeated_lines: int = 30


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether an equal hash of the same owner came earlier, the sorting order, and where runs of equals begin in it."""
    key = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    later = np.zeros(len(key), bool)
    later[order] = same
    return later, order, np.flatnonzero(~same)


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in an n-gram that begins at one of ``at``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: Texts, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of a block, each an array with one entry (or row) per text."""
    n = texts.n
    begins, ends = texts.words()
    owner, size = texts.owners(begins), ends - begins
    total = len(begins)
    hashes = texts.hashes(begins, ends)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, total), out=sums[1:])
    back = powers(BACK, total + 1)

    def grams(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k words of one text begin, and their hashes."""
        at = np.flatnonzero(owner[: max(total - k + 1, 0)] == owner[k - 1 :]) if total >= k else np.zeros(0, np.int64)
        return at, (sums[at + k] - sums[at]) * back[at]

    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    symbols = np.flatnonzero(symbol[np.minimum(texts.codes, 127)])
    out = {
        "n_words": per_text(owner, n),
        "word_chars": per_text(owner, n, size),
        "n_symbols": per_text(texts.owners(symbols), n),
    }

    first, last = texts.runs(texts.codes != 10)
    words_before = np.searchsorted(begins, first), np.searchsorted(begins, last)
    real = words_before[1] > words_before[0]
    first, last = first[real], last[real]
    chars = np.concatenate(([0], np.cumsum(size)))
    line_chars = chars[words_before[1][real]] - chars[words_before[0][real]]
    line_owner = texts.owners(first)
    later, _, _ = _again(line_owner, texts.hashes(first, last))
    out["n_dup_lines"] = per_text(line_owner[later], n)
    out["dup_line_chars"] = per_text(line_owner[later], n, line_chars[later])

    at, h = grams(3)
    later, order, runs = _again(owner[at], h)
    twice = later.copy()
    if len(order):
        follows = np.zeros(len(order), bool)
        follows[:-1] = later[order[1:]]
        twice[order[follows]] = True
    covered = _covered(at[twice], 3, total)
    out["n_repeat_words"] = per_text(owner[covered], n)

    dup = []
    for k in rules.repeated:
        at, h = grams(k)
        later, _, _ = _again(owner[at], h)
        covered = _covered(at[later], k, total)
        dup.append(per_text(owner[covered], n, size[covered]))
    out["dup_gram_chars"] = np.array(dup).reshape(len(rules.repeated), n).T
    top = []
    for k in rules.top:
        at, h = grams(k)
        _, order, runs = _again(owner[at], h)
        most = np.zeros(n, np.int64)
        if len(order):
            times = np.diff(np.append(runs, len(order)))
            heads, times = at[order[runs[times > 1]]], times[times > 1]
            np.maximum.at(most, owner[heads], times * (chars[heads + k] - chars[heads]))
        top.append(most)
    out["top_gram_chars"] = np.array(top).reshape(len(rules.top), n).T

    out["base_failed"] = (out["n_words"] < rules.least_words) | (
        100 * out["n_repeat_words"] > rules.most_repeat_words * out["n_words"]
    )
    limit = out["word_chars"][:, None]
    over = (100 * out["dup_gram_chars"] > limit * list(rules.repeated.values())).any(axis=1)
    over |= (100 * out["top_gram_chars"] > limit * list(rules.top.values())).any(axis=1)
    over |= 100 * out["dup_line_chars"] > rules.repeated_lines * out["word_chars"]
    out["kept"] = ~(out["base_failed"] | over)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
LISTS = ("dup_gram_chars", "top_gram_chars")
FLAGS = ("base_failed", "kept")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The measures and the verdict of every row: ``id_col``, counts, lists by n-gram length, flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                m = measure(Texts(block.column(1)), rules)
                columns = [pa.array(m[c]) for c in COUNTS]
                columns += [pa.array(list(m[c]), pa.list_(pa.int64())) for c in LISTS]
                columns += [pa.array(m[c]) for c in FLAGS]
                yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=names)

    names = [id_col, *COUNTS, *LISTS, *FLAGS]
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType),
        *[StructField(c, LongType()) for c in COUNTS],
        *[StructField(c, ArrayType(LongType())) for c in LISTS],
        *[StructField(c, BooleanType()) for c in FLAGS],
    ])
    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                yield block.filter(pa.array(measure(Texts(block.column(at)), rules)["kept"]))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
