"""Shortest-pack-first histogram packing of token streams into sequences of one length.

A document is cut into whole sequences and one rest. The lengths' histogram, at most
``sequence`` numbers however large the corpus, is packed on the driver: lengths are placed
longest first, each onto the shortest pattern it fits, with a count per pattern. Pieces then
find their slot by their rank among the pieces of their length; the rank is the number of such
pieces in earlier chunks, summed by Spark, plus the place within their own chunk.

Added tokens of the tokenizer's json are matched inside texts, as its own library does; the rest is
encoded from the rank file of the same name.

Null and empty texts are one closing id. Rows that repeat are packed as often as they come. An
empty table gives no pieces. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from parcelweave.llm.arrays import Texts, blocks
from parcelweave.llm.bpe import RANKS, encode_block, load_ranks
from parcelweave.llm.ship import ship
from parcelweave.session import fresh_dir

SEQUENCE = 1024
END_ID = 0


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    ranks = load_ranks(path)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _added(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """Added tokens of the json beside the rank file, and a pattern that finds them, the longest first."""
    with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    ids = {t["content"]: t["id"] for t in tokens}
    found = "|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True))
    return ids, re.compile(f"({found})") if ids else None


def token_ids(text: str, path: str = RANKS) -> np.ndarray:
    """Ids of one text, added tokens included; what stands between them is encoded by itself."""
    ids, pattern = _added(path)
    if pattern is None or not pattern.search(text):
        return _ordinary_ids(text, path)
    parts = [np.array([ids[p]], np.uint32) if p in ids else _ordinary_ids(p, path) for p in pattern.split(text) if p]
    return np.concatenate(parts)


def _ordinary_ids(text: str, path: str) -> np.ndarray:
    """The library's pattern engine gives up on some very long runs; ours doesn't."""
    try:
        return np.array(_encoding(path).encode_ordinary(text), np.uint32)
    except (KeyboardInterrupt, SystemExit, MemoryError):
        raise
    except BaseException:  # noqa: BLE001  the library raises its panics as BaseException
        return encode_block(Texts(pa.array([text])), path)[0].astype(np.uint32)


def pack_lengths(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences follow each."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free space
    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((f for f, packs in open_packs.items() if packs), default=0)
            if free >= length:
                pattern, count = open_packs[free].pop()
                used = min(left, count)
                if used < count:
                    open_packs[free].append((pattern, count - used))
            else:
                # As few new packs as can take the rest of this length.
                pattern, free = (), sequence
                used = -(-left // (sequence // length))
            left -= used
            packed, free = (*pattern, length), free - length
            if free:
                open_packs[free].append((packed, used))
            else:
                done.append((packed, used))
    done += [pack for packs in open_packs.values() for pack in packs]
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for pattern, count in done:
        merged[pattern] += count
    return sorted(merged.items(), reverse=True)


class Slots:
    """For each length, runs of ranks with their first sequence and their offset in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        runs = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for pattern, count in patterns:
            offset = 0
            for length in pattern:
                runs[length].append((taken[length], first, offset))
                taken[length] += count
                offset += length
            first += count
        self.sequences = first
        self.runs = {k: np.array(v, np.int64).reshape(-1, 3) for k, v in runs.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for one in np.unique(length):
            rows, runs = np.flatnonzero(length == one), self.runs[int(one)]
            hit = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
            where[rows] = hit[:, 1] + rank[rows] - hit[:, 0]
            offset[rows] = hit[:, 2]
        return where, offset


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, path: str = RANKS
) -> DataFrame:
    """Pieces of all documents, written once to the shared folder and read back.

    Columns: ``id_col``, ``start``, ``length``, ``doc_tokens``, ``ids`` (unsigned 32-bit little-endian),
    ``chunk`` (the task that made the piece) and ``place`` (its place among the chunk's pieces of
    its length). Runs a job when called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for block in blocks(batch, 1):
                out: list[list] = [[] for _ in names]
                for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                    ids = np.append(token_ids(text or "", path), np.uint32(END_ID)).astype("<u4")
                    raw = ids.tobytes()
                    for start in range(0, len(ids), sequence):
                        length = min(sequence, len(ids) - start)
                        row = (doc, start, length, len(ids), raw[4 * start : 4 * (start + length)], chunk, int(seen[length]))
                        seen[length] += 1
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, block.schema.field(0).type if k == 0 else kinds[k]) for k, v in enumerate(out)], names=names
                )

    names = [id_col, "start", "length", "doc_tokens", "ids", "chunk", "place"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    spark_kinds = [docs.schema[id_col].dataType, LongType(), LongType(), LongType(), BinaryType(), IntegerType(), LongType()]
    schema = StructType([StructField(n, k) for n, k in zip(names, spark_kinds)])
    spark = docs.sparkSession
    ship(spark)
    at = fresh_dir(spark, "token-pieces")
    docs.select(id_col, text_col).mapInArrow(run, schema).write.option("compression", "zstd").parquet(at)
    return spark.read.schema(schema).parquet(at)


def place_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; drops ``chunk`` and ``place``. Counts lengths when called.

    ``pieces`` may carry any other columns than those it adds, ``base`` and ``rank``.
    """
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(pack_lengths(histogram, sequence))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    kept = [c for c in pieces.columns if c not in ("chunk", "place")]
    ranked = ranked.select(*kept, "rank")
    length_at = kept.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(length_at).to_numpy(), batch.column(len(kept)).to_numpy()
            added = [pa.array(v) for v in slots.place(length, rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*kept, "sequence_id", "offset"])

    schema = StructType([*[pieces.schema[c] for c in kept], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    ship(pieces.sparkSession)
    return ranked.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``ids`` end to end by offset, with the pieces' lengths and owners.

    A sequence holds at most ``sequence`` ids, so a group is small whatever the data.
    """
    owner = placed.columns[0]
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(owner).alias("owner"), "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.expr("aggregate(parts, cast('' as binary), (acc, p) -> concat(acc, p.ids))").alias("ids"),
        F.col("parts.length").alias("lengths"),
        F.col("parts.owner").alias("owners"),
    )
