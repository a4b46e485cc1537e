"""Byte-level BPE: cached pair merging over vectorised pre-tokens, and decoding by offsets.

``encode`` returns, per row, the token ids and the place in the text's UTF-8 bytes where each
token begins; ``decode`` turns ids back into bytes. Null texts encode as empty, an empty text has
no ids, rows that repeat stay, and only the two named columns are read, so others may be called
anything. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from parcelweave.llm import pretoken
from parcelweave.llm.arrays import Texts, blocks
from parcelweave.llm.ship import ship

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens longer than this many bytes are merged with a heap instead of repeated scans.
LONG = 256
#: The cache of merged pre-tokens starts anew at this many entries; it only saves work.
CACHE = 400_000
_NONE = 1 << 60


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and the bounds of each by id."""
    ranks = load_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    bounds = np.concatenate(([0], np.cumsum(size)))
    table = np.empty(bounds[-1], np.uint8)
    for token, rank in ranks.items():
        table[bounds[rank] : bounds[rank + 1]] = np.frombuffer(token, np.uint8)
    return table, bounds


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked adjacent pair, leftmost first, until none has a rank."""
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) != _NONE:
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n: a heap of ranked pairs over a linked list of parts."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            both = parts[i] + parts[after[i]]
            if (rank := ranks.get(both)) is not None:
                heapq.heappush(heap, (rank, i, len(both)))

    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or after[i] >= n or len(parts[i]) + len(parts[after[i]]) != size:
            continue
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        push(before[i])
    return [ranks[p] for p in parts if p is not None]


class _Pieces(dict):
    """Pre-token to its place in a growing list of merged ids."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.ids: list[int] = []
        self.cuts: list[int] = [0]

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            self.ids.append(whole)
        else:
            self.ids += (merge_long if len(raw) > LONG else merge_short)(raw, self.ranks)
        self.cuts.append(len(self.ids))
        self[piece] = place = len(self.cuts) - 2
        return place


_pieces: dict[str, _Pieces] = {}


def encode_block(texts: Texts, path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 bounds of each text's ids."""
    cache = _pieces.get(path)
    if cache is None or len(cache) > CACHE:
        cache = _pieces[path] = _Pieces(path)
    begins = pretoken.starts(texts)
    places, text = begins.tolist(), texts.text
    found = np.array([cache[text[a:b]] for a, b in zip(places, [*places[1:], len(text)])], np.int64)
    cuts = np.array(cache.cuts, np.int64)
    size = cuts[found + 1] - cuts[found]
    ends = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(ends[-1]) + np.repeat(cuts[found] - ends[:-1], size)
    ids = np.array(cache.ids, np.int32)[source] if len(found) else np.zeros(0, np.int32)
    return ids, ends[np.searchsorted(begins, texts.bounds)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``byte_starts`` (place of each id's first byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bounds = token_bytes(path)
        width = (bounds[1:] - bounds[:-1]).astype(np.int32)
        for batch in batches:
            for block in blocks(batch, 1):
                ids, cuts = encode_block(Texts(block.column(1)), path)
                ends = np.concatenate(([0], np.cumsum(width[ids], dtype=np.int64)))
                starts = ends[:-1] - np.repeat(ends[cuts[:-1]], np.diff(cuts))
                offsets = pa.array(cuts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (ids, starts)]
                yield pa.RecordBatch.from_arrays([block.column(0), *lists], names=[id_col, "ids", "byte_starts"])

    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType),
        StructField("ids", ArrayType(IntegerType())),
        StructField("byte_starts", ArrayType(IntegerType())),
    ])
    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str = RANKS) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, to the id and ids columns; null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bounds = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = []
                for ids in part.column(1):
                    ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                    size = bounds[ids + 1] - bounds[ids]
                    ends = np.cumsum(size)
                    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[ids] - ends + size, size)
                    raw.append(table[source].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=names)

    names = [id_col, "ids", "decoded"]
    schema = StructType([encoded.schema[id_col], encoded.schema["ids"], StructField("decoded", BinaryType())])
    ship(encoded.sparkSession)
    return encoded.select(id_col, "ids").mapInArrow(run, schema)
