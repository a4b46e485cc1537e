"""Exact top-k by inner product: vectors by falling length, rotated partial sums, residual bounds.

Components are integers: ``floor(scale * x)``. The candidates' second moments give a rotation (their
singular vectors) that gathers length in the first axes. Candidates are cut into blocks by falling
length, some successive blocks make a group. Queries meet the group of the longest vectors first: each
walks its blocks by falling length, and its k-th best score so far is a floor that rises from block to
block. A group is met by a chunk of queries only if its longest vector can reach one of their floors. Within
a group a candidate is skipped if its length cannot reach the floor (Cauchy-Schwarz), and what is left if
the product over the first axes plus the product of what remains of both lengths cannot. Survivors are
scored in integers, so pruning, which works in floating point with slack, never changes a result.

A task holds one group and one chunk, both of bounded size; what is paired without a key is one row per
group and chunk.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part;
shorter vectors count as filled up with zeros. Every query row has its own results, also where ids
repeat; only the row itself is left out of them. Rows that repeat are candidates each. No candidate or no
query gives an empty result. Only the named columns are read. Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from parcelweave.llm.ship import ship
from parcelweave.session import fresh_dir, shuffle_parts


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: int = 64
    #: Vectors of a block of candidates, and of queries.
    block: int = 4096
    queries: int = 1024
    #: Blocks of a group of candidates, and of a chunk of queries.
    group: int = 8
    chunk: int = 8
    #: Share of the axes that the partial product covers.
    head: float = 0.25
    #: Wider vectors aren't rotated: the driver would see the square of the width.
    widest: int = 2048


VECTORS = StructType([
    StructField("__id", LongType()), StructField("__row", LongType()), StructField("__ints", BinaryType()), StructField("__norm", DoubleType())
])
BLOCK = StructType([
    StructField("block", LongType()), StructField("longest", DoubleType()), StructField("n", IntegerType()), StructField("ids", BinaryType()),
    StructField("rows", BinaryType()), StructField("ints", BinaryType()), StructField("norms", BinaryType()),
])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Valid vectors as little-endian 64-bit integers, with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ints, norms = [], [], []
            for own, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    whole = np.floor(scale * x).astype(np.int64)
                    ids.append(own)
                    ints.append(whole.tobytes())
                    norms.append(float(np.sqrt((whole.astype(np.float64) ** 2).sum())))
            columns = [pa.array(ids, pa.int64()), pa.array(ints, pa.binary()), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__ints", "__norm"])

    whole = StructType([VECTORS["__id"], VECTORS["__ints"], VECTORS["__norm"]])
    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, whole)


def _matrix(ints: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(ints), width), np.int64)
    for row, raw in zip(out, ints):
        values = np.frombuffer(raw, np.int64)
        row[: len(values)] = values
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes (columns) of falling second moment; the driver sees width squared numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moment = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096).to_pylist(), width).astype(np.float64)
                moment += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(moment.ravel())], names=["at", "value"])

    schema = StructType([StructField("at", LongType()), StructField("value", DoubleType())])
    rows = vectors.select("__ints").mapInArrow(run, schema).groupBy("at").agg(F.sum("value").alias("value")).collect()
    moment = np.zeros(width * width)
    for row in rows:
        moment[row["at"]] = row["value"]
    _, axes = np.linalg.eigh(moment.reshape(width, width))
    return axes[:, ::-1]


def to_blocks(vectors: DataFrame, width: int, most: int) -> DataFrame:
    """Vectors by falling length in blocks of at most ``most``, written to the shared folder. Runs jobs."""
    n = vectors.count()
    parts = max(1, -(-n // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == most:
                    yield block(number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield block(number, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        norms = table.column("__norm").to_numpy()
        ints = _matrix(table.column("__ints").to_pylist(), width)
        ids, rows = (table.column(c).to_numpy().tobytes() for c in ("__id", "__row"))
        row = [number, float(norms.max()), len(norms), ids, rows, ints.tobytes(), norms.tobytes()]
        return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(BLOCK.names, row)}, pa.schema(
            [("block", pa.int64()), ("longest", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("ints", pa.binary()), ("norms", pa.binary())]
        ))

    order = [F.col("__norm").desc(), F.col("__id"), F.col("__row")]
    sorted_ = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = fresh_dir(vectors.sparkSession, "vector-blocks")
    sorted_.mapInArrow(run, BLOCK).write.parquet(at)
    return vectors.sparkSession.read.schema(BLOCK).parquet(at)


class Block:
    """A block unpacked, with its rotated first axes and the length of the rest."""

    def __init__(self, row: dict, width: int, axes: np.ndarray, head: int):
        self.ids, self.rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
        self.ints = np.frombuffer(row["ints"], np.int64).reshape(-1, width)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.exact = self.ints.astype(np.float64)
        self.first = self.exact @ axes[:, :head]
        self.rest = np.sqrt(np.maximum(self.norms**2 - (self.first**2).sum(axis=1), 0))


def best(queries: Block, candidates: Block, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and the places and scores of the candidates at or above its floor."""
    large = len(candidates.ints[0]) * float(np.abs(queries.ints).max(initial=0)) * float(np.abs(candidates.ints).max(initial=0)) >= 2**53
    bound = queries.first @ candidates.first.T + np.outer(queries.rest, candidates.rest)
    slack = 1e-6 * (1 + np.outer(queries.norms, candidates.norms[:1]))
    # Candidates come by falling length: the first that is too short ends a query's list.
    reach = reaches(queries.norms, floor) * (1 - 1e-9)
    ends = np.searchsorted(-candidates.norms, -reach, "right")
    for i in range(len(queries.ids)):
        alive = np.flatnonzero(bound[i, : ends[i]] + slack[i, 0] >= floor[i])
        alive = alive[candidates.rows[alive] != queries.rows[i]]
        if not len(alive):
            continue
        if large:
            score = candidates.ints[alive] @ queries.ints[i]
        else:
            score = (candidates.exact[alive] @ queries.exact[i]).astype(np.int64)
        keep = score >= floor[i]
        if keep.any():
            yield i, alive[keep], score[keep]


def reaches(norms: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The least length of a candidate that can reach the floor of each query."""
    return np.divide(floor, norms, out=np.full(len(floor), -np.inf), where=(norms > 0) & (floor > 0))


class Walk:
    """The best results of a block of queries so far, and the floors that they set."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()
        self.held: dict[int, np.ndarray] = {}

    def meet(self, candidates: Block) -> None:
        if candidates.norms[0] * (1 + 1e-9) < reaches(self.queries.norms, self.floor).min():
            return
        for i, places, score in best(self.queries, candidates, self.floor):
            found = np.column_stack([score, candidates.ids[places], candidates.rows[places]])
            if i in self.held:
                found = np.concatenate([self.held[i], found])
            found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))[: self.k]]
            self.held[i] = found
            if len(found) == self.k:
                self.floor[i] = max(self.floor[i], found[-1, 0])

    def results(self) -> pa.Table:
        """Row and id of the query, score, id and row of the candidate."""
        places = np.repeat(np.fromiter(self.held, np.int64, len(self.held)), [len(f) for f in self.held.values()])
        found = np.concatenate(list(self.held.values())) if self.held else np.zeros((0, 3), np.int64)
        columns = [self.queries.rows[places], self.queries.ids[places], *found.T]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=FOUND)


FOUND = ["__query", "__query_id", "__score", "__id", "__row"]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """``query_id``, ``rank``, the result's id as ``id_col``, and ``score``. Runs jobs when called.

    ``is_query`` is a condition on the id column, which can't be called like one of the other three or a name used inside.
    """
    if id_col in ("query_id", "rank", "score", *VECTORS.names):
        raise ValueError(f"the id column can't be called {id_col}")
    spark, k = vectors.sparkSession, settings.k
    ship(spark)
    at = fresh_dir(spark, "integer-vectors")
    numbered = integer_vectors(vectors, id_col, vector_col, settings.scale).withColumn("__row", F.monotonically_increasing_id())
    numbered.select(*VECTORS.names).write.parquet(at)
    every = spark.read.schema(VECTORS).parquet(at)
    width = (every.agg(F.max(F.octet_length("__ints"))).first()[0] or 8) // 8
    head = max(1, round(settings.head * width))
    axes = rotation(every, width) if width <= settings.widest else np.eye(width, head)
    asked = every.withColumn(id_col, F.col("__id")).filter(is_query).select(*VECTORS.names)
    parts = shuffle_parts(spark)

    def dealt(blocks: DataFrame, most: int, name: str) -> DataFrame:
        """Runs of at most ``most`` blocks, fewer if that leaves cores idle; blocks are numbered by falling length."""
        most = max(1, min(most, blocks.count() // spark.sparkContext.defaultParallelism))
        place = F.row_number().over(Window.orderBy("block")) - 1  # over one narrow row a block
        return blocks.join(blocks.select("block", F.floor(place / most).alias(name)), "block")

    candidates = dealt(to_blocks(every, width, settings.block), settings.group, "group")
    queries = dealt(to_blocks(asked, width, settings.queries), settings.chunk, "chunk")

    def walk(floors: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """A chunk of queries meets the blocks of one group."""
            out = []
            blocks = [Block(row, width, axes, head) for row in right.sort_by("block").to_pylist()]
            for row in left.to_pylist():
                own = Walk(Block(row, width, axes, head), k, np.frombuffer(row["floors"], np.float64) if floors else None)
                for block in blocks:
                    own.meet(block)
                if not floors:
                    near = reaches(own.queries.norms, own.floor)
                    table = own.results()
                    out.append(pa.table({
                        "block": [row["block"]], "floors": [own.floor.tobytes()], "reach": [float(near.min())],
                        **{c: [table.column(c).to_numpy().tobytes()] for c in FOUND},
                    }))
                else:
                    out.append(own.results())
            return pa.concat_tables(out)

        return run

    start = ", ".join(["block long", "floors binary", "reach double", *[f"{c} binary" for c in FOUND]])
    at = fresh_dir(spark, "query-floors")
    chunks = queries.agg(F.max("chunk")).first()[0]
    if chunks is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    # The first group has a bounded size; it goes to every chunk.
    first = candidates.filter("group = 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks)).cast("array<bigint>")))
    sides = (df.repartition(parts, "chunk").groupBy("chunk") for df in (queries, first))
    next(sides).cogroup(next(sides)).applyInArrow(walk(False), start).write.parquet(at)
    begun = spark.read.parquet(at)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], np.int64)) for c in FOUND], names=FOUND)

    kinds = ", ".join(f"{c} long" for c in FOUND)
    found = begun.select(*FOUND).mapInArrow(unpack, kinds)
    floored = queries.join(begun.select("block", "floors", "reach"), "block")
    thin = floored.groupBy("chunk").agg(F.min("reach").alias("reach"))
    heads = candidates.filter("group > 0").groupBy("group").agg(F.max("longest").alias("longest"))
    met = thin.join(heads, F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("chunk", "group")
    # Whole queries and candidates travel once for each meeting of a chunk and a group.
    def tiles(blocks: DataFrame, own: str):
        names = {c: f"{own}_side_{c}" for c in ("chunk", "group")}
        pairs = met.select(*[F.col(c).alias(name) for c, name in names.items()])
        both = list(names.values())
        return blocks.join(pairs, F.col(own) == F.col(names[own])).repartition(parts, *both).groupBy(*both)

    later = tiles(floored, "chunk").cogroup(tiles(candidates, "group")).applyInArrow(walk(True), kinds)
    by = Window.partitionBy("__query").orderBy(F.col("__score").desc(), F.col("__id"), F.col("__row"))
    ranked = found.unionByName(later).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select(F.col("__query_id").alias("query_id"), "rank", F.col("__id").alias(id_col), F.col("__score").alias("score"))
