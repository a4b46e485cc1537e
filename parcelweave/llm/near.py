"""N-gram Jaccard join by MinHash banding, verified on whole n-gram sets.

Every text becomes the set of its word n-grams. Bands of minimum hashes, their numbers chosen for
a target recall at the threshold, are exchanged by hash; texts that share a band are candidates.
Candidates of small buckets are verified pair by pair. Buckets above ``SMALL`` distinct sets are
never expanded into pairs: their texts are linked to the bucket's smallest one, linked buckets
form a crowd, and the crowd's sets are compared block against block inside tasks, which return
counts of links and a spanning forest. Both ways verify every candidate, so the limit changes the
plan and not the result.

Texts with the same set are one node: copies are never paired, but share class and links.

Words are runs of letters and digits in lower case. A text of fewer words than ``n`` is one n-gram
of all its words; a text without words (also null) has no set, is linked to nothing and is its own
class. Rows that repeat get the same answer each. A null id is a class representative only if all
ids of its class are null. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, LongType, StructField, StructType,
)

from parcelweave.llm.arrays import BACK, BASE, Texts, blocks, lower, mix, powers
from parcelweave.llm.components import components
from parcelweave.llm.pretoken import LETTER, NUMBER, classes
from parcelweave.llm.ship import ship
from parcelweave.session import fresh_dir

#: Buckets of more distinct sets than this are compared block by block.
SMALL = 32
#: Sets of one block of a crowd, and hashes in them, on average: what bounds a task's memory.
BLOCK = 256
BLOCK_HASHES = 500_000


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold: float = 0.8
    #: Least chance that a pair right at the threshold shares a band.
    recall: float = 0.999
    #: Minimum hashes to spend at most.
    hashes: int = 160
    seed: int = 11

    def bands(self) -> tuple[int, int]:
        """Bands and rows a band: the longest rows whose bands fit in ``hashes`` at the target recall."""
        best = (self.hashes, 1)
        for rows in range(1, self.hashes + 1):
            missed = 1 - self.threshold**rows  # a band's chance to miss a pair at the threshold
            bands = math.ceil(math.log(1 - self.recall) / math.log(missed)) if missed > 0 else 1
            if bands * rows > self.hashes:
                break
            best = (bands, rows)
        return best


def shingles(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words and the text each belongs to, in order."""
    low = lower(texts.codes)
    kind = classes()[low]
    begins, ends = texts.runs((kind == LETTER) | (kind == NUMBER))
    words, owner = texts.hashes(begins, ends, low), texts.owners(begins)
    total = len(words)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(words * powers(BASE, total), out=sums[1:])
    back = powers(BACK, total + 1)
    count = np.bincount(owner, minlength=texts.n)
    first = np.cumsum(count) - count
    at = np.flatnonzero(owner[: total - n + 1] == owner[n - 1 :]) if total >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    begin = np.concatenate([at, first[short]])
    end = np.concatenate([at + n, first[short] + count[short]])
    hashes = mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    owners = np.concatenate([owner[at], short])
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def distinct_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each hash once a text and sorted within it."""
    hashes, owner = shingles(texts, n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def signatures(hashes: np.ndarray, cuts: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit hash per set (begins at ``cuts``) and band."""
    bands, rows = settings.bands()
    rng = np.random.default_rng(settings.seed)
    out = np.empty((len(cuts), bands), np.uint64)
    for band in range(bands):
        both = np.full(len(cuts), band, np.uint64)
        for _ in range(rows):
            scale, shift = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            both = mix(both + np.minimum.reduceat(hashes * (scale * np.uint64(2) + np.uint64(1)) + shift, cuts))
        out[:, band] = both
    return out


def text_key(text: Column) -> Column:
    """Two independent 64-bit hashes of a text."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def sketches(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """One thin row per input row, written to the shared folder: id, text key, set key, size, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                texts = Texts(block.column(1))
                hashes, owner = distinct_sets(texts, settings.n)
                have, cuts, size = np.unique(owner, return_index=True, return_counts=True)
                keys: list = [None] * texts.n
                sizes, bands = np.zeros(texts.n, np.int64), [None] * texts.n
                if len(have):
                    sizes[have] = size
                    halves = [np.add.reduceat(mix(hashes + np.uint64(s)), cuts) for s in (1, 2)]
                    for i, key in zip(have, np.column_stack(halves)):
                        keys[i] = key.tobytes()
                    for i, row in zip(have, signatures(hashes, cuts, settings).view(np.int64)):
                        bands[i] = row
                columns = [pa.array(keys, pa.binary()), pa.array(sizes), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), block.column(3), *columns], names=schema.names)

    schema = StructType([
        StructField("id", docs.schema[id_col].dataType), StructField("k1", LongType()), StructField("k2", LongType()),
        StructField("set_key", BinaryType()), StructField("size", LongType()), StructField("bands", ArrayType(LongType())),
    ])
    spark, at = docs.sparkSession, fresh_dir(docs.sparkSession, "sketches")
    chosen = docs.select(F.col(id_col), F.col(text_col), text_key(F.col(text_col)).alias("k")).select(id_col, text_col, "k.*")
    chosen.mapInArrow(run, schema).write.parquet(at)
    return spark.read.schema(schema).parquet(at)


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both)


def _verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose whole sets are similar enough."""
    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = (part.column(i).to_pylist() for i in (2, 3))
                keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(a, b)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, StructType([StructField("a", BinaryType()), StructField("b", BinaryType())]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices, columns in strips."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    often = np.flatnonzero(np.bincount(place, minlength=len(values)) > 1)
    column = np.full(len(values), -1, np.int64)
    column[often] = np.arange(len(often))
    column = column[place]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    strip = 4096
    for begin in range(0, len(often), strip):
        a, b = np.searchsorted(column, [begin, begin + strip])
        dense = np.zeros((len(left) + len(right), strip), np.float32)
        dense[row[a:b], column[a:b] - begin] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _compare_blocks(threshold: float):
    """Links within one pair of blocks: their number per set, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side = np.array(table.column("block").to_pylist())
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        keys = table.column("set_key").to_pylist()
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
        both = overlaps([sets[i] for i in left], [sets[i] for i in right]) if len(left) and len(right) else np.zeros((len(left), len(right)), np.int64)
        sizes = np.array([len(s) for s in sets])
        near = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both)
        if first == second:
            near = np.triu(near, 1)
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, left, near.sum(axis=1))
        np.add.at(links, right, near.sum(axis=0))
        parent = list(range(len(keys)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in zip(*np.nonzero(near)):
            a, b = root(left[x]), root(right[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
        tops = [keys[root(i)] for i in range(len(keys))]
        return pa.table({"a": keys, "b": tops, "links": links}, schema=COMPARED_ARROW)

    return run


COMPARED = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("links", LongType())])
COMPARED_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Every row with its class. Runs jobs when called.

    Returns ``id_col``, ``class_id`` (smallest id of the class), ``n_links`` (other distinct sets linked
    to this one), ``n_copies`` (rows with the same set, this one included), ``kept`` (whether this
    row's id and text stand for the class), and the text's key ``k1``, ``k2``.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = sketches(docs, id_col, text_col, settings)
    me = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    nodes = rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min(me).alias("me"), F.min("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n_copies")
    )
    at = fresh_dir(spark, "set-nodes")
    nodes.write.parquet(at)
    nodes = spark.read.parquet(at)

    banded = nodes.select("set_key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("set_key").alias("leader")).filter("n > 1")
    at = fresh_dir(spark, "bucket-members")
    banded.join(buckets, "band").write.parquet(at)
    members = spark.read.parquet(at)

    # Crowds: what shares large buckets, each linked to the bucket's smallest set only.
    crowds = components(
        members.filter(f"n > {SMALL} and set_key <> leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b"))
    )
    crowds = crowds.join(nodes.select(F.col("set_key").alias("node"), "size"), "node")
    blocks_of = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_HASHES))
    crowded = crowds.groupBy("label").agg(blocks_of.cast("int").alias("n_blocks"))
    crowds = crowds.join(crowded, "label").select(
        F.col("node").alias("set_key"),
        F.col("label").alias("crowd"),
        "n_blocks",
        F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"),
    )

    # Pairs of small buckets: at most (SMALL - 1) / 2 a member. Those inside one crowd are met there.
    small = members.filter(f"n <= {SMALL}").groupBy("band").agg(F.array_sort(F.collect_set("set_key")).alias("of"))
    ranked = small.select(F.posexplode("of").alias("at", "a"), "of")
    pairs = ranked.select("a", F.explode(F.expr("slice(of, at + 2, size(of))")).alias("b")).distinct()
    side = crowds.select("set_key", "crowd")
    size = nodes.select("set_key", "size")
    for end in ("a", "b"):
        own = size.join(side, "set_key", "left").select(
            F.col("set_key").alias(end), F.col("size").alias(f"size_{end}"), F.col("crowd").alias(f"crowd_{end}")
        )
        pairs = pairs.join(own, end)
    apart = ~F.coalesce(F.col("crowd_a") == F.col("crowd_b"), F.lit(False))
    fits = F.least("size_a", "size_b") >= settings.threshold * F.greatest("size_a", "size_b")
    at = fresh_dir(spark, "candidate-pairs")
    pairs.filter(apart & fits).select("a", "b").write.parquet(at)
    pairs = spark.read.parquet(at)

    # Whole sets of candidates alone, from one text each.
    wanted = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).union(crowds.select("set_key")).distinct()
    carriers = nodes.join(wanted, "set_key").select("set_key", "me.*")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), text_key(F.col(text_col)).alias("__k"))
    found = texts.join(
        carriers,
        (F.col("__k.k1") == F.col("k1")) & (F.col("__k.k2") == F.col("k2")) & F.col("__id").eqNullSafe(F.col("id")),
    ).select("set_key", "__text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                hashes, owner = distinct_sets(Texts(block.column(1)), settings.n)
                cuts = np.searchsorted(owner, np.arange(block.num_rows + 1))
                raw = [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(raw, pa.binary())], names=["set_key", "hashes"])

    set_schema = StructType([StructField("set_key", BinaryType()), StructField("hashes", BinaryType())])
    at = fresh_dir(spark, "candidate-sets")
    found.mapInArrow(to_sets, set_schema).dropDuplicates(["set_key"]).write.option("compression", "none").parquet(at)
    sets = spark.read.schema(set_schema).parquet(at)

    at = fresh_dir(spark, "links")
    _verify_pairs(pairs, sets, settings.threshold).write.parquet(at)
    verified = spark.read.parquet(at)

    other = F.explode(F.expr("sequence(0, n_blocks - 1)"))
    spread = crowds.join(sets, "set_key").withColumn("other", other)
    spread = spread.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_key", "hashes")
    at = fresh_dir(spark, "crowd-links")
    spread.groupBy("crowd", "i", "j").applyInArrow(_compare_blocks(settings.threshold), COMPARED).write.parquet(at)
    compared = spark.read.schema(COMPARED).parquet(at)

    edges = verified.union(compared.filter("a <> b").select("a", "b"))
    classes_ = components(edges)
    counts = (
        verified.select(F.col("a").alias("set_key"), F.lit(1).cast("long").alias("links"))
        .union(verified.select("b", F.lit(1).cast("long")))
        .union(compared.filter("links > 0").select("a", "links"))
        .groupBy("set_key")
        .agg(F.sum("links").alias("n_links"))
    )
    # Linked sets alone; written, so that the join back to a large class can be split.
    at = fresh_dir(spark, "linked-sets")
    linked = classes_.select(F.col("node").alias("set_key"), "label").join(nodes.select("set_key", "me"), "set_key").join(counts, "set_key")
    linked.write.parquet(at)
    linked = spark.read.parquet(at)
    heads = linked.groupBy("label").agg(F.min("me").alias("head"))
    headed = linked.join(heads, "label").select("set_key", "head", "n_links")
    answers = nodes.select("set_key", "me", "n_copies").join(headed, "set_key", "left").select(
        "set_key", F.coalesce("head", "me").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    # Written as well: the rows of a set with very many copies can then be split in the join.
    at = fresh_dir(spark, "set-answers")
    answers.write.parquet(at)
    joined = rows.join(spark.read.parquet(at), "set_key", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("head") == me, F.lit(True)).alias("kept"),
        "k1",
        "k2",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of every class, with all its columns: that of the smallest id. Runs jobs when called.

    Rows that repeat id and text keep one. Texts without words all stay.
    """
    found = near_duplicates(docs, id_col, text_col, settings)
    stays = found.filter("kept").groupBy(id_col, "k1", "k2").agg(F.count("*").alias("__n"), F.max("n_copies").alias("__copies"))
    stays = stays.select(F.col(id_col).alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__n", "__copies")
    keyed = docs.withColumn("__k", text_key(F.col(text_col)))
    joined = keyed.join(
        stays,
        (F.col("__k.k1") == F.col("__k1")) & (F.col("__k.k2") == F.col("__k2")) & F.col(id_col).eqNullSafe(F.col("__id")),
    )
    single = joined.filter((F.col("__n") == 1) | (F.col("__copies") == 1)).select(*docs.columns)
    repeated = joined.filter((F.col("__n") > 1) & (F.col("__copies") > 1)).dropDuplicates(["__id", "__k1", "__k2"])
    return single.union(repeated.select(*docs.columns))
