"""Merkle manifest of a dataset: content-addressed records, proofs by descent from the root.

Every row is a leaf: the digest of its fields. Within a group leaves are ordered; every ``FAN`` consecutive
digests become the digest of their concatenation until one is left, the group's subroot; subroots in
the order of their groups become the root likewise. What is stored is content-addressed: records of a
digest and its children, each digest once, in one folder per height.

A proof is found from the root alone. Requests (a group and a rank) descend by the digits of the
group's place and of the rank: the requests that share a prefix of digits descend as one row, which joins
the record of its digest, picks the wanted children and keeps the others as a path segment. Segments come
root first and are reversed for the proof. Digests are kept as 32 bytes and are hashed as hexadecimal text.

A null field counts as ``-``, others as their UTF-8 length, ``:`` and value, so empty and null differ. Null
groups are one group that comes first; null ids come first in their group. Rows that are equal in group
and order are told apart by their digest; if that is equal, too, their order makes no difference. A group
of one row is its own subroot, a single group's subroot is the root. An empty table has no root and
no proofs. Texts are hashed whole where they are read, whatever their length; they are never shuffled.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.operators.ranking import global_rank
from parcelweave.session import fresh_dir, salted_join

FAN = 16


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in lower-case hexadecimal of all fields, each with its length before it."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def hexadecimal(binary: Column) -> Column:
    return F.lower(F.hex(binary))


@dataclass
class Manifest:
    """Where the tables lie, the root in hexadecimal (None for an empty table), and how high the trees are."""

    folder: str
    root: str | None
    group_height: int
    top_height: int

    def leaves(self, spark: SparkSession) -> DataFrame:
        """``tree`` (place of the group), ``rank`` (both from 0), ``leaf`` and the columns that were carried."""
        return spark.read.parquet(f"{self.folder}/leaves")

    def groups(self, spark: SparkSession) -> DataFrame:
        """``tree``, the group's value ``group``, ``rows``, ``height``, ``subroot``."""
        return spark.read.parquet(f"{self.folder}/groups")

    def records(self, spark: SparkSession, part: str, height: int) -> DataFrame:
        """``digest`` and ``children`` of the nodes of a height: of the groups (``group``) or above them (``top``)."""
        return spark.read.parquet(f"{self.folder}/{part}-records/height={height}")


def climb(level: DataFrame, largest: int, folder: str, part: str) -> tuple[DataFrame, int]:
    """Top nodes (``tree``, ``node``, ``height``) of all trees over ``level`` (``tree``, ``rank``, ``node``, ``rows``), and the greatest height.

    Writes the records of each height. A run of children is one group of at most ``FAN`` rows.
    """
    spark = level.sparkSession
    tops = [level.filter("rows = 1").select("tree", "node", F.lit(0).alias("height"))]
    height = 0
    while largest > 1:
        height += 1
        largest = -(-largest // FAN)
        run = (
            level.filter("rows > 1")
            .groupBy("tree", F.expr(f"rank div {FAN}").alias("rank"), F.expr(f"(rows + {FAN - 1}) div {FAN}").alias("rows"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", "node")))["node"].alias("children"))
        )
        text = hexadecimal(F.expr("aggregate(children, cast('' as binary), (a, c) -> concat(a, c))"))
        at = f"{folder}/{part}-levels/height={height}"
        run.withColumn("node", F.unhex(F.sha2(text, 256))).write.parquet(at)
        level = spark.read.parquet(at)
        level.select(F.col("node").alias("digest"), "children").dropDuplicates(["digest"]).write.parquet(
            f"{folder}/{part}-records/height={height}"
        )
        tops.append(level.filter("rows = 1").select("tree", "node", F.lit(height).alias("height")))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return found, height


def build(
    docs: DataFrame, fields: Sequence[str], group_col: str, order_col: str, carry: Mapping[str, Column] | None = None
) -> Manifest:
    """Write the manifest of a table into a new folder of the shared one; runs jobs when called.

    ``fields`` are digested in their order. ``carry`` names more columns of each leaf, computed in the same pass.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "manifest")
    carried = {f"c_{name}": column for name, column in (carry or {}).items()}
    docs.select(
        F.col(group_col).alias("group"), F.col(order_col).alias("order"),
        F.unhex(digest([F.col(f) for f in fields])).alias("leaf"), *[c.alias(name) for name, c in carried.items()],
    ).write.parquet(f"{folder}/unplaced")
    unplaced = spark.read.parquet(f"{folder}/unplaced")
    counted = unplaced.groupBy("group").agg(F.count("*").alias("rows"))
    global_rank(counted, [], [F.col("group").asc()], "tree").withColumn("tree", F.col("tree") - 1).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    ranked = global_rank(unplaced, ["group"], [F.col("order").asc(), F.col("leaf").asc()], "rank")
    salted_join(ranked.withColumn("rank", F.col("rank") - 1), counts, ["group"], null_safe=True).select(
        "tree", "rank", "rows", "order", "leaf", *carried
    ).write.parquet(f"{folder}/leaves")
    size = counts.agg(F.count("*").alias("groups"), F.max("rows").alias("rows")).first()
    level = spark.read.parquet(f"{folder}/leaves").select("tree", "rank", "rows", F.col("leaf").alias("node"))
    tops, group_height = climb(level, size["rows"] or 0, folder, "group")
    salted_join(counts, tops.withColumnRenamed("node", "subroot"), ["tree"], heavy=[]).write.parquet(f"{folder}/groups")
    subroots = spark.read.parquet(f"{folder}/groups").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(size["groups"]).cast("long").alias("rows"),
        F.col("subroot").alias("node"),
    )
    top, top_height = climb(subroots, size["groups"], folder, "top")
    root = top.select(hexadecimal(F.col("node"))).first()
    return Manifest(folder, root[0] if root else None, group_height, top_height)


def _descend(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Each node's children: their place, digest and path, where the other children are the last segment."""
    width = 32
    met = salted_join(frontier, records, ["digest"])
    one = met.select("*", F.posexplode("children").alias("digit", "child"))
    joined = F.expr("aggregate(children, cast('' as binary), (a, c) -> concat(a, c))")
    segment = F.struct(
        F.substring(joined, F.lit(1), F.col("digit") * width).alias("before"),
        F.substring(joined, (F.col("digit") + 1) * width + 1, F.size("children") * width).alias("after"),
    )
    kept = [c for c in frontier.columns if c not in ("rank", "digest", "path")]
    return one.select(
        *kept,
        (F.col("rank") * FAN + F.col("digit")).alias("rank"),
        F.col("child").alias("digest"),
        F.concat("path", F.array(segment)).alias("path"),
    )


_PATH = "array<struct<before:binary,after:binary>>"


def proofs(spark: SparkSession, manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requests with what the descent from the root finds: ``leaf``, ``subroot`` and ``path``, leaf first.

    ``requests`` has ``tree`` and ``rank``, each pair once, and any other columns but the three. A
    request for a leaf that isn't there has no row. Writes what each level of the groups reaches; runs jobs when called.
    """
    if manifest.root is None:
        none = [F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(_PATH).alias("path")]
        return requests.select("*", *none).filter("false")
    rest = F.struct("rank", *[c for c in requests.columns if c not in ("tree", "rank")])
    # Requests of one run of leaves, at most FAN, travel as one row.
    folder = fresh_dir(spark, "descent")
    runs = requests.groupBy("tree", F.expr(f"rank div {FAN}").alias("run")).agg(F.collect_list(rest).alias("asked"))
    # What the levels ask for again and again is written once, so that no plan holds it many times.
    requests.select("tree", F.expr(f"rank div {FAN}").alias("rank")).distinct().write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")

    frontier = spark.createDataFrame([(0, manifest.root)], "rank long, hex string").select(
        "rank", F.unhex("hex").alias("digest"), F.array().cast(_PATH).alias("path")
    )
    for height in range(manifest.top_height, 0, -1):
        places = wanted.select(F.expr(f"tree div {FAN ** (height - 1)}").alias("rank")).distinct()
        frontier = _descend(frontier, manifest.records(spark, "top", height)).join(places, "rank", "left_semi")
    # What the digits of the group's place lead to is its subroot; from there the digits of the rank lead on.
    salted_join(
        frontier.withColumnRenamed("rank", "tree"), manifest.groups(spark).select("tree", "height"), ["tree"], heavy=[]
    ).select("tree", F.col("digest").alias("subroot"), "height", F.lit(0).cast("long").alias("rank"), "digest", "path").write.parquet(
        f"{folder}/entered"
    )
    entered = spark.read.parquet(f"{folder}/entered")

    def at_height(height: int) -> DataFrame:
        return entered.filter(F.col("height") == height).drop("height")

    frontier = None
    for height in range(manifest.group_height, 0, -1):
        frontier = at_height(height) if frontier is None else frontier.unionByName(at_height(height))
        if height > 1:
            places = wanted.select("tree", F.expr(f"rank div {FAN ** (height - 2)}").alias("rank")).distinct()
            at = f"{folder}/reached-{height - 1}"
            _descend(frontier, manifest.records(spark, "group", height)).join(places, ["tree", "rank"], "left_semi").write.parquet(at)
            frontier = spark.read.parquet(at)
    # The last run: its leaves meet the requests for them, one row a request.
    single = at_height(0).select("tree", "rank", "subroot", F.array("digest").alias("children"), "path", F.lit(False).alias("in_run"))
    if frontier is not None:
        last = salted_join(frontier, manifest.records(spark, "group", 1), ["digest"])
        single = single.unionByName(last.select("tree", "rank", "subroot", "children", "path", F.lit(True).alias("in_run")))
    met = single.withColumnRenamed("rank", "run").join(runs, ["tree", "run"]).select("*", F.explode("asked").alias("one"))
    digit = F.expr(f"cast(one.rank % {FAN} as int)")
    others = F.struct(
        F.expr(f"aggregate(slice(children, 1, cast(one.rank % {FAN} as int)), cast('' as binary), (a, c) -> concat(a, c))").alias("before"),
        F.expr(
            f"aggregate(slice(children, cast(one.rank % {FAN} as int) + 2, {FAN}), cast('' as binary), (a, c) -> concat(a, c))"
        ).alias("after"),
    )
    whole = F.when(F.col("in_run"), F.concat("path", F.array(others))).otherwise(F.col("path"))
    there = met.filter(digit < F.size("children"))
    names = [c for c in requests.columns if c not in ("tree", "rank")]
    return there.select(
        "tree", F.col("one.rank").alias("rank"), *[F.col("one")[c].alias(c) for c in names],
        F.get("children", digit).alias("leaf"), "subroot", F.reverse(whole).alias("path"),
    )


def fold(leaf: Column, path: Column) -> Column:
    """Root in hexadecimal that a leaf (hexadecimal) and the path of a proof make."""
    return F.aggregate(
        path, leaf, lambda below, s: F.sha2(F.concat(hexadecimal(s["before"]), below, hexadecimal(s["after"])), 256)
    )


def siblings(path: Column) -> Column:
    """The digests of a proof in its order, as one string of hexadecimal."""
    return hexadecimal(F.aggregate(path, F.lit(b""), lambda a, s: F.concat(a, s["before"], s["after"])))
