"""Prefix trie of conversations by block hashing.

A node is a distinct sequence of first turns. Conversations are cut into blocks of ``BLOCK`` turns; the
digest of a block combines its turns' digests with their places, and the digests of successive blocks
combine to a chain. Conversations are first grouped by their chains, so each distinct block is kept
once with the number of its conversations and the smallest. Turn boundaries are refined among distinct
blocks alone, and only where the same chain goes on with several; a block without siblings gives its
nodes as they are, without grouping.

What a subtree holds follows from its members: the smallest member of a node owns it, so every conversation
owns the end of its path from some depth on, or nothing. Words before that depth are those it shares with
smaller ones. Sums of these per distinct block give leaves and saved words of all nodes without a
walk through the levels, however long conversations are.

Texts are digested where they are read and never shuffled. Turns are numbered and chains combined over
ranges of rows that are sorted by conversation, so one conversation may span many tasks; the driver sees
one row per range. No group is gathered but the turns of one block; ids of conversations that end at one
node are hashed in their order from a sorted stream of bounded pieces.

Turns are ordered by number, null first; turns that share a number by role and digest, all are kept, so
repeated rows count as turns. A null role or text is empty, a null conversation id takes no part. A
conversation without turns is a member of the root alone. An empty table has no nodes, not even a root. Digests
of paths have 128 bits; nothing checks for collisions. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from parcelweave.llm.ship import ship
from parcelweave.operators.ranking import in_ranges
from parcelweave.session import fresh_dir, salted_join

#: Turns of a block.
BLOCK = 4
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder once and read from there."""
    at = fresh_dir(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def turns_of(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv``, ``place`` from 0, ``digest`` and ``words`` of every turn; runs jobs when called."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    narrow = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("place"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    numbered = accumulate(stored(narrow, "turns"), "conv", order, sums=["place"])
    return numbered.select("conv", (F.col("place") - 1).alias("place"), "digest", "words")


def accumulate(rows: DataFrame, key: str, order: Sequence[Column], sums: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """Rows with the named long columns replaced by their running sum or exclusive or within the key, and ``last``.

    ``last`` marks the last row of each key. A key may span many ranges; what it holds in earlier ones is
    known from one row per range. Runs jobs when called.
    """
    placed = in_ranges(rows, [key], order)
    edges = (
        placed.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last")).orderBy("__part")
    ).collect()  # one row a range
    follows = {a["__part"]: b["first"] for a, b in zip(edges, edges[1:])}
    spanning = sorted({b["first"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]})
    before: dict[int, list[int]] = {}
    if spanning:
        keys = rows.sparkSession.createDataFrame([(k,) for k in spanning], StructType([rows.schema[key]]))
        totals = (
            placed.join(F.broadcast(keys), key)  # fewer than there are ranges
            .groupBy(key, "__part")
            .agg(*[F.sum(c).alias(c) for c in sums], *[F.bit_xor(c).alias(c) for c in xors])
            .orderBy(key, "__part")
        )
        held, so_far = None, []
        for row in totals.collect():  # at most two rows a range
            if row[key] != held:
                held, so_far = row[key], [0] * (len(sums) + len(xors))
            if any(e["__part"] == row["__part"] and e["first"] == held for e in edges):
                before[row["__part"]] = so_far
            own = [row[c] for c in (*sums, *xors)]
            so_far = [a + b for a, b in zip(so_far, own[: len(sums)])] + [a ^ b for a, b in zip(so_far[len(sums) :], own[len(sums) :])]
    columns = rows.columns
    names = [*columns, "last"]
    at_key, at_values = columns.index(key), [columns.index(c) for c in (*sums, *xors)]
    n_sums = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried, first = None, None, True
        part, at_part = None, len(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(at_part)[0].as_py()
            own = batch.column(at_key).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sizes = np.diff(np.append(starts, len(own)))
            if first:
                carried = before.get(part)
            elif held is not None and own[0] != held.column(at_key)[0].as_py():
                carried = None
            values = []
            for i, at in enumerate(at_values):
                v = batch.column(at).to_numpy()
                if i < n_sums:
                    run_of = np.cumsum(v)
                    begin = np.concatenate(([0], run_of))[starts]
                    begin[0] -= carried[i] if carried else 0
                    values.append(run_of - np.repeat(begin, sizes))
                else:
                    run_of = np.bitwise_xor.accumulate(v)
                    begin = np.concatenate(([0], run_of))[starts]
                    begin[0] ^= carried[i] if carried else 0
                    values.append(run_of ^ np.repeat(begin, sizes))
            carried = [int(v[-1]) for v in values]
            arrays = list(batch.columns[: len(columns)])
            for at, v in zip(at_values, values):
                arrays[at] = pa.array(v)
            last = np.concatenate((own[1:] != own[:-1], [False]))
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(last)], names=names)
            if held is not None:
                yield ended(held, held.column(at_key)[0].as_py() != own[0])
            # Whether a batch's last row ends its key is known from the next.
            held, first = out.slice(out.num_rows - 1), False
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield ended(held, follows.get(part) != held.column(at_key)[0].as_py())

    def ended(row: pa.RecordBatch, is_last: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([bool(is_last)])], names=names)

    ship(rows.sparkSession)
    schema = StructType([*[StructField(c, rows.schema[c].dataType) for c in columns], StructField("last", BooleanType())])
    return placed.select(*columns, "__part").mapInArrow(run, schema)


def share_heads(turns: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Conversations rebuilt to share beginnings: the first h turns are those of the last one whose id ``every`` divides.

    h is the crc32 of the decimal id modulo ``kinds``; own turns after the first h follow. Columns as in ``turns``.
    """
    own_h = (F.crc32(F.col("conv").cast("string").cast("binary")) % kinds).alias("h")
    base = (F.col("conv") - F.col("conv") % every).alias("base")
    heads = (
        turns.filter((F.col("conv") % every == 0) & (F.col("place") < kinds - 1))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    )
    met = salted_join(turns.select("*", own_h, base), heads, ["base"], "left", unique="place")
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))
    own = met.filter(F.col("place") >= F.col("h")).select("conv", (F.col("place") - F.col("h") + taken).alias("place"), "digest", "words")
    first = met.filter("place = 0").select("conv", F.explode(F.slice("head", F.lit(1), taken.cast("int"))).alias("t"))
    return own.unionByName(first.select("conv", "t.place", "t.digest", "t.words"))


NODE = ["depth", "x", "y"]


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: chain before (``px``, ``py``) and after (``x``, ``y``), path words after, its turns."""
    t = turns.select(
        "conv", F.expr(f"place div {BLOCK}").alias("block"), "place", "words",
        F.xxhash64("place", "digest").alias("tx"), F.xxhash64("digest", "place", F.lit("y")).alias("ty"),
    )
    whole = t.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "tx", "ty", "words"))).alias("turns"),
        F.bit_xor("tx").alias("x"), F.bit_xor("ty").alias("y"), F.sum("words").alias("upto"),
    )
    whole = whole.withColumns({"own_x": F.col("x"), "own_y": F.col("y"), "own_words": F.col("upto")})
    chained = accumulate(whole, "conv", [F.col("block").asc()], sums=["upto"], xors=["x", "y"])
    return chained.select(
        "conv", "block", F.col("x").bitwiseXOR(F.col("own_x")).alias("px"), F.col("y").bitwiseXOR(F.col("own_y")).alias("py"),
        "x", "y", (F.col("block") * BLOCK + F.size("turns")).alias("depth"), "upto", (F.col("upto") - F.col("own_words")).alias("before"),
        "turns", "last",
    )


def _nodes(distinct: DataFrame, sums: dict[str, Column], mins: dict[str, Column]) -> DataFrame:
    """Nodes of all turns of distinct blocks (with ``siblings``): named sums and minima, path words before, words, parent."""
    step = "named_struct('place', t.place, 'x', a.x ^ t.tx, 'y', a.y ^ t.ty, 'px', a.x, 'py', a.y, 'words', t.words, 'before', a.before + a.words)"
    start = "named_struct('place', -1L, 'x', px, 'y', py, 'px', px, 'py', py, 'words', 0L, 'before', before)"
    path = F.expr(
        f"slice(aggregate(turns, array({start}), (r, t) -> concat(r, transform(array(element_at(r, -1)), a -> {step}))), 2, {BLOCK})"
    )
    one = distinct.withColumn("t", F.explode(path)).select("*", F.col("t.before").alias("path_before"), (F.col("t.place") + 1).alias("node_depth"))
    ends = F.col("node_depth") == F.col("depth")
    flat = one.select(
        F.col("node_depth").alias("depth"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.px").alias("px"), F.col("t.py").alias("py"),
        F.col("t.words").alias("words"), F.col("path_before").alias("before"), "siblings",
        F.when(ends, F.col("n_ends")).otherwise(F.lit(0).cast("long")).alias("n_ends"), F.when(ends, F.col("end_conv")).alias("end_conv"),
        *[c.alias(name) for name, c in {**sums, **mins}.items()],
    )
    refined = (
        flat.filter("siblings > 1")
        .groupBy(*NODE)
        .agg(
            *[F.min(c).alias(c) for c in ("px", "py", "words", "before")],
            F.sum("n_ends").alias("n_ends"), F.min("end_conv").alias("end_conv"),
            *[F.sum(name).alias(name) for name in sums], *[F.min(name).alias(name) for name in mins],
        )
    )
    return flat.filter("siblings = 1").drop("siblings").unionByName(refined)


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conversations of each node, decimal, ascending, comma-joined: ``depth``, ``x``, ``y``, ``ends_sha256``.

    ``ends`` has ``depth``, ``x``, ``y``, ``conv``. Ids become pieces of at most 50,000 over many tasks; a node's pieces are
    hashed one after the other from a sorted stream.
    """
    placed = in_ranges(ends, NODE, [F.col("conv").asc()])
    # The lower 33 bits of a row's number count the rows of its task.
    piece = F.expr("(__at & 8589934591) div 50000").alias("piece")
    pieces = placed.groupBy(*NODE, "__part", piece).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "__part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if node != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield as_batch(done)
        if held is not None:
            yield as_batch([(*held, state.hexdigest())])

    def as_batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])

    schema = StructType([*[StructField(c, LongType()) for c in NODE], StructField("ends_sha256", StringType())])
    return ordered.select(*NODE, "ids").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, counts, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv``, ``place`` from 0, ``digest``, ``words``; ``convs`` has ``conv``, each conversation
    once, also those without turns. Runs jobs when called.
    """
    spark = turns.sparkSession
    blocks = stored(blocks_of(turns), "blocks")
    grouped = stored(
        blocks.groupBy(*NODE, "block", "px", "py").agg(
            F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("turns").alias("turns"), F.first("before").alias("before"),
            F.count(F.when(F.col("last"), 1)).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end_conv"),
        ),
        "distinct-blocks",
    )
    parent = ["block", "px", "py"]
    siblings = grouped.groupBy(*parent).agg(F.count("*").alias("siblings"))
    distinct = stored(salted_join(grouped, siblings, parent), "block-siblings")

    nodes = stored(_nodes(distinct, {"n": F.col("n")}, {"conv": F.col("conv")}), "nodes")
    children = stored(
        nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children")),
        "children",
    )
    # From which path words on a conversation owns its nodes, and whether its end is a leaf it owns.
    childless = nodes.join(children, NODE, "left").withColumn("leaf", F.col("n_children").isNull().cast("long"))
    owned = childless.groupBy("conv").agg(F.min_by("before", "depth").alias("owned_from"), F.max_by("leaf", "depth").alias("leaf"))
    shared = (
        blocks.filter("last")
        .select("conv", "upto")
        .join(owned, "conv", "left")
        .select("conv", F.coalesce("owned_from", "upto").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    )
    per_block = (
        salted_join(blocks.select(*NODE, "conv"), shared, ["conv"], unique="depth")
        .groupBy(*NODE)
        .agg(F.sum("shared").alias("shared"), F.min_by("shared", "conv").alias("shared_first"), F.sum("leaf").alias("leaves"))
    )
    # Words that members share below a node's start: all but the smallest share the whole block.
    others = F.col("shared") - F.col("shared_first") - (F.col("n") - 1) * F.col("path_before")
    full = _nodes(
        distinct.join(per_block, NODE),
        {"n": F.col("n"), "leaves": F.col("leaves"), "saved": others + F.greatest(F.col("shared_first") - F.col("path_before"), F.lit(0))},
        {"conv": F.col("conv")},
    )
    full = stored(full.join(children, NODE, "left"), "nodes-full")
    total = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    if not total["n"]:
        return spark.createDataFrame([], _RESULT)
    top = full.agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("children"), F.count(F.when(F.col("n_children").isNull(), 1)).alias("leaves"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("words")), F.lit(0)).alias("saved"),
    ).first()

    ended = blocks.filter("last").select(*NODE, "conv")
    turnless = stored(convs.select("conv").join(ended.select("conv"), "conv", "left_anti"), "turnless")
    several = full.filter("n_ends > 1").select(*NODE, F.lit(True).alias("several"))
    # Nodes where one conversation ends need no order.
    many = salted_join(ended, several, NODE, unique="conv").drop("several")
    zero = F.lit(0).cast("long")
    digests = ends_digests(many.unionByName(turnless.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv")))
    none = F.lit(hashlib.sha256(b"").hexdigest())

    root = spark.createDataFrame(
        [(total["conv"], 0, None, total["n"], top["children"], max(top["leaves"], 1), top["saved"], 0, 0)],
        "conv long, depth long, parent long, n long, n_children long, leaves long, saved long, x long, y long",
    )
    above = full.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent"))
    inner = salted_join(full.filter("depth > 1"), above, ["depth", "px", "py"])
    first = full.filter("depth = 1").withColumn("parent", F.lit(total["conv"]).cast("long"))
    columns = ["conv", "depth", "parent", "n", "n_children", "leaves", "saved", *NODE[1:], "n_ends", "end_conv"]
    rows = inner.select(*columns).unionByName(first.select(*columns)).unionByName(
        root.withColumns({"n_ends": F.lit(2).cast("long"), "end_conv": F.lit(None).cast("long")}).select(*columns)
    )
    met = rows.join(digests, NODE, "left")
    return met.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(F.col("n_ends") == 1, F.sha2(F.col("end_conv").cast("string"), 256)).otherwise(F.coalesce("ends_sha256", none)).alias("ends_sha256"),
    )


_RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
