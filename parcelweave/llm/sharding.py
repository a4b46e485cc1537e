"""Extendible hashing: shards of bounded bytes behind a directory of hash prefixes.

A directory entry is a prefix of a row's hash. An entry over the limit splits on its next bit, no
other does, so a row's shard is the shortest prefix of its hash whose rows fit. All depths of one
pass are summed together from a histogram of prefixes; only rows of entries that are still too
large take part in the next, deeper pass.

The hash has 60 bits: 30 of the id and 30 of the text, so rows of one id can part as well. Rows
equal in id and text cannot be told apart by any hash: such an entry is dealt out by ``part``, as
many rows to a part as fit, and at least one. A null id and a null text count as empty strings.
An empty table has no shards, and is written as one empty file. DataFrame functions only; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.operators.ranking import global_rank
from parcelweave.session import cut_lineage

BITS = 60
#: Bits by which a pass looks deeper than the one before.
STEP = 6
#: Rows that one step of dealing out equal rows makes.
DEAL = 100_000


def _hex30(text: Column) -> Column:
    """The first 30 bits of a text's MD5 digest."""
    first = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.shiftright(first, 2)


def row_hash(id_col: str, text_col: str) -> Column:
    """The 60-bit hash of a row."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.shiftleft(_hex30(own), 30).bitwiseOR(_hex30(text))


def _prefix(of: Column, have: int, want: Column | int) -> Column:
    """The first ``want`` bits of a number of ``have`` bits."""
    return F.call_function("shiftright", of, (F.lit(have) - (want if isinstance(want, Column) else F.lit(want))).cast("int"))


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """Entries ``depth``, ``prefix``, ``shard_bytes``, ``shard_rows`` of rows with ``hash`` and ``bytes``. Runs jobs when called.

    Also ``cell_depth`` and ``cell``: the finest prefixes at which rows find their entry. An entry of
    the full depth may exceed the limit; every other fits.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(1, (total // max(limit, 1)).bit_length()) + 2)
    begin, pending, found = 0, hashed.select("hash", "bytes"), None
    while True:
        cells = pending.groupBy(_prefix(F.col("hash"), BITS, depth).alias("cell")).agg(
            F.sum("bytes").alias("b"), F.count("*").alias("n")
        )
        cells = cut_lineage(cells)
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(begin), F.lit(depth))))
        levels = levels.withColumn("prefix", _prefix(F.col("cell"), depth, F.col("depth")))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        leaf = F.struct("depth", "prefix", "shard_bytes", "shard_rows")
        leaves = (
            levels.select("cell", "depth", "prefix")
            .join(fits, ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min(leaf).alias("leaf"))
            .select(F.lit(depth).alias("cell_depth"), "cell", "leaf.*")
        )
        leaves = cut_lineage(leaves)
        found = leaves if found is None else found.union(leaves)
        over = cells.join(leaves, "cell", "left_anti").select("cell")
        if depth == BITS or over.limit(1).count() == 0:
            return found
        # Only rows of entries that are still too large go on.
        pending = pending.withColumn("cell", _prefix(F.col("hash"), BITS, depth)).join(over, "cell", "left_semi")
        pending = cut_lineage(pending.select("hash", "bytes"))
        begin, depth = depth + 1, min(BITS, depth + STEP)


def shard_rows(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard: ``id_col``, ``bytes`` (of its text), ``depth``, ``prefix``, ``part``, ``shard_bytes``, ``shard_rows``.

    ``shard_bytes`` and ``shard_rows`` are those of the directory entry, before it is dealt into parts.
    """
    hashed = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
        row_hash(id_col, text_col).alias("hash"),
    )
    entries = directory(hashed, limit)
    depths = [r["cell_depth"] for r in entries.select("cell_depth").distinct().collect()]  # at most one a pass
    placed = None
    for depth in sorted(depths):
        level = entries.filter(F.col("cell_depth") == depth).drop("cell_depth")
        rows = hashed.withColumn("cell", _prefix(F.col("hash"), BITS, depth)).join(level, "cell").drop("cell")
        placed = rows if placed is None else placed.union(rows)
    if placed is None:
        placed = hashed.filter("false").crossJoin(entries.limit(0).drop("cell_depth", "cell"))
    whole = placed.filter(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long")).drop("hash")
    # Equal rows: counted, then dealt out again in steps, so that no task makes all of them.
    keys = ["id", "bytes", "depth", "prefix", "shard_bytes", "shard_rows"]
    equal = placed.filter(F.col("shard_bytes") > limit).groupBy(*keys).agg(F.count("*").alias("n"))
    steps = equal.withColumn("step", F.explode(F.expr(f"sequence(0L, (n - 1) div {DEAL})"))).repartition("id", "step")
    each = steps.withColumn("at", F.explode(F.expr(f"sequence(step * {DEAL}, least(n, (step + 1) * {DEAL}) - 1)")))
    fit = F.greatest(F.expr(f"{int(limit)}L div greatest(bytes, 1)"), F.lit(1))
    dealt = each.withColumn("part", F.floor(F.col("at") / fit).cast("long"))
    columns = ["id", "bytes", "depth", "prefix", "part", "shard_bytes", "shard_rows"]
    return whole.select(*columns).union(dealt.select(*columns)).withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``docs``, one folder a shard (``shard=<depth>-<prefix>-<part>``).

    Rows equal in id and text beyond the limit are numbered over many tasks and dealt into parts, as many rows to
    a part as fit, and at least one. An empty table leaves one empty file, so that the folder can be read. A column
    called ``shard``, or one that begins like the names used inside, is refused.
    """
    taken = [c for c in docs.columns if c == "shard" or c.startswith("__")]
    if taken:
        raise ValueError(f"columns that writing shards needs itself: {', '.join(taken)}")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    hashed = docs.withColumns({"__hash": row_hash(id_col, text_col), "__bytes": size})
    entries = directory(hashed.select(F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes")), limit)
    placed = None
    for depth in sorted(r["cell_depth"] for r in entries.select("cell_depth").distinct().collect()):
        level = entries.filter(F.col("cell_depth") == depth).select(
            F.col("cell").alias("__cell"), F.format_string("%02d-%015x", "depth", "prefix").alias("__name"), (F.col("shard_bytes") > limit).alias("__over")
        )
        rows = hashed.withColumn("__cell", _prefix(F.col("__hash"), BITS, depth)).join(level, "__cell").drop("__cell")
        placed = rows if placed is None else placed.union(rows)
    if placed is None:
        docs.withColumn("shard", F.lit(None).cast("string")).limit(0).write.parquet(path)
        return
    whole = placed.filter("not __over").withColumn("__part", F.lit(0).cast("long"))
    # Equal rows differ in nothing that could part them but their place in the table.
    equal = placed.filter("__over").withColumn("__place", F.monotonically_increasing_id())
    numbered = global_rank(equal, ["__hash"], [F.col("__place").asc()], "__number").drop("__place")
    fit = F.greatest(F.expr(f"{int(limit)}L div greatest(__bytes, 1)"), F.lit(1))
    dealt = numbered.withColumn("__part", F.floor((F.col("__number") - 1) / fit).cast("long")).drop("__number")
    every = whole.unionByName(dealt).withColumn("shard", F.format_string("%s-%d", "__name", "__part"))
    every.drop("__hash", "__bytes", "__name", "__over", "__part").repartition("shard").write.partitionBy("shard").parquet(path)
