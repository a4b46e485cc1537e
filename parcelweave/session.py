"""Session defaults, the shared work folder, and size-checked joins."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state that outgrows the heap, and sessions merged before the shuffle.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # HTML rows are wide: bound Arrow batches by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings this library is tuned for; all of them are optional."""
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def work_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder, which goes when
    the process ends. What lies in a shared folder belongs to whoever set it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="parcelweave-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that lost executors never replay earlier iterations."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own size estimate of a plan, if it can be had."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _broadcast_limit(spark: SparkSession) -> int:
    """The size up to which Spark broadcasts a side by itself; -1 for never."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower()
    found = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", text)
    return int(found[1]) * _UNITS[found[2]] if found else 10 << 20


SMALL_BYTES = 256 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Rows of a small table over all cores, for work that costs far more than a shuffle of it.

    A small table may lie in one split. Larger ones have splits enough and are left alone.
    """
    size = None if df.isStreaming else estimated_bytes(df)
    if size is None or size > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, keys: list[str], parts: int | None = None, tracked: int = 8192) -> dict[int, int]:
    """Hashes of the keys with more rows than an even share of a shuffle partition, and their shares.

    ``parts`` is the number of partitions to be even over, by default the session's, so both the
    threshold and the shares follow from the rows and the cluster; there are at most ``parts`` such keys.
    One mergeable sketch over the key columns alone, which runs when called. The result only steers
    how a join is spread; it has no part in what the join returns.
    """
    parts = parts or shuffle_parts(df.sparkSession)
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    row = hashed.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h, {parts}, {max(tracked, 8 * parts)})").alias("top")
    ).first()
    even = max(1.0, row["n"] / parts)
    return {t["item"]: min(parts, math.ceil(t["count"] / even)) for t in row["top"] if t["count"] > even}


def _hashable(kind: DataType) -> bool:
    """Maps and variants have no hash."""
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


#: Copies of one row that a task makes at a time when equal rows are dealt out again.
COPIES = 100_000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str = "hot",
    salts: int | None = None,
    null_safe: bool = False,
    heavy: Mapping[int, int] | Collection[int] | None = None,
    unique: str | None = None,
) -> DataFrame:
    """Equi join where a single key of ``big`` may hold a large share of its rows.

    ``small`` must hold few rows per key. When Spark's own estimate lets it broadcast
    ``small``, no salt is added. Otherwise rows of a heavy key in ``big`` spread over
    ``salts`` tasks and its rows in ``small`` are repeated once per salt. With ``spread`` at
    ``hot`` only keys found heavy are salted, in as many parts as their rows ask for (give ``heavy`` to
    reuse an earlier finding; else one job runs when this is called); ``all`` salts every key, for
    sides of few keys. The salt of a row is a hash of its other columns, or of ``unique``, a column that
    differs from row to row: name it where the others repeat. ``null_safe`` lets null match null.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salting does not preserve a {how} join")
    parts = shuffle_parts(big.sparkSession)
    if set(big.columns) == set(on):
        # Rows differ in nothing a salt could use: join one of each and repeat it afterwards,
        # in steps that are dealt out, so that no task makes all copies of a row.
        counted = big.groupBy(*on).agg(F.count("*").alias("__n"))
        joined = salted_join(counted, small, on, how, spread, salts, null_safe, heavy=[])
        steps = joined.withColumn("__step", F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPIES})")))
        dealt = steps.repartition(*[F.col(c) for c in on], "__step")
        rest = F.least(F.lit(COPIES).cast("bigint"), F.col("__n") - F.col("__step") * COPIES)
        copies = dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), rest)))
        return copies.drop("__n", "__step", "__copy")
    mine = [f"__k{i}" for i in range(len(on))]
    left = big
    right = small.select(
        *[F.col(k).cast(big.schema[k].dataType).alias(m) for k, m in zip(on, mine)],
        *[c for c in small.columns if c not in on],
    )
    matched = F.lit(True)
    for key, own in zip(on, mine):
        matched = matched & (F.col(key).eqNullSafe(F.col(own)) if null_safe else F.col(key) == F.col(own))
    size = estimated_bytes(small)
    if size is None or size > _broadcast_limit(big.sparkSession):
        if spread == "hot" and heavy is None:
            heavy = heavy_keys(big, on)
        if spread == "all" or heavy:
            if salts is None:
                salts = max(heavy.values()) if spread == "hot" and isinstance(heavy, Mapping) else parts
            rest = [F.col(f.name) for f in big.schema if f.name not in on and _hashable(f.dataType)]
            from_row = [F.col(unique)] if unique else rest or [F.col(k) for k in on]
            salt = F.pmod(F.xxhash64(*from_row), F.lit(salts)).cast("int")
            every, first = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
            if spread == "hot":
                hot = list(heavy)
                salt = F.when(F.xxhash64(*on).isin(hot), salt).otherwise(0)
                every = F.when(F.xxhash64(*mine).isin(hot), every).otherwise(first)
            left = big.withColumn("__salt", salt)
            right = right.withColumn("__copy", F.explode(every))
            matched = matched & (F.col("__salt") == F.col("__copy"))
    joined = left.join(right, matched, how)
    extra = [c for c in small.columns if c not in on] if how in {"inner", "left"} else []
    return joined.select(*big.columns, *extra)
