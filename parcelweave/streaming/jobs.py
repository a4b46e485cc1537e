"""The same operators on unbounded input.

Each function takes or returns a streaming DataFrame, or starts a query with a checkpoint, so
a restart resumes where the last batch was committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelweave.operators.pages import parse_pages
from parcelweave.operators.upsert import last_write_wins, reject_keyless, upsert

IDLE_SECONDS = 5


def read_stream(
    spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a directory as they arrive, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def continuous_ingest(pages: DataFrame, config: Mapping, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Parse arriving pages into records; polls when idle, or stops once all input is done."""
    return start_append(parse_pages(pages, config), path, checkpoint, drain)


def start_append(stream: DataFrame, path: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if drain else {"processingTime": f"{IDLE_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all available input, stop, and return what the sink holds."""
    query = start_append(stream, path, checkpoint, drain=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _write_delta(path: str) -> Callable[[DataFrame, int], None]:
    """Batch n goes to its own partition, overwritten when the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_upsert(
    stream: DataFrame, key: Sequence[str], order: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Write the newest row per key of every batch as a delta; work is bound by the batch.

    ``read_upserted`` resolves deltas on reading, and its result can be written as a new base.
    """
    write = _write_delta(path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        write(last_write_wins(reject_keyless(batch, key), key, order), batch_id)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_upserted(
    spark: SparkSession,
    path: str,
    key: Sequence[str],
    base: DataFrame | None = None,
    strategy: str = "merge",
    order: Sequence[str] = (),
) -> DataFrame:
    """The table after all deltas: the row of the last batch per key, over an optional base.

    Give ``order`` when a late batch may hold older rows than an earlier one. Where ``compact`` made a base, only
    buckets that later deltas touch are merged, the others are read as they lie; a job over the keys of
    later deltas finds them when this is called.
    """
    held = _base(spark, path)
    if held is None:
        latest = last_write_wins(spark.read.option("basePath", path).parquet(path), key, [*order, "batch"]).drop("batch")
    else:
        later = _later(spark, path, held)
        _, touched = _reach(later, key, held.buckets)
        merged = _merged(spark, path, held, later, key, order, touched).drop(_BUCKET)
        calm = held.read(spark, path, [b for b in held.versions if b not in touched])
        latest = merged if calm is None else calm.drop(_BUCKET).unionByName(merged) if touched else calm.drop(_BUCKET)
    return latest if base is None else upsert(base, latest, key, strategy)


#: Parts of a base unless ``compact`` is told otherwise.
BUCKETS = 64
_BUCKET = "__bucket"
_MANIFEST = "upto int, buckets int, bucket int, version int"


@dataclass(frozen=True)
class _Base:
    """What the newest manifest says: the last batch held, and the version of every bucket that holds rows."""

    upto: int
    buckets: int
    versions: Mapping[int, int]
    schema: T.StructType

    def read(self, spark: SparkSession, path: str, buckets: Iterable[int]) -> DataFrame | None:
        folders = [f"{path}/_base/version={self.versions[b]}/{_BUCKET}={b}" for b in buckets]
        if not folders:
            return None
        # Only the folders named are listed, each a whole bucket; their number is that of the buckets.
        schema = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        reader = spark.read.schema(schema).option("basePath", f"{path}/_base")
        return reader.parquet(*folders).select(*self.schema.names, _BUCKET)


def _listed(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet folder, or nothing where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _base(spark: SparkSession, path: str) -> _Base | None:
    """The base that ``compact`` published last.

    What counts is the manifest, one file of a row a bucket that is written when all files it names are
    whole: buckets that are still being written are in none.
    """
    manifest = _listed(spark, f"{path}/_manifest", _MANIFEST)
    if manifest is None:
        return None
    # Rows of one manifest come together or not at all; a table of manifests grows by ``buckets`` rows a run.
    newest = manifest.agg(F.max("upto")).first()[0]
    if newest is None:
        return None
    rows = manifest.where(F.col("upto") == newest).collect()
    versions = {r["bucket"]: r["version"] for r in rows if r["version"] is not None}
    if versions:
        any_bucket, version = next(iter(sorted(versions.items())))
        schema = spark.read.parquet(f"{path}/_base/version={version}/{_BUCKET}={any_bucket}").schema
    else:
        # Nothing was ever held, so some delta still says what rows look like.
        schema = spark.read.option("basePath", path).parquet(path).drop("batch").schema
    return _Base(newest, rows[0]["buckets"], versions, schema)


def _later(spark: SparkSession, path: str, held: _Base) -> DataFrame:
    """Deltas that the base doesn't hold. Those that it holds are pruned by their folder, and may be gone: the
    schema is the base's."""
    every = T.StructType([*held.schema.fields, T.StructField("batch", T.IntegerType())])
    deltas = spark.read.schema(every).option("basePath", path).parquet(path)
    return deltas.where(F.col("batch") > held.upto)


def _bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _reach(deltas: DataFrame, key: Sequence[str], buckets: int) -> tuple[int | None, set[int]]:
    """The last batch of the deltas and the buckets they touch, from their keys alone."""
    found = deltas.agg(F.max("batch").alias("newest"), F.collect_set(_bucket_of(key, buckets)).alias("touched")).first()
    return found["newest"], set(found["touched"])


def _merged(
    spark: SparkSession, path: str, held: _Base, later: DataFrame, key: Sequence[str], order: Sequence[str], touched: set[int]
) -> DataFrame:
    """Rows of the touched buckets after the deltas, with their bucket: one shuffle, by bucket."""
    rows = later.withColumn(_BUCKET, _bucket_of(key, held.buckets))
    old = held.read(spark, path, [b for b in sorted(touched) if b in held.versions])
    if old is not None:
        rows = rows.unionByName(old.withColumn("batch", F.lit(held.upto)))
    return last_write_wins(rows.repartition(_BUCKET), [_BUCKET, *key], [*order, "batch"]).drop("batch")


def compact(
    spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = (), buckets: int | None = None
) -> int:
    """Resolve all deltas so far into the base; returns the last batch it holds.

    The base lies in buckets by a hash of the key. Only buckets that newer deltas touch are read and
    written again, as a new version; the others keep their files, so the work follows the change and not the
    table. Run it between runs of the job. A base is published by one small manifest when all its files are
    written, and these never change; readers then skip the deltas it holds, which ``drop_deltas`` empties or
    you may delete, as you may versions of buckets that ``superseded`` names. Without newer deltas nothing is written.

    ``buckets`` is 64 at first and then stays: choose it so that a bucket fits a task, as one task
    writes one bucket. Another number than before writes the whole base anew.
    """
    held = _base(spark, path)
    if held is None:
        deltas = spark.read.schema("batch int").option("basePath", path).parquet(path)
        if deltas.agg(F.max("batch")).first()[0] is None:
            raise ValueError(f"{path} holds no delta")
        schema = spark.read.option("basePath", path).parquet(path).drop("batch").schema
        held = _Base(-1, buckets or BUCKETS, {}, schema)
    later = _later(spark, path, held)
    newest, touched = _reach(later, key, held.buckets)
    if newest is None:
        # Emptied deltas have no rows; the base is what it was.
        return held.upto
    versions = dict(held.versions)
    if buckets not in (None, held.buckets):
        whole = read_upserted(spark, path, key, order=order).withColumn(_BUCKET, _bucket_of(key, buckets))
        rows, touched, versions = whole.repartition(_BUCKET), set(range(buckets)), {}
    else:
        rows = _merged(spark, path, held, later, key, order, touched)
    rows.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{path}/_base/version={newest}")
    written = spark.read.schema(f"{_BUCKET} int").parquet(f"{path}/_base/version={newest}")
    versions |= {r[0]: newest for r in written.select(_BUCKET).distinct().collect()}  # a row a bucket
    count = buckets or held.buckets
    listing = [(newest, count, b, v) for b, v in sorted(versions.items())]
    spark.createDataFrame(listing, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return newest


def superseded(spark: SparkSession, path: str) -> list[str]:
    """Folders of bucket versions that earlier manifests named and the newest doesn't: no new reader looks at them."""
    manifest = _listed(spark, f"{path}/_manifest", _MANIFEST)
    if manifest is None:
        return []
    last = manifest.groupBy("bucket", "version").agg(F.max("upto").alias("last"))
    stale = last.where(F.col("last") < manifest.agg(F.max("upto")).first()[0])
    return sorted(f"{path}/_base/version={r['version']}/{_BUCKET}={r['bucket']}" for r in stale.collect())


def drop_deltas(spark: SparkSession, path: str) -> list[int]:
    """Empty the deltas that the published base holds; returns their batches. Readers never look at them again."""
    held = _base(spark, path)
    if held is None:
        return []
    every = T.StructType([*held.schema.fields, T.StructField("batch", T.IntegerType())])
    old = spark.read.schema(every).option("basePath", path).parquet(path).where(F.col("batch") <= held.upto)
    batches = sorted(row["batch"] for row in old.groupBy("batch").agg(F.count("*")).collect())  # one row a batch
    for batch in batches:
        spark.createDataFrame([], held.schema).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return batches


def stream_dedup(
    links: DataFrame, event_time: str, horizon: str, key: Sequence[str] = ("url",), spread_by: str | None = None, salts: int = 16
) -> DataFrame:
    """First arrival of each URL within the horizon; state is dropped behind the watermark.

    Arrivals shrink to one per URL and salt before they meet, so a hot URL is spread over tasks. The
    salt is a hash of ``spread_by``, a column that differs between arrivals of one URL, or else of all
    columns but the key.
    """
    marked = links.withWatermark(event_time, horizon)
    others = [c for c in links.columns if c not in key] if spread_by is None else [spread_by]
    if others:
        salted = marked.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
        marked = salted.dropDuplicatesWithinWatermark([*key, "__salt"]).drop("__salt")
    return marked.dropDuplicatesWithinWatermark(list(key))


def stream_metrics(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and success rate per window; rows behind the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(window).agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in ("started", "succeeded", "failed")]
    )
    ended = F.col("succeeded") + F.col("failed")
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "started", "succeeded", "failed",
        F.round(F.try_divide(F.col("succeeded"), ended), 4).alias("success_rate"),
    )


def worker_sessions(events: DataFrame, silence: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a worker: it is offline once silent for ``silence``."""
    sessions = events.withWatermark("ts", late).groupBy("worker", F.session_window("ts", silence).alias("s")).agg(
        F.count("*").alias("events")
    )
    return sessions.select("worker", F.col("s.start").alias("joined_at"), F.col("s.end").alias("left_at"), "events")



def stream_task_state(
    events: DataFrame, key: str = "id", silence: str | None = "90 days", late: str = "10 minutes"
) -> DataFrame:
    """Running task state, one updated row per task and batch.

    The state of a task goes once it was silent for ``silence`` (see ``expiring_task_state``), so the store is
    bounded by what was active. Without ``silence`` it stays for ever, no event is too late, and it is kept in mergeable aggregates: the newest state-setting event, the newest start, and the
    number of retries. A start after a retry or at the outset means processing.
    """
    if silence is not None:
        return expiring_task_state(events, key, silence, late)
    at = F.struct("ts", "seq")
    starts = F.col("type") == "start"
    sets = F.col("type").isin("complete", "fail", "retry")
    folded = events.groupBy(key).agg(
        F.max(F.when(sets, at)).alias("set_at"),
        F.max_by("type", F.when(sets, at)).alias("set_type"),
        F.max(F.when(starts, at)).alias("start_at"),
        F.count_if(F.col("type") == "retry").alias("retry_count"),
    )
    pending = F.col("set_type").isNull() | (F.col("set_type") == "retry")
    started = F.col("start_at").isNotNull() & (F.col("set_at").isNull() | (F.col("start_at") > F.col("set_at")))
    status = (
        F.when(pending & started, "processing")
        .when(pending, "pending")
        .when(F.col("set_type") == "complete", "completed")
        .otherwise("failed")
    )
    return folded.select(key, status.alias("status"), "retry_count")


def _last(stamps: np.ndarray, places: np.ndarray, kinds: np.ndarray, chosen: np.ndarray) -> tuple[int, int, str | None]:
    """Time, place and kind of the last chosen event; (-1, -1, None) where there is none."""
    found = np.flatnonzero(chosen)
    if not len(found):
        return -1, -1, None
    last = found[np.lexsort((places[found], stamps[found]))[-1]]
    return int(stamps[last]), int(places[last]), kinds[last]


def expiring_task_state(
    events: DataFrame, key: str = "id", silence: str = "90 days", late: str = "10 minutes"
) -> DataFrame:
    """Running task state that is dropped once a task was silent for ``silence``.

    Events later than ``late`` are dropped, and a task that speaks again after its state is gone starts
    anew, so the state holds only what was active within the time named. ``ts`` is a timestamp.
    """
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)
    fields = "set_us long, set_seq long, set_type string, start_us long, start_seq long, retries long"
    kind = events.schema[key].dataType.simpleString()

    def fold(
        keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        set_us, set_seq, set_type, start_us, start_seq, retries = state.get if state.exists else (-1, -1, None, -1, -1, 0)
        newest = 0
        for part in parts:
            stamps = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            places, kinds = part["seq"].to_numpy(), part["type"].to_numpy()
            newest = max(newest, int(stamps.max()))
            retries += int((kinds == "retry").sum())
            us, seq, _ = _last(stamps, places, kinds, kinds == "start")
            start_us, start_seq = max((start_us, start_seq), (us, seq))
            us, seq, what = _last(stamps, places, kinds, np.isin(kinds, ("complete", "fail", "retry")))
            if (us, seq) > (set_us, set_seq):
                set_us, set_seq, set_type = us, seq, what
        state.update((set_us, set_seq, set_type, start_us, start_seq, retries))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + wait)
        running = set_type in (None, "retry") and (start_us, start_seq) > (set_us, set_seq)
        idle = {"complete": "completed", "fail": "failed"}.get(set_type, "pending")
        yield pd.DataFrame({key: [keys[0]], "status": ["processing" if running else idle], "retry_count": [retries]})

    marked = events.where(F.col("type").isNotNull()).withWatermark("ts", late).select(key, "ts", F.col("seq").cast("long"), "type")
    output = f"`{key}` {kind}, status string, retry_count long"
    return marked.groupBy(key).applyInPandasWithState(fold, output, fields, "update", GroupStateTimeout.EventTimeTimeout)


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write updated rows of every batch as a delta, to be read by ``read_upserted``."""
    writer = updates.writeStream.outputMode("update").foreachBatch(_write_delta(path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_join(
    tasks: DataFrame, signals: DataFrame, late: str = "10 minutes", valid: str = "1 hour", salts: int = 8
) -> DataFrame:
    """Arriving tasks matched with signals of their region from the hour before.

    Both sides carry watermarks and the time bound, so expired signals leave the state. Tasks
    of one region spread over ``salts`` partitions; signals, the short side, are repeated.
    Tasks: id, county, ts. Signals: region, signal_ts, signal_strength.
    """
    left = tasks.withWatermark("ts", late).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    right = signals.withWatermark("signal_ts", late).withColumn("__copy", copies)
    recent = (F.col("signal_ts") <= F.col("ts")) & (F.col("signal_ts") > F.col("ts") - F.expr(f"INTERVAL {valid}"))
    same = (F.col("county") == F.col("region")) & (F.col("__salt") == F.col("__copy"))
    return left.join(right, same & recent).drop("__salt", "__copy")


def event_time(column: str) -> Column:
    return F.col(column).cast("timestamp")
