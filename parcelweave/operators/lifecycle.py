"""Snapshots, retention, and notification payloads."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.functions.signing import sign
from parcelweave.operators.frontier import cancel_tasks, enqueue, new_tasks
from parcelweave.operators.ranking import top_per_group
from parcelweave.operators.selectors import bound
from parcelweave.operators.upsert import last_write_wins

# Ages in days from which raw files are compressed and archived.
COMPRESS_DAYS, ARCHIVE_DAYS = 30, 365
# Days screenshots and results are kept, and checkpoints kept per task.
KEEP_DAYS = {"screenshot": 7, "result": 30}
KEEP_CHECKPOINTS = 5


def latest_snapshot(snapshots: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return last_write_wins(snapshots, key, order)


def retention_class(saved_at: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, saved_at)
    return F.when(age >= ARCHIVE_DAYS, "archive").when(age >= COMPRESS_DAYS, "compress").otherwise("keep")


def expire_by_age(df: DataFrame, saved_at: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.timestamp_diff("SECOND", F.col(saved_at), as_of) <= days * 86400)


def keep_newest(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = KEEP_CHECKPOINTS) -> DataFrame:
    return top_per_group(df, key, order, n)


def keep_last_failure(outcomes: DataFrame, key: str = "parcel_id") -> DataFrame:
    """The newest failed page per parcel, unless a later success removed it.

    ``outcomes`` holds (key, ts, seq, ok). One aggregate answers both questions.
    """
    at = F.struct("ts", "seq")
    newest = outcomes.groupBy(key).agg(
        F.max(F.when(~F.col("ok"), at)).alias("failed"), F.max(F.when(F.col("ok"), at)).alias("passed")
    )
    stands = F.col("failed").isNotNull() & (F.col("passed").isNull() | (F.col("failed") > F.col("passed")))
    return newest.where(stands).select(key, F.col("failed.ts").alias("ts"), F.col("failed.seq").alias("seq"))


def plain_number(value: Column) -> Column:
    """A double in the fewest digits that stand for it, as receivers write it: ``12500000.0``, ``1e-05``, ``1e+16``.

    Fixed point from 0.0001 up to below 1e16. Infinities and what is no number are ``Infinity``, ``-Infinity`` and ``NaN``.
    """

    def shortest(v: Column) -> Column:
        # The virtual machine's own text may have a digit or two too many, for the tiniest doubles more.
        every = [F.lit(f"%.{digits}e") for digits in range(17)]
        forms = F.when(F.abs(v) < 2.3e-308, F.array(*every)).otherwise(F.array(*every[14:]))
        written = F.transform(forms, lambda form: F.call_function("format_string", form, v))
        return bound(written, lambda texts: F.coalesce(F.get(F.filter(texts, lambda t: t.try_cast("double") == v), F.lit(0)), F.element_at(texts, -1)))

    def text(scientific: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(scientific, "e", 1), "[-.]", ""), "(?<=.)0+$", "")
        power = F.substring_index(scientific, "e", -1).cast("int")
        sign = F.when(scientific.startswith("-"), "-").otherwise("")
        return bound(F.struct(sign.alias("sign"), digits.alias("digits"), power.alias("power")), laid_out)

    def laid_out(number: Column) -> Column:
        digits, power = number["digits"], number["power"]
        rest = F.substring(digits, F.lit(2), F.length(digits))
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."))
        behind = F.substring(digits, power + 2, F.length(digits))
        fixed = F.concat(whole, F.when(behind == "", "0").otherwise(behind))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        mantissa = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
        scientific = F.concat(mantissa, exponent)
        form = F.when((power < -4) | (power >= 16), scientific).when(power < 0, small).otherwise(fixed)
        return F.concat(number["sign"], form)

    def told(v: Column) -> Column:
        def from_own(own: Column) -> Column:
            # No two numbers of fifteen digits are the same double but for the tiniest, so texts of so few need no search.
            few = (F.length(F.regexp_replace(F.substring_index(own, "E", 1), "[-.]", "")) <= 15) & ((F.abs(v) >= 2.3e-308) | (v == 0))
            searched = F.when(few, F.replace(own, F.lit("E"), F.lit("e"))).otherwise(shortest(v))
            odd = F.when(own.isin("NaN", "Infinity", "-Infinity"), own)
            return F.coalesce(odd, F.when(~own.contains("E") & (few | (F.length(own) <= 16)), own).otherwise(bound(searched, text)))

        return bound(v.cast("string"), from_own)

    return F.when(value.isNotNull(), bound(value, told))


def canonical(value: Column, kind: T.DataType, mark: str) -> Column:
    """The value with struct fields and map entries in the order of their names, and fractions as marked text, at every depth.

    Receivers know no other fractions than doubles, so floats and decimals are written as the double they read.
    """
    if isinstance(kind, T.DoubleType | T.FloatType) or (isinstance(kind, T.DecimalType) and kind.scale > 0):
        read = value if isinstance(kind, T.DoubleType) else value.cast("string").cast("double")
        return F.concat(F.lit(mark), plain_number(read), F.lit(mark))
    if isinstance(kind, T.StructType):
        fields = [canonical(value[f.name], f.dataType, mark).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: canonical(v, kind.elementType, mark))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: canonical(value[k], kind.valueType, mark)))
    return value


def ascii_json(text: Column) -> Column:
    """JSON text with everything outside printable ASCII as lower-case escapes, in UTF-16 units."""

    def escape(unit: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        above = code - 0x10000
        pair = F.concat(escape(F.shiftright(above, 10) + 0xD800), escape(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code > 0xFFFF, pair).otherwise(escape(code))

    def lowered(written: Column) -> Column:
        # The writer's own escapes of control characters have capitals.
        lower = written
        for control in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{control:04X}", rf"$1\\u{control:04x}")
        return F.when(written.contains("\\u00"), lower).otherwise(written)

    def ascii_only(written: Column) -> Column:
        # Few different characters need an escape: each is replaced throughout.
        strange = F.array_distinct(F.regexp_extract_all(written, F.lit("[^ -~]"), F.lit(0)))
        return F.aggregate(strange, written, lambda done, char: F.replace(done, char, escaped(char)))

    # Bound, as both refer to their text several times and writing it is the dear part.
    return bound(bound(text, lowered), ascii_only)


def json_object(members: dict[str, Column], kinds: Mapping[str, T.DataType] | None = None) -> Column:
    """Compact JSON text as a receiver rebuilds it: sorted members at every depth, explicit nulls, ASCII only.

    ``kinds`` gives the types of members; without it only the outermost order is set, and fractions are
    written as Spark writes them.
    """
    kinds = kinds or {}
    # Numbers pass the JSON writer as strings between marks that no text can hold by chance.
    mark = f"number-{uuid.uuid4().hex}-"
    fields = [(canonical(members[n], kinds[n], mark) if n in kinds else members[n]).alias(n) for n in sorted(members)]
    written = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return ascii_json(F.replace(F.replace(written, F.lit(f'"{mark}'), F.lit("")), F.lit(f'{mark}"'), F.lit("")))


def notification_outbox(ended: DataFrame, secret: str | Column | None = None) -> DataFrame:
    """A payload per ended task or job, and its signature when a key is given.

    Reads event, task_id, job_id, platform, timestamp (ISO text), result, raw_paths, stats and
    error; columns that are missing become nulls.
    """
    names = ("event", "task_id", "job_id", "platform", "timestamp", "result", "raw_paths", "stats", "error")
    members = {n: F.col(n) if n in ended.columns else F.lit(None).cast("string") for n in names}
    keys = [c for c in ("task_id", "job_id") if c in ended.columns]
    kinds = {n: ended.schema[n].dataType for n in names if n in ended.columns}
    out = ended.select(*keys, "event", json_object(members, kinds).alias("payload"))
    return out if secret is None else out.withColumn("signature", sign(F.col("payload"), secret))


def apply_inbound_events(tasks: DataFrame, events: DataFrame, received_at: Column, default_platform: str) -> DataFrame:
    """Tasks after inbound events: task.create adds, task.cancel drops what is still pending.

    Events hold (event, task_id, url, platform, priority). A create without a URL is refused.
    Repeats of a create collapse on their URL and leave known tasks alone.
    """
    creates = events.where((F.col("event") == "task.create") & (F.col("url") != ""))
    wanted = creates.groupBy("url").agg(
        F.coalesce(F.min("platform"), F.lit(default_platform)).alias("platform"),
        F.coalesce(F.max("priority"), F.lit(0)).alias("priority"),
    )
    added = new_tasks(wanted, received_at, F.col("priority")).join(tasks.select("id"), ["id"], "left_anti")
    cancelled = events.where(F.col("event") == "task.cancel").select(F.col("task_id").alias("id"))
    return cancel_tasks(enqueue(tasks, added), cancelled)
