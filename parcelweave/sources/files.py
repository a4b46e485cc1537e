"""Readers for bulk drops: CSV, JSON lines, JSON arrays and GeoJSON."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.sources import streams
from parcelweave.sources.documents import split_document

OVERFLOW = "__overflow"
BAD_LINE = "__bad_line"


def _header(spark: SparkSession, path: str | Sequence[str], **options: str) -> list[str]:
    """Column names of the first line; reads one row, not the data."""
    return spark.read.options(**{**options, "header": "true", "inferSchema": "false"}).csv(path).columns


def _headers(spark: SparkSession, path: str | Sequence[str], delimiter: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header, grouped before the driver sees them; it gets each header once, and paths as a listing does.

    Tasks read the first bytes of each file. On file systems they can't open, Spark reads the first block of every file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if all(streams.can_stream(p) for p in paths):
        listed = spark.read.format("binaryFile").load(paths)
        first = streams.headers(listed, delimiter)
    else:
        lines = spark.read.text(paths).where("_metadata.file_block_start = 0").select(
            F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at")
        )
        first = lines.groupBy("path").agg(F.min_by("value", "at").alias("line"))
        names = F.transform(F.split(F.ltrim("line", F.lit("\ufeff")), re.escape(delimiter)), lambda n: F.trim(n, F.lit('"')))
        first = first.select("path", names.alias("names"))
    grouped = first.groupBy("names").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return {tuple(row["names"]): row["files"] for row in grouped.collect()}


def read_csv_source(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str = ",",
    encoding: str = "UTF-8",
    columns: Sequence[str] | None = None,
    multiline: bool = False,
    with_overflow: bool = False,
    by_name: bool = False,
) -> DataFrame:
    """Rows of a CSV with header, every value text; short rows get nulls.

    All files must have one header, or reading fails. ``by_name`` admits files whose columns differ in
    order or are missing: it reads the first bytes of all files (UTF-8 only) and then every file by its own.
    Give ``columns`` to skip the look at the header. ``multiline`` admits line breaks inside
    quotes, at the price of one task per file. ``with_overflow`` adds a column that is not
    null when a row is wider than the header.
    """
    options = {"sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": str(multiline).lower()}
    options |= {"header": "true", "mode": "PERMISSIVE"}

    def read(names: Sequence[str], files: str | Sequence[str], check: bool) -> DataFrame:
        extra = [OVERFLOW] if with_overflow else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])
        return spark.read.options(enforceSchema=str(not check).lower(), **options).schema(schema).csv(files)

    if not by_name and not with_overflow:
        return read(columns if columns is not None else _header(spark, path, **options), path, check=True)
    groups = _headers(spark, path, delimiter)
    if not groups:
        return read(columns or [], path, check=False)
    wanted = list(columns) if columns is not None else list(max(groups, key=lambda names: len(names)))
    if not by_name and set(groups) != {tuple(wanted)}:
        raise ValueError(f"files differ in their headers: {sorted(groups)}; read them by name")
    whole = None
    for names, files in groups.items():
        rows = read(names, files, check=False)
        picked = [F.col(f"`{n}`") if n in names else F.lit(None).cast("string").alias(n) for n in wanted]
        rows = rows.select(*picked, *([OVERFLOW] if with_overflow else []))
        whole = rows if whole is None else whole.unionAll(rows)
    return whole


def csv_profile(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """One row: columns, rows, rows wider than the header, and whether the file is valid."""
    rows = read_csv_source(spark, path, with_overflow=True, **options)
    width = len(rows.columns) - 1
    counted = rows.agg(F.count("*").alias("rows"), F.count(F.col(OVERFLOW)).alias("wide_rows"))
    return counted.select(
        F.lit(width).cast("bigint").alias("columns"),
        "rows",
        "wide_rows",
        ((F.lit(width) > 0) & (F.col("rows") > 0) & (F.col("wide_rows") == 0)).alias("is_valid"),
    )


def read_json_source(
    spark: SparkSession,
    path: str | Sequence[str],
    form: str = "lines",
    schema: T.StructType | str | None = None,
    flatten: bool = False,
) -> DataFrame:
    """JSON objects as rows.

    ``lines`` skips blank and malformed lines (``split_json_lines`` keeps them) and splits large files. ``array``
    first cuts its documents into lines by many tasks (``split_document``, which runs jobs when called). ``object``
    parses a whole file in one task. Without a schema Spark makes one more pass to infer it.
    """
    if form not in {"lines", "array", "object"}:
        raise ValueError(f"unknown JSON form: {form}")
    if form == "array":
        path, form = split_document(spark, path), "lines"
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", form != "lines")
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.json(path)
    return flatten_json(rows) if flatten else rows


def split_json_lines(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, flatten: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are none: (file, line).

    Blank lines are neither. The rejects can be counted, written to quarantine, or named in a report.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*fields.fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = lines.withColumn("row", F.from_json("value", marked, {"columnNameOfCorruptRecord": BAD_LINE}))
    bad = F.col("row").isNull() | F.col(f"row.{BAD_LINE}").isNotNull()
    rows = parsed.where(~bad).select("row.*").drop(BAD_LINE)
    return (flatten_json(rows) if flatten else rows), parsed.where(bad).select("file", F.col("value").alias("line"))


def flatten_json(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested objects as columns named by their path; arrays stay as they are."""

    def leaves(kind: T.StructType, path: list[str]) -> list[Column]:
        found = []
        for field in kind.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType) and field.dataType.fields:
                found += leaves(field.dataType, here)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return found

    return df.select(*leaves(df.schema, []))


def read_geojson(
    spark: SparkSession, path: str | Sequence[str], properties: T.StructType | str, lines: bool = False
) -> DataFrame:
    """Features as rows: properties, then feature_id, longitude and latitude.

    A file holds one collection, whose features are first cut into lines by many tasks (``split_document``, which runs
    jobs when called); with ``lines`` every line holds one.

    Only points have coordinates. An id of 0 or an empty one counts as none. Coordinates of
    other shapes differ in depth, so they are read as text and parsed for points alone.
    """
    fields = T.StructType.fromDDL(properties) if isinstance(properties, str) else properties
    geometry = "struct<type:string,coordinates:string>"
    feature = f"struct<id:string,geometry:{geometry},properties:{fields.simpleString()}>"
    if lines:
        collections = spark.read.schema(f"type string, features array<{feature}>").json(path)
        rows = collections.select(F.explode("features").alias("f"))
    else:
        found = spark.read.option("mode", "DROPMALFORMED").schema(T.StructType.fromDDL(feature[7:-1]))
        rows = found.json(split_document(spark, path, "features")).select(F.struct("*").alias("f"))
    is_point = F.coalesce(F.col("f.geometry.type") == "Point", F.lit(False))
    point = F.when(is_point, F.from_json("f.geometry.coordinates", "array<double>"))
    return rows.select(
        "f.properties.*",
        F.when(~F.col("f.id").isin("", "0"), F.col("f.id")).alias("feature_id"),
        F.get(point, F.lit(0)).alias("longitude"),
        F.get(point, F.lit(1)).alias("latitude"),
    )


# Reader by file extension.
ROUTES = {".csv": "csv", ".json": "array", ".jsonl": "lines", ".ndjson": "lines", ".geojson": "geojson"}


def route_by_extension(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in ROUTES:
        raise ValueError(f"no reader for {suffix or 'files without extension'}: {path}")
    return ROUTES[suffix]


def read_source(spark: SparkSession, path: str, properties: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a drop with the reader its extension calls for."""
    kind = route_by_extension(path)
    if kind == "csv":
        return read_csv_source(spark, path, **options)
    if kind == "geojson":
        if properties is None:
            raise ValueError("GeoJSON needs the schema of its properties")
        return read_geojson(spark, path, properties)
    return read_json_source(spark, path, kind, **options)


def source_row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != OVERFLOW]


def _files(spark: SparkSession, directory: str, pattern: str, recursive: bool):
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(directory)


def list_source_files(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Path, size and modification time of files; contents are not read."""
    return _files(spark, directory, pattern, recursive).select("path", "length", "modificationTime")


def file_hashes(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Content hash per file (SHA-256), read piece by piece inside tasks, whatever the file's size.

    On file systems that tasks can't open, a file is one row in memory and must be below 2 GB.
    """
    files = _files(spark, directory, pattern, recursive)
    if streams.can_stream(directory):
        return streams.digests(files)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "length")


def new_files(hashes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content was not ingested before; of equal files in one listing, one."""
    first = hashes.groupBy("file_hash").agg(F.min_by(F.struct("path", "length"), "path").alias("f"))
    unseen = first.join(ledger.select("file_hash"), ["file_hash"], "left_anti")
    return unseen.select("f.path", "file_hash", "f.length")


def seed_load(spark: SparkSession, path: str, platform: str, **options) -> DataFrame:
    """Seed rows (url, platform, priority) from a CSV or JSON file."""
    rows = read_source(spark, path, **options)
    own = F.col("platform").cast("string") if "platform" in rows.columns else F.lit(None).cast("string")
    priority = F.col("priority").try_cast("int") if "priority" in rows.columns else F.lit(None).cast("int")
    return rows.where(F.col("url") != "").select(
        "url", F.coalesce(own, F.lit(platform)).alias("platform"), F.coalesce(priority, F.lit(0)).alias("priority")
    )
