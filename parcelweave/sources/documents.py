"""Large single JSON documents, cut into lines by many tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelweave.session import fresh_dir

BLOCK, PLACE = ["file", "block"], ["file", "block", "at"]


def _outside(pieces: Column, first: int) -> Column:
    """Every other piece between quotes, joined."""
    return F.array_join(F.filter(pieces, lambda _, i: i % 2 == first), "")


def _rise(text: Column) -> Column:
    """By how much brackets deepen the nesting; a fragment holds no closing brace but its last."""
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    return (opened - F.length(text) + F.length(F.translate(text, "]", ""))).cast("bigint")


def _pieces(text: Column) -> Column:
    """Text between quotes that are not escaped."""
    return F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"')


def _whole_size() -> Column:
    """Bytes of the file; of a compressed one the text has another size, so none."""
    packed = F.lower(F.col("_metadata.file_name")).rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$")
    return F.when(~packed, F.col("_metadata.file_size"))


def _fragments(spark: SparkSession, path: str | Sequence[str], opening: str | None) -> DataFrame:
    """Text up to each closing brace, with what it does to quotes and depth, begun inside a string or not.

    Spark cuts files at any byte and reads on to the next brace, so ``file``, ``block`` and ``at`` order the
    fragments. Written out, as a second listing may cut the files elsewhere.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", _whole_size().alias("size"),
    )
    cut = read.withColumn("pieces", _pieces(F.col("value"))).withColumns(
        {"plain": _outside(F.col("pieces"), 0), "other": _outside(F.col("pieces"), 1)}
    )
    quotes = F.size("pieces") - 1
    marks = {
        "quotes": quotes,
        "bytes": F.octet_length("value") + 1,
        "size": F.col("size"),
        # The brace that ends a fragment counts where the fragment ends outside strings.
        "rise_out": _rise(F.col("plain")) - F.when(quotes % 2 == 0, 1).otherwise(0),
        "rise_in": _rise(F.col("other")) - F.when(quotes % 2 == 1, 1).otherwise(0),
        "lead": F.substring(F.regexp_replace("value", r"^[\s\x{FEFF}]+", ""), 1, 1),
        "shuts": F.col("plain").rlike(r"^[^\[\]{]*+\]"),
    }
    if opening is not None:
        before = F.split("value", opening, 2)
        head = _pieces(before[0])
        marks |= {
            "opens": F.size(before) == 2,
            "open_quotes": F.size(head) - 1,
            "open_rise": _rise(_outside(head, 0)),
            "empty": F.coalesce(F.get(before, F.lit(1)).rlike(r"^\s*\]"), F.lit(False)),
        }
    at = fresh_dir(spark, "json-fragments")
    cut.select(*PLACE, "value", *[v.alias(k) for k, v in marks.items()]).write.parquet(at)
    return spark.read.parquet(at)


def _with_states(fragments: DataFrame) -> DataFrame:
    """Fragments with the state they begin (``inside`` a string, ``depth``) and end in.

    Blocks are summarised under both beginnings, the summaries composed along each file (a row a block), and
    what a block begins in is handed to its fragments, which stay where the summary put them.
    """
    upto = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    odd = (F.sum("quotes").over(upto) - F.col("quotes")) % 2
    running = fragments.withColumn("odd", odd).withColumns({
        "to_out": F.sum(F.when(F.col("odd") == 0, F.col("rise_out")).otherwise(F.col("rise_in"))).over(upto),
        "to_in": F.sum(F.when(F.col("odd") == 0, F.col("rise_in")).otherwise(F.col("rise_out"))).over(upto),
    })
    blocks = running.groupBy(*BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.max_by("to_out", "at").alias("to_out"), F.max_by("to_in", "at").alias("to_in")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("odd_block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    gained = F.when(F.col("odd_block") == 0, F.col("to_out")).otherwise(F.col("to_in"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum(gained).over(earlier), F.lit(0)))
    known = running.join(blocks.select(*BLOCK, "odd_block", "base"), BLOCK)
    inside = (F.col("odd") + F.col("odd_block")) % 2 == 1
    after = F.col("base") + F.when(F.col("odd_block") == 0, F.col("to_out")).otherwise(F.col("to_in"))
    step = F.when(inside, F.col("rise_in")).otherwise(F.col("rise_out"))
    ends_inside = (F.col("odd") + F.col("odd_block") + F.col("quotes")) % 2 == 1
    return known.select(
        *fragments.columns, inside.alias("inside"), (after - step).alias("depth"),
        ends_inside.alias("ends_inside"), after.alias("after"),
    )


def _sewn(order: str, text: str, between: str) -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda f: f[text]), between)


def split_document(spark: SparkSession, path: str | Sequence[str], member: str | None = None) -> str:
    """Folder of JSON lines: the objects of the array each file holds, or of the array under ``member``.

    Files are cut wherever Spark's splits fall, so one of any size spreads over the cluster; a task holds
    objects, never a document. Without ``member`` a file whose root is an object gives that object. Scalars
    among the elements give no line, arrays among them raise. Empty files, and files without the member, give
    nothing; of a file cut short the whole objects are kept. The files are UTF-8. Runs jobs when called;
    fragments and lines stay in the shared folder.
    """
    opening = None if member is None else rf'"{re.escape(member)}"\s*:\s*\['
    fragments = _fragments(spark, path, opening)
    here = F.struct("block", "at")
    if member is None:
        roots = fragments.groupBy("file").agg(F.min(here).alias("begin"), F.min_by("lead", here).alias("root"))
        level = F.when(F.col("root") == "[", 1).otherwise(0)
        bounds = roots.select("file", "begin", F.lit(None).cast("struct<block:bigint,at:bigint>").alias("end"), level.alias("level"))
    else:
        states = _with_states(fragments.drop("value"))
        opens = (
            F.col("opens") & ((F.col("inside").cast("int") + F.col("open_quotes")) % 2 == 0)
            & (F.col("depth") + F.col("open_rise") == 1)
        )
        # Only fragments that open the member, or may shut an array of its depth, are looked at.
        marks = states.select(
            "file", here.alias("here"), opens.alias("opens"), "empty",
            (F.col("shuts") & ~F.col("inside") & (F.col("depth") == 2)).alias("shuts"),
        ).where("opens or shuts")
        first = marks.where("opens").groupBy("file").agg(F.min(F.struct("here", "empty")).alias("first"))
        first = first.where("not first.empty").select("file", F.col("first.here").alias("begin"))
        shut = marks.where("shuts").join(first, "file").where("here > begin").groupBy("file").agg(F.min("here").alias("end"))
        bounds = first.join(shut, "file", "left").select("file", "begin", "end", F.lit(2).alias("level"))
    states = _with_states(fragments.select(*PLACE, "value", "quotes", "rise_out", "rise_in")).join(bounds, "file")
    # What follows the last brace of a file ends without one; the bytes tell.
    last = F.when(F.sum("bytes") > F.max("size"), F.max(here))
    states = states.join(fragments.groupBy("file").agg(last.alias("torn")), "file")
    states = states.where((here >= F.col("begin")) & (F.col("end").isNull() | (here < F.col("end"))))
    start = r"^[\s\x{FEFF}]*+\[" if opening is None else rf"(?s)^.*?{opening}"
    value = F.when(here == F.col("begin"), F.regexp_replace("value", start, "")).otherwise(F.col("value"))
    closes = ~F.col("ends_inside") & (F.col("after") == F.col("level")) & ~here.eqNullSafe(F.col("torn"))
    ends = closes.cast("int")
    upto = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = states.withColumns({"value": value, "ends": ends}).withColumn("no", F.sum("ends").over(upto) - F.col("ends"))
    # An object inside one block is whole at once; what is left at a block's two ends meets its neighbours.
    parts = numbered.groupBy(*BLOCK, "no").agg(_sewn("at", "value", "}").alias("text"), F.max("ends").alias("closed"))
    whole = parts.where("no > 0 and closed = 1").select("text")
    blocks = numbered.groupBy(*BLOCK).agg(F.max("ends").alias("any"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("seam", F.sum("any").over(along))
    # A head closes what earlier blocks left open, a tail is open to later ones.
    seam = F.when((F.col("any") == 1) & (F.col("no") == 0), F.col("seam") - 1).otherwise(F.col("seam"))
    loose = parts.where("no = 0 or closed = 0").join(blocks, BLOCK).withColumn("seam", seam)
    met = loose.withColumn("place", F.struct("block", "no")).groupBy("file", "seam").agg(
        _sewn("place", "text", "}").alias("text"), F.max("closed").alias("closed")
    )
    objects = whole.unionAll(met.where("closed = 1").select("text"))
    # Blanks, commas, scalars and strings in front of the object go; raw line ends are never inside strings.
    text = F.regexp_replace("text", r'^[^\[\]{"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^\[\]{"]*+)*+', "")
    line = F.concat(F.translate(text, "\r\n", "  "), F.lit("}"))
    refused = F.raise_error(
        F.concat(F.lit("an element of the array is an array itself, read the file as one document: "), F.left(line, F.lit(80)))
    ).cast("string")
    out = fresh_dir(spark, "json-lines")
    objects.select(F.when(line.startswith("{"), line).otherwise(refused).alias("value")).write.text(out)
    return out
