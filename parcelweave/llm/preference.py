"""Preference formatting: one prompt, two masked completions.

Chosen and rejected conversations are compared turn by turn; the longest common prefix is rendered
once as the prompt, what follows it as the two completions. A loss mask says which characters of a
completion are learnt: the bodies and closings of assistant turns, not their headers and not what
others say.

One training example is one row by definition, so ``format_preferences`` gathers each conversation once, as an array
of its turns, and compares, renders and masks arrays inside the row: texts are shuffled once for that. ``segments``
and ``examples`` are the same in rows of turns, for those who want these: there the comparison is a join by pair and
position with one aggregate, and no conversation is gathered for it. Both count characters, and give equal examples.

A null role or text renders as empty, and two nulls are equal. Turns are ordered by their number;
of turns that share a number and a side, the first by role and text counts, so repeated rows are
taken once. A pair with one side only has an empty prompt and a null completion for the other
side. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("chosen", "rejected")


def turns_of(turns: DataFrame, pair_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with the columns this module works on: ``pair``, ``turn``, ``role``, ``text``; each number once."""
    said = F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.filter(F.col(pair_col).isNotNull() & F.col(turn_col).isNotNull())
    once = rows.groupBy(F.col(pair_col).alias("pair"), F.col(turn_col).cast("long").alias("turn")).agg(F.min(said).alias("said"))
    return once.select("pair", "turn", "said.role", "said.text")


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def segments(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row a rendered turn: ``pair``, ``part`` (prompt, chosen, rejected), ``position``, ``role``, ``head``, ``body``, ``trained``.

    Both inputs have ``pair``, ``turn``, ``role``, ``text`` (see ``turns_of``). ``position`` counts the
    turns of a conversation from 0. Prompt turns come once, from the chosen side.
    """
    place = Window.partitionBy("pair").orderBy("turn")
    sides = [
        turns.withColumn("position", F.row_number().over(place) - 1).withColumn("side", F.lit(side))
        for side, turns in zip(SIDES, (chosen, rejected))
    ]
    a, b = (s.select("pair", "position", F.struct("role", "text").alias(side)) for s, side in zip(sides, SIDES))
    met = a.join(b, ["pair", "position"], "full")
    same = F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))
    # The first place where they differ, or the number of places.
    common = met.groupBy("pair").agg(
        F.coalesce(F.min(F.when(~same, F.col("position"))), F.count("*").cast("int")).alias("common")
    )
    every = sides[0].unionByName(sides[1]).join(common, "pair")
    in_prompt = F.col("position") < F.col("common")
    return every.filter(~in_prompt | (F.col("side") == "chosen")).select(
        "pair",
        F.when(in_prompt, "prompt").otherwise(F.col("side")).alias("part"),
        "position",
        "role",
        header(F.col("role")).alias("head"),
        F.concat("text", F.lit("<|end|>\n")).alias("body"),
        (~in_prompt & (F.col("role") == trained_role)).alias("trained"),
    )


def examples(rendered: DataFrame) -> DataFrame:
    """One row a pair: ``prompt``, ``chosen``, ``rejected`` and the learnt character ranges of both.

    ``chosen_mask`` and ``rejected_mask`` are arrays of ``begin`` and ``end`` (exclusive) within the
    completion; ``prompt_turns`` is the number of common turns.
    """
    within = Window.partitionBy("pair", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn(
        "at", F.coalesce(F.sum(F.length("head") + F.length("body")).over(within), F.lit(0)).cast("int")
    )
    begin = F.col("at") + F.length("head")
    placed = placed.withColumn(
        "range", F.when(F.col("trained"), F.struct(begin.alias("begin"), (begin + F.length("body")).alias("end")))
    ).withColumn("string", F.concat("head", "body"))

    def joined(part: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("position", "string"))))
        return F.concat_ws("", F.transform(own, lambda s: s["string"])).alias(part)

    def ranges(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("range")))).alias(f"{part}_mask")

    gathered = placed.groupBy("pair").agg(
        joined("prompt"),
        F.count(F.when(F.col("part") == "prompt", 1)).alias("prompt_turns"),
        *[f(side) for side in SIDES for f in (joined, ranges)],
        *[F.max(F.when(F.col("part").isin("prompt", side), 1)).alias(f"has_{side}") for side in SIDES],
    )
    kept = [F.when(F.col(f"has_{side}") == 1, F.col(side)).alias(side) for side in SIDES]
    return gathered.select("pair", "prompt_turns", "prompt", *kept, *[f"{side}_mask" for side in SIDES])


def gathered(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``pair`` and ``said``, its turns (turn, role, text) in order."""
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("pair").agg(said.alias("said"))


def paired_examples(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """As ``examples``, from ``pair`` and the arrays ``chosen`` and ``rejected`` (see ``gathered``), null where a side is absent.

    Work is linear in the turns but for the ranges of a mask, which are copied once for each range added.
    """
    nothing = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    sides = {side: F.coalesce(F.col(side), nothing) for side in SIDES}
    same = F.zip_with(
        *sides.values(), lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    differs = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(differs > 0, differs - 1).otherwise(F.size(same)).alias("common")
    measured = pairs.select("pair", *SIDES, common)

    def body(turn: Column) -> Column:
        return F.concat(turn["text"], F.lit("<|end|>\n"))

    def rendered(turns: Column) -> Column:
        return F.concat_ws("", F.transform(turns, lambda t: F.concat(header(t["role"]), body(t))))

    def mask(turns: Column) -> Column:
        def step(seen: Column, turn: Column) -> Column:
            begin = seen["at"] + F.length(header(turn["role"]))
            end = begin + F.length(body(turn))
            own = F.array(F.struct(begin.alias("begin"), end.alias("end")))
            ranges = F.when(turn["role"] == trained_role, F.concat(seen["ranges"], own)).otherwise(seen["ranges"])
            return F.struct(end.alias("at"), ranges.alias("ranges"))

        none = F.array().cast("array<struct<begin:int,end:int>>")
        return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("ranges")), step, lambda seen: seen["ranges"])

    def completion(side: str) -> Column:
        turns = F.coalesce(F.col(side), nothing)
        return F.slice(turns, F.col("common") + 1, F.greatest(F.size(turns), F.lit(1)))

    prompt = F.slice(F.coalesce(F.col("chosen"), nothing), F.lit(1), F.col("common"))
    return measured.select(
        "pair",
        F.col("common").cast("long").alias("prompt_turns"),
        rendered(prompt).alias("prompt"),
        *[F.when(F.col(side).isNotNull(), rendered(completion(side))).alias(side) for side in SIDES],
        *[mask(completion(side)).alias(f"{side}_mask") for side in SIDES],
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One example a pair from the turns of both sides (see ``turns_of``)."""
    a, b = (gathered(turns).withColumnRenamed("said", side) for side, turns in zip(SIDES, (chosen, rejected)))
    return paired_examples(a.join(b, "pair", "full"), trained_role)


def swapped_pairs(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """``swapped_answers`` for gathered conversations: ``pair``, ``chosen`` as given, and ``rejected``.

    Only last answers travel, to the conversation whose id differs in the lowest bit.
    """
    known = conversations.withColumn("last", F.try_element_at(F.filter("said", lambda t: t["role"] == role), F.lit(-1)))
    # Behind a generator the key adds no filter below the gathering, so that one gathering serves both sides.
    neighbour = F.explode(F.array(F.col("pair").bitwiseXOR(F.lit(1).cast("long"))))
    other = known.filter(F.col("last").isNotNull()).select(neighbour.alias("pair"), F.col("last.text").alias("other"))
    upto = F.filter("said", lambda t: t["turn"] <= F.col("last.turn"))
    swapped = F.transform(
        upto,
        lambda t: F.struct(
            t["turn"].alias("turn"),
            t["role"].alias("role"),
            F.when(t["turn"] == F.col("last.turn"), F.col("other")).otherwise(t["text"]).alias("text"),
        ),
    )
    met = known.join(other, "pair", "left")
    rejected = F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), swapped)
    return met.select("pair", F.col("said").alias("chosen"), rejected.alias("rejected"))


def swapped_answers(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Rejected conversations for given ones: the last answer is replaced by another conversation's.

    ``turns`` has ``pair``, ``turn``, ``role``, ``text``, and ``pair`` is an integer. The other answer is
    the last one of the conversation whose id differs in the lowest bit; conversations without such
    a neighbour, or without an answer, have no rejected side.
    """
    answered = turns.filter(F.col("role") == role)
    last = answered.groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("last"))
    swap = last.select("pair", F.col("last.turn").alias("at")).join(
        last.select(F.col("pair").bitwiseXOR(F.lit(1).cast("long")).alias("pair"), F.col("last.text").alias("other")), "pair"
    )
    own = turns.join(swap, "pair").filter(F.col("turn") <= F.col("at"))
    return own.select("pair", "turn", "role", F.when(F.col("turn") == F.col("at"), F.col("other")).otherwise(F.col("text")).alias("text"))
