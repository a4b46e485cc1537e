"""Scalar clean-up transforms as Column builders.

Every builder takes ``(value, config)`` and returns a Column, so a mapping of any width
compiles to one projection. Missing values stay null throughout.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Transform = Callable[[Column, Mapping], Column]

# What counts as white space, id prefixes, and company suffixes.
WHITESPACE_CHARS = r"\s\x1c-\x1f\x85\p{Z}"
WHITESPACE = f"[{WHITESPACE_CHARS}]"
ID_PREFIXES = ("APN", "PARCEL", "ID")
COMPANY_SUFFIXES = ("LLC", r"L\.L\.C\.", "INC", "CORP", "CO", "TRUST", "TRUSTEE")
TRUE_WORDS = ("true", "1", "yes")

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def title_case(value: Column) -> Column:
    """Capital first letter in every run of letters, also after apostrophes and digits.

    The text is cut before each run, so a piece holds one word for ``initcap`` to raise.
    """
    runs = F.split(F.lower(value), rf"(?<=[^{_CASED}])(?=[{_CASED}])")
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def parse_float(value: Column) -> Column:
    """Double from text under the number syntax of the reading language, else null."""
    text = strip(value.cast("string"))
    return (
        F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
        .when(text.rlike(_INFINITE), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(F.lower(text).rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def parse_int(value: Column) -> Column:
    """Bigint from text holding only digits and an optional sign, else null."""
    text = strip(value.cast("string"))
    return F.when(
        text.rlike(rf"^[+-]?{_DIGITS}$"), F.regexp_replace(text, "_", "").try_cast("bigint")
    )


def clean_parcel_id(value: Column, config: Mapping) -> Column:
    # ``strict`` asks for a boundary after the prefix, so that IDAHO-1 stays whole.
    boundary = r"(?![\p{L}\p{N}_])" if config.get("strict") else ""
    prefix = rf"(?i)^(?:{'|'.join(ID_PREFIXES)}){boundary}[:{WHITESPACE_CHARS}]*"
    bare = F.regexp_replace(value, prefix, "")
    kept = F.regexp_replace(bare, r"[^\p{L}\p{N}_\-]", "")
    return F.upper(F.translate(kept, "_", "-"))


def normalize_name(value: Column, config: Mapping) -> Column:
    suffix = rf"(?i){WHITESPACE}+(?:{'|'.join(COMPANY_SUFFIXES)})\.?$"
    single_spaced = F.regexp_replace(F.regexp_replace(value, suffix, ""), rf"{WHITESPACE}+", " ")
    return strip(title_case(single_spaced))


def to_decimal(value: Column, config: Mapping) -> Column:
    number = parse_float(F.regexp_replace(value.cast("string"), "[$,]", ""))
    return number.cast(config["type"]) if "type" in config else number


def to_integer(value: Column, config: Mapping) -> Column:
    kept = F.regexp_replace(value.cast("string"), r"[^\d\-]", "")
    return F.when(kept.rlike(r"^-?\d+$"), kept.try_cast("bigint"))


# English month names accepted by %B and %b.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_DIRECTIVES = {
    "Y": r"(\d{4})",
    "y": r"(\d{2})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9])",
    "H": r"(2[0-3]|[01]\d|\d)",
    "I": r"(1[0-2]|0[1-9]|[1-9])",
    "M": r"([0-5]\d|\d)",
    "S": r"([0-5]\d|\d)",
    "p": r"([aApP][mM])",
    "B": f"((?i:{'|'.join(MONTHS)}))",
    "b": f"((?i:{'|'.join(m[:3] for m in MONTHS)}))",
}


def timestamp_from(value: Column, date_format: str) -> Column:
    """Typed twin of ``to_date``: TIMESTAMP_NTZ, null when text does not fit the format.

    The percent-style format turns into one capturing pattern on the driver. Capturing the
    parts keeps one-digit months valid and does not depend on the session time zone.
    """
    pattern, order = "", []
    for literal, directive in re.findall(r"([^%]+)|%(.)", date_format):
        if literal:
            pieces = re.split(r"\s+", literal)
            pattern += r"\s+".join(re.escape(p) for p in pieces)
        elif directive == "%":
            pattern += "%"
        elif directive in _DIRECTIVES:
            pattern += _DIRECTIVES[directive]
            order.append(directive)
        else:
            raise ValueError(f"date directive %{directive} is not supported")
    pattern = f"^{pattern}$"

    def part(name: str) -> Column | None:
        if name not in order:
            return None
        return F.regexp_extract(value, pattern, order.index(name) + 1)

    def number(name: str, default: int) -> Column:
        found = part(name)
        return F.lit(default) if found is None else found.try_cast("int")

    if "Y" in order:
        year = number("Y", 1900)
    elif "y" in order:
        short = number("y", 0)
        year = F.when(short <= 68, short + 2000).otherwise(short + 1900)
    else:
        year = F.lit(1900)
    if "B" in order or "b" in order:
        names = [m if "B" in order else m[:3] for m in MONTHS]
        word = F.lower(part("B" if "B" in order else "b"))
        month = F.array_position(F.array(*[F.lit(n) for n in names]), word).cast("int")
    else:
        month = number("m", 1)
    if "I" in order:
        afternoon = F.lower(part("p")) == "pm" if "p" in order else F.lit(False)
        hour = number("I", 0) % 12 + F.when(afternoon, 12).otherwise(0)
    else:
        hour = number("H", 0)
    made = F.call_function(
        "try_make_timestamp_ntz",
        year, month, number("d", 1), hour, number("M", 0), number("S", 0).cast("decimal(8,6)"),
    )
    return F.when(value.rlike(pattern), made)


def to_date(value: Column, config: Mapping) -> Column:
    parsed = timestamp_from(value, config.get("format", "%Y-%m-%d"))
    iso = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(iso, empty_to_null(value))


def concat_literals(value: Column, config: Mapping) -> Column:
    extra = config.get("with", [])
    extra = [extra] if isinstance(extra, str) else list(extra)
    return F.concat_ws(
        config.get("separator", " "), empty_to_null(value), *[F.lit(str(e)) for e in extra]
    )


def split_text(value: Column, config: Mapping) -> Column:
    delimiter = re.escape(config.get("delimiter", ","))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(
        F.split(value, delimiter, -1)
    )


def default_if_empty(value: Column, config: Mapping) -> Column:
    default = config.get("default")
    return F.coalesce(empty_to_null(value), F.lit(None if default is None else str(default)))


@functools.cache
def java_pattern(pattern: str) -> str:
    """A pattern in Java's syntax for named groups; refused here if Java cannot compile it.

    The check evaluates a constant in the active session, if there is one.
    """
    names: dict[str, str] = {}

    def group(found: re.Match) -> str:
        names[found[1]] = f"g{len(names) + 1}"
        return f"(?<{names[found[1]]}>"

    text = re.sub(r"\(\?P<(\w+)>", group, pattern)
    text = re.sub(r"\(\?P=(\w+)\)", lambda found: rf"\k<{names.get(found[1], found[1])}>", text)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session.sql("SELECT '' RLIKE :pattern", args={"pattern": text}).collect()
        except Exception as error:
            raise ValueError(f"pattern {pattern!r} cannot be used: {str(error).splitlines()[0]}") from None
    return text


def regex_extract(value: Column, config: Mapping) -> Column:
    pattern = config.get("pattern")
    present = empty_to_null(value)
    if not pattern:
        return present
    group = 1 if re.compile(pattern).groups else 0
    pattern = java_pattern(pattern)
    return F.when(present.rlike(pattern), F.regexp_extract(present, pattern, group)).otherwise(present)


def to_bool(value: Column) -> Column:
    return F.lower(value.cast("string")).isin(*TRUE_WORDS)


def truncate_to_int(value: Column, source_type: str) -> Column:
    """Integer cast: fractions are cut on numbers and refused in text."""
    if source_type == "string":
        return parse_int(value)
    return value.try_cast("bigint")


TRANSFORMS: dict[str, Transform] = {
    "clean_parcel_id": clean_parcel_id,
    "normalize_name": normalize_name,
    "to_decimal": to_decimal,
    "to_integer": to_integer,
    "to_date": to_date,
    "to_timestamp": lambda v, c: timestamp_from(v, c.get("format", "%Y-%m-%d")),
    "uppercase": lambda v, c: F.upper(v),
    "lowercase": lambda v, c: F.lower(v),
    "trim": lambda v, c: strip(v),
    "concat": concat_literals,
    "split": split_text,
    "default_if_empty": default_if_empty,
    "regex_extract": regex_extract,
    "strip": lambda v, c: strip(v),
    "upper": lambda v, c: F.upper(v),
    "lower": lambda v, c: F.lower(v),
    "title": lambda v, c: title_case(v),
}

# Transforms of bulk profiles act on str(value); the column type is passed as ``source_type``.
BULK_TRANSFORMS: dict[str, Transform] = {
    "uppercase": lambda v, c: F.upper(v.cast("string")),
    "lowercase": lambda v, c: F.lower(v.cast("string")),
    "strip": lambda v, c: strip(v.cast("string")),
    "to_string": lambda v, c: v.cast("string"),
    "to_int": lambda v, c: truncate_to_int(v, c.get("source_type", "string")),
    "to_float": lambda v, c: parse_float(v) if c.get("source_type", "string") == "string" else v.try_cast("double"),
    "to_bool": lambda v, c: v if c.get("source_type") == "boolean" else to_bool(v),
}


def register_transform(name: str, build: Transform) -> None:
    """Add a transform: a Column builder, or a pandas UDF wrapped as ``lambda v, c: udf(v)``."""
    TRANSFORMS[name] = build


def transform_column(name: str, value: Column, config: Mapping) -> Column:
    """Apply a registered transform; an unknown name leaves the value as it is."""
    build = TRANSFORMS.get(name)
    return value if build is None else build(value, config)


def bulk_transform_column(name: str, value: Column, config: Mapping) -> Column:
    build = BULK_TRANSFORMS.get(name) or TRANSFORMS.get(name)
    return value if build is None else build(value, config)
