"""Validation rules as Column builders: each returns the error text, or null when satisfied."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelweave.functions.transforms import parse_float

# The texts of all errors.
TEXTS = {
    "missing": "Missing required field: {field}",
    "required": "Field '{field}' is required",
    "pattern": "Field '{field}' does not match pattern",
    "min_length": "Field '{field}' must be at least {limit} characters",
    "max_length": "Field '{field}' must be at most {limit} characters",
    "number": "Field '{field}' must be a number",
    "min_value": "Field '{field}' must be at least {limit}",
    "max_value": "Field '{field}' must be at most {limit}",
    "enum": "Field '{field}' must be one of: {limit}",
    "email": "Field '{field}' must be a valid email",
    "url": "Field '{field}' must be a valid URL",
    "phone": "Field '{field}' must be a valid phone number",
}

Rule = Callable[[str, Column, Any], Column | None]

# Accepted shapes of e-mail addresses, URLs and phone numbers.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_PATTERN = r"^https?://[^\s]+$"
PHONE_PATTERN = r"^[\d\s\-\(\)\+]+$"


def _error(bad: Column, name: str, field: str, limit: Any = None) -> Column:
    return F.when(bad, F.lit(TEXTS[name].format(field=field, limit=limit)))


def _shape(pattern: str, name: str) -> Rule:
    def build(field: str, value: Column, wanted: Any) -> Column | None:
        if not wanted:
            return None
        return _error(~value.cast("string").rlike(pattern), name, field)

    return build


def _bound(beyond: Callable[[Column, float], Column], name: str) -> Rule:
    def build(field: str, value: Column, limit: Any) -> Column:
        number = parse_float(value)
        # Spark orders NaN above every number; a NaN compares false here.
        breach = ~F.isnan(number) & beyond(number, float(limit))
        return F.coalesce(_error(number.isNull(), "number", field), _error(breach, name, field, limit))

    return build


def _required(field: str, value: Column, wanted: Any) -> Column | None:
    return _error(value.cast("string") == "", "required", field) if wanted else None


def _pattern(field: str, value: Column, pattern: str) -> Column:
    return _error(~value.cast("string").rlike(rf"\A(?:{pattern})"), "pattern", field)


def _min_length(field: str, value: Column, size: int) -> Column:
    return _error(F.length(value.cast("string")) < size, "min_length", field, size)


def _max_length(field: str, value: Column, size: int) -> Column:
    return _error(F.length(value.cast("string")) > size, "max_length", field, size)


def _enum(field: str, value: Column, allowed: list) -> Column:
    return _error(~value.isin(*allowed), "enum", field, allowed)


RULES: dict[str, Rule] = {
    "required": _required,
    "pattern": _pattern,
    "min_length": _min_length,
    "max_length": _max_length,
    "min_value": _bound(lambda n, limit: n < limit, "min_value"),
    "max_value": _bound(lambda n, limit: n > limit, "max_value"),
    "enum": _enum,
    "email": _shape(EMAIL_PATTERN, "email"),
    "url": _shape(URL_PATTERN, "url"),
    "phone": _shape(PHONE_PATTERN, "phone"),
}


def register_rule(name: str, build: Rule) -> None:
    RULES[name] = build


def missing_error(field: str, value: Column) -> Column:
    absent = value.isNull() | (value.cast("string") == "")
    return _error(absent, "missing", field)
