"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrun.schemas import STATUSES

CHARS_PER_TOKEN = 4
SUPPORTED = r"(?i)\.(?:pdf|png|jpe?g|tiff?|bmp|webp)$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "yyyy.M.d", "yyyy'년' M'월' d'일'", "d.M.yyyy", "MMM d, yyyy")


def est_tokens(text: Column) -> Column:
    """Tokens of a text by its length."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / CHARS_PER_TOKEN).cast("long")


def is_supported(path: Column) -> Column:
    """Whether a file is a PDF or an image, by its name."""
    return F.coalesce(path.rlike(SUPPORTED), F.lit(False))


def is_terminal(status: Column) -> Column:
    return status.isin([c for c, _, t in STATUSES if t])


def is_status(status: Column) -> Column:
    return F.coalesce(status.isin([c for c, _, _ in STATUSES]), F.lit(False))


def to_number(value: Column) -> Column:
    """A double; thousands separators and currency signs are let fall."""
    return F.regexp_replace(value, r"[,\s$€£₩]", "").try_cast("double")


def to_money(value: Column) -> Column:
    return F.regexp_replace(value, r"[,\s$€£₩]", "").try_cast("decimal(18,2)")


def to_day(value: Column) -> Column:
    """A date, by the first format that fits."""
    return F.coalesce(*(F.try_to_date(F.trim(value), f) for f in DATE_FORMATS))


def to_time(value: Column) -> Column:
    """An entity's timestamp from its string, ISO 8601 with or without zone or time; null where it isn't one."""
    return F.try_to_timestamp(F.trim(value))


def to_flag(value: Column) -> Column:
    return F.trim(value).try_cast("boolean")


def to_items(value: Column) -> Column:
    """A JSON array, or parts between commas."""
    return F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>")).when(F.trim(value) != "", F.transform(F.split(value, ","), lambda v: F.trim(v)))


def typed(value: Column, kind: str) -> Column:
    """A raw string as the type that a field declares; null where it doesn't fit."""
    return {"string": lambda v: v, "number": to_number, "date": to_day, "boolean": to_flag, "array": to_items}[kind](value)
