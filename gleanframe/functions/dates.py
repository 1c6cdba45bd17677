"""Date parsing and calendar bins."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

DATE_FORMATS = (
    "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy",
    "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd",
)


# what a run of pattern letters stands for in a text; other letters have no shape
_SHAPES = {"yyyy": r"[+-]?\d{4,}", "MMM": r"\p{L}+\.?", **dict.fromkeys(("MM", "dd", "HH", "mm", "ss"), r"\d{2}"), **dict.fromkeys("MdHms", r"\d+")}


def format_shape(fmt: str) -> str | None:
    """Pattern that every text of a date format matches; None for a format it cannot tell."""
    out = ""
    for run in re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", fmt):
        letters, other = run[0] + run[1], run[2]
        if letters and letters not in _SHAPES or other and other in "'[]":
            return None
        out += _SHAPES[letters] if letters else re.escape(other)
    return f"^{out}$"


def parse_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO text first, then each listed format; null when none fits.

    A parser that fails costs far more than a look at a text's shape, so each format only sees
    texts of its shape.
    """
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text))
    tried = []
    for f in formats:
        shape, parsed = format_shape(f), F.try_to_timestamp(text, F.lit(f))
        tried.append(parsed if shape is None else F.when(text.rlike(shape), parsed))
    found = F.coalesce(iso, *tried)
    if any(format_shape(f) is None for f in formats):
        return found
    return F.when(text.rlike(r"^[+-]?\d|^\p{L}+\.?[ -/]"), found)


def bin_end(c: Column, freq: str) -> Column:
    """Calendar bin of a timestamp: the day, the Sunday that ends the week, or the month end."""
    if freq == "D":
        return F.to_date(c)
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", c)), 6)
    if freq == "ME":
        return F.last_day(F.to_date(c))
    raise ValueError(f"unknown frequency {freq!r}")


def bin_step(c: Column, freq: str, steps: Column) -> Column:
    """Label of the bin ``steps`` after ``c``; months keep the day of the month where they can."""
    if freq == "ME":
        return F.add_months(c, steps)
    return F.date_add(c, steps * (7 if freq == "W" else 1))


def bin_index(c: Column, first: Column, freq: str) -> Column:
    """Number of bins between ``first`` and ``c``."""
    if freq == "ME":
        return (F.year(c) - F.year(first)) * 12 + F.month(c) - F.month(first)
    return F.floor(F.datediff(c, first) / (7 if freq == "W" else 1)).cast("int")


def to_display_time(c: Column, zone: str = "Asia/Kolkata") -> Column:
    """UTC instant in the display zone of the user interface."""
    return F.from_utc_timestamp(c, zone)
