"""Text and number expressions."""

from __future__ import annotations

from collections.abc import Iterable
from math import isfinite

from pyspark.sql import Column, functions as F

from gleanframe.functions.constants import CLEAN_NULL_TOKENS, CSV_NULL_TOKENS, MASK, WHITE_SPACE

# try_cast alone accepts "1d", "1f" and "0x1p3", so texts pass this pattern first
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"

EMAIL_IN_TEXT = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_IN_TEXT = r"\+?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}"
# borders between word characters of ASCII; what \b takes for a letter differs between Java versions
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
SSN_IN_TEXT = rf"{_START}\d{{3}}-\d{{2}}-\d{{4}}{_END}"
CARD_IN_TEXT = rf"{_START}\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}{_END}"
ADDRESS_IN_TEXT = rf"{_START}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_END}"
# every pattern with digits needs one of these: three in a row, or a dot between two
_DIGITS = r"[0-9]{3}|[0-9]\.[0-9]"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (plain ``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def parse_number(c: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def bare_amount(c: Column) -> Column:
    """Text without its leading currency sign, thousands commas and percent signs."""
    unsigned = F.regexp_replace(strip(c), r"^[\$€£¥]", "")
    return strip(F.regexp_replace(unsigned, "[,%]", ""))


def parse_amount(c: Column) -> Column:
    """Text such as ``$1,234`` or ``45%`` to double; the percent sign does not divide."""
    return parse_number(bare_amount(c))


def parse_integer(c: Column) -> Column:
    """Number text to bigint; fractions and values beyond 64 bits become null."""
    number = parse_number(c)
    direct = F.when(strip(c).rlike(INTEGER), strip(c).try_cast("bigint"))
    return F.coalesce(direct, F.when(number == F.floor(number), number.try_cast("bigint")))


def null_tokens(c: Column, tokens: Iterable[str] = CSV_NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def trim_and_null(c: Column) -> Column:
    return null_tokens(strip(c), CLEAN_NULL_TOKENS)


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sql_double(x: float) -> str:
    """A Python number as a SQL literal, infinities and NaN included."""
    return f"{x!r}D" if isfinite(x) else f"DOUBLE('{x}')"


def mask(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.lit(MASK)).otherwise(c)


def redact(c: Column) -> Column:
    """Mask e-mail addresses, card, social security and phone numbers and IP addresses inside running text.

    Looking for an @ or a digit first spares most texts the patterns' tries at every word.
    """
    unaddressed = F.when(c.contains("@"), F.regexp_replace(c, EMAIL_IN_TEXT, MASK)).otherwise(c)
    bare = unaddressed
    for pattern in (CARD_IN_TEXT, SSN_IN_TEXT, ADDRESS_IN_TEXT, PHONE_IN_TEXT):
        bare = F.regexp_replace(bare, pattern, MASK)
    return F.when(c.rlike(_DIGITS), bare).otherwise(unaddressed)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    lowered = F.lower(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word.lower())
    return F.coalesce(hit, F.lit(False))
