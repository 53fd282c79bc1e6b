"""Placeholder handling and casts that turn bad text into null instead of failing the job (ANSI mode stays on)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.contract import PRICE

# Texts that stand for "no value", compared upper-case after trimming; date and time patterns.
PLACEHOLDERS = ("", "NAN", "NONE", "NULL")
DATE_PATTERN = "yyyy-MM-dd"
TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"
# A number followed by NO_DIGITS; the group holds the signed digits before the point, or the 0 of NO_DIGITS if there are none.
NO_DIGITS = "#0"
WHOLE_NUMBER = r"^\s*(?:[+-]?\.\d+\s*#(?=0$))?([+-]?\d+)(?:\.\d*)?\s*(?:#0)?$"


def placeholder_to_null(column: Column) -> Column:
    text = F.trim(column)
    return F.when(~F.upper(text).isin(*PLACEHOLDERS), text)


def null_placeholders(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: placeholder_to_null(F.col(c)) for c in columns})


def to_whole(name: str, kind: str = "int") -> Column:
    """'12', ' 12 ', a tab before 12 and '12.0' become 12, '.5' becomes 0; text, overflow and blanks become null.

    One extraction says both whether it is a number and what to cast: a failing cast is a hundred times slower than a passing
    one, and every further pattern makes the generated method of a wide table longer.
    """
    digits = F.regexp_extract(F.concat(name, F.lit(NO_DIGITS)), WHOLE_NUMBER, 1)
    return F.nullif(digits, F.lit("")).try_cast(kind)


def to_id(name: str) -> Column:
    """Ids are 64-bit: a customer table of this size outgrows 32 bits."""
    return to_whole(name, "bigint")


def to_price(name: str) -> Column:
    """Exact price; 'NaN' and 'Infinity' have no decimal value and become null."""
    return F.col(name).try_cast(PRICE)


def to_day(name: str) -> Column:
    return F.try_to_date(F.col(name), DATE_PATTERN)


def to_instant(name: str) -> Column:
    return F.try_to_timestamp(F.col(name), F.lit(TIMESTAMP_PATTERN))
