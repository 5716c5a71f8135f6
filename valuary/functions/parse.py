"""Parsing and normalising expressions for raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Only digits, sign, point and exponent make a number, so nan, none, null, n/a, na and blanks become null.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


# Every character that counts as white space at the ends of a field.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def to_number(c: Column) -> Column:
    """Text or numeric column as double: thousands commas dropped, unparseable text and NaN become null."""
    text = F.replace(F.lower(strip(c.cast("string"))), F.lit(","), F.lit(""))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """A column as double: text is parsed, numeric columns are only freed of NaN, absent ones are null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return nan_to_null(F.col(name).cast("double"))
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    return to_number(F.col(name))


def day_of(df: DataFrame, name: str, strict: bool = False) -> Column:
    """A column as date: text is parsed, dates and timestamps are only cast, absent ones are null."""
    if name not in df.columns:
        return F.lit(None).cast("date")
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_day(F.col(name), strict)
    return F.col(name).cast("date")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def int_in_range(number: Column, low: int, high: int | None = None) -> Column:
    """A double that is a whole number within [low, high] as long, else null."""
    ok = (number == F.floor(number)) & (number >= low)
    if high is not None:
        ok = ok & (number <= high)
    return F.when(ok, number.cast("long"))


def to_day(c: Column, strict: bool = False) -> Column:
    """Date from ISO or month/day/year text; bad text is null, or an error when `strict`."""
    day = F.coalesce(c.try_cast("date"), F.try_to_timestamp(c.cast("string"), F.lit("M/d/yyyy")).cast("date"))
    if not strict:
        return day
    text = strip(c.cast("string"))
    bad = F.raise_error(F.concat(F.lit("unparseable date: "), text)).cast("date")
    return F.when(day.isNull() & c.isNotNull() & (text != ""), bad).otherwise(day)


def token_or(c: Column, default: str) -> Column:
    """Trimmed text with blank or null replaced by `default`."""
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit(default))


def js_round(c: Column) -> Column:
    """Round half toward positive infinity."""
    return F.floor(c + F.lit(0.5))


def round2(c: Column) -> Column:
    return F.round(c, 2)


def fixed4(c: Column) -> Column:
    """Number as text with four decimals, rounded from its exact binary value."""
    return F.replace(F.format_number(c, 4), F.lit(","), F.lit(""))


def lookup(mapping: dict, key: Column) -> Column:
    """Constant map lookup, null where the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)
