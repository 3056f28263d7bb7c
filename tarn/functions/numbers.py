"""Numbers: strict admission of texts, affine conversion, even shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def admitted_number(value: Column, text: bool = True) -> Column:
    """struct<value, missing, valid>. Null is missing and valid; a text must be a plain decimal number; nothing infinite or NaN."""
    number = F.when(value.rlike(NUMBER), value.try_cast("double")) if text else value.cast("double")
    valid = value.isNull() | is_finite(number)
    return F.struct(F.when(valid, number).alias("value"), value.isNull().alias("missing"), F.coalesce(valid, F.lit(False)).alias("valid"))


def affine(value: Column, scale: Column, offset: Column) -> Column:
    return value * scale + offset


def even_share(total: Column, count: Column, ceiling: Column, position: Column) -> Column:
    """What the item at ``position`` (from 1) of ``count`` gets of ``total``, at most ``ceiling`` each; first items get the remainder."""
    reserved = F.least(total, count * ceiling)
    quotient = F.floor(reserved / count)
    return quotient + F.when(position <= reserved - quotient * count, F.lit(1)).otherwise(F.lit(0))


def canonical_integer(text: Column) -> Column:
    """The whole number of a text that is its canonical form; else null."""
    number = text.try_cast("int")
    return F.when(number.cast("string") == text, number)


def canonical_logical(text: Column) -> Column:
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
