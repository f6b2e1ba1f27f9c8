"""Exact decimals: a value that does not fit is reported, never rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(11,4)"
STRIKE = "decimal(12,4)"
WIDE = "decimal(38,18)"


def wide(text: Column) -> Column:
    """The text as a wide decimal, null when it is not a finite number."""
    return text.try_cast(WIDE)


def as_price(text: Column) -> Column:
    """The value at four places, null when it is not representable without loss."""
    value = wide(text)
    narrow = value.try_cast(PRICE)
    return F.when(value == narrow, narrow)


def price_problem(text: Column) -> Column:
    """Null for a storable price, else the name of what is wrong with it."""
    value = wide(text)
    narrow = value.try_cast(PRICE)
    return (
        F.when(value.isNull(), F.lit("price_not_a_number"))
        .when(value != F.round(value, 4), F.lit("price_needs_more_decimals"))
        .when(narrow.isNull(), F.lit("price_out_of_range"))
    )


def quantised(text: Column, decimal_type: str) -> Column:
    """Four places, ties to even, null when the text is not a number or does not fit."""
    return F.bround(wide(F.trim(text)), 4).try_cast(decimal_type)


def whole(text: Column, integral: str = "int") -> Column:
    """Integer part of a number given as text, null when it is not one."""
    return wide(F.trim(text)).try_cast(integral)


def as_double(value: Column) -> Column:
    """The only place where a price stops being exact: the final projection."""
    return value.cast("double")
