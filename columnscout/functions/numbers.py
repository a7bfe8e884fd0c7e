"""Reading numbers out of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A numeric cell and an integer cell; no exponent, no leading dot, thousands commas allowed in the first only.
NUMBER = r"^[+-]?[0-9]+(,[0-9]+)*(\.[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def is_blank(value: Column) -> Column:
    """Null, empty or `nan` in any case, after trimming: such cells don't count for typing."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "nan")


def is_numerical(value: Column) -> Column:
    return value.rlike(NUMBER)


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER)


def to_number(value: Column) -> Column:
    """The number of a numeric cell, thousands commas dropped; null for any other cell."""
    return F.when(is_numerical(value), F.regexp_replace(value, ",", "").try_cast("double"))


def to_integer(value: Column) -> Column:
    """The integer of an integer cell; null for any other cell and beyond 64 bits."""
    return F.when(is_integer(value), F.regexp_replace(value, "^[+]", "").try_cast("long"))
