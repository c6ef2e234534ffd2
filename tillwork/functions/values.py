"""Small scalar expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors of the shop's unit settings. The two length
# factors are used as the shop uses them, by the unit that is asked for.
POUNDS_PER_KILOGRAM = "2.2"
FACTOR_WHEN_INCHES_ASKED = "2.54"
FACTOR_WHEN_CENTIMETRES_ASKED = "0.39"

MONEY = "decimal(18,2)"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def moment(as_of) -> Column:
    """The time a job takes as now: a column, a datetime or text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def ratio(top, bottom) -> Column:
    """Double division; null instead of an error for a zero divisor."""
    return F.try_divide(as_column(top).cast("double"), as_column(bottom).cast("double"))


def round_half_up(value, places: int = 2) -> Column:
    """Round in decimal, half away from zero, and give back a double.

    Going through a decimal makes the answer independent of how a tie happens to
    be stored in binary.
    """
    return F.round(as_column(value).cast("decimal(28,8)"), places).cast("double")


def percent(top, bottom) -> Column:
    """``100 * top / bottom`` to two places."""
    return round_half_up(100 * ratio(top, bottom))


def mean_of(total, count) -> Column:
    """Mean from a total and a count, to two places."""
    return round_half_up(ratio(total, count))


def whole_seconds(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``, truncated."""
    return F.timestamp_diff("SECOND", as_column(start), as_column(end))


def blank_to_null(value) -> Column:
    """The text as it is, or null if it is empty or only white space."""
    value = as_column(value)
    return F.when(F.length(F.trim(value)) > 0, value)


def postal_code(value) -> Column:
    """Letters and digits of a postal code."""
    return F.regexp_replace(as_column(value), "[^a-zA-Z0-9]", "")


def weight_in(value, stored_unit: str, wanted_unit: str) -> Column:
    """A weight in ``LB`` or ``KG``, half up to two places."""
    value = as_column(value).cast("decimal(18,6)")
    factor = F.lit(POUNDS_PER_KILOGRAM).cast("decimal(4,2)")
    if stored_unit == wanted_unit:
        return F.round(value, 2)
    return F.round(value * factor if wanted_unit == "LB" else value / factor, 2)


def length_in(value, stored_unit: str, wanted_unit: str) -> Column:
    """A length in ``IN`` or ``CM``, half up to two places."""
    value = as_column(value).cast("decimal(18,6)")
    if stored_unit == wanted_unit:
        return F.round(value, 2)
    factor = FACTOR_WHEN_INCHES_ASKED if wanted_unit == "IN" else FACTOR_WHEN_CENTIMETRES_ASKED
    return F.round(value * F.lit(factor).cast("decimal(4,2)"), 2)


def money_text(value) -> Column:
    """An amount as text with thousands separators and two decimals."""
    return F.format_number(as_column(value), 2)
