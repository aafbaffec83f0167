"""Unit names and conversions.

A conversion is three numbers: ``(x + shift) * factor / divisor``. The triple is kept
as data so a field's whole unit check becomes one lookup in a literal map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specmill.functions.text import BLANKS

# Canonical unit -> accepted spelling -> (shift, factor, divisor).
CONVERSIONS: dict[str, dict[str, tuple[float, float, float]]] = {
    "C": {
        "c": (0, 1, 1),
        "degc": (0, 1, 1),
        "℃": (0, 1, 1),
        "f": (-32, 5, 9),
        "degf": (-32, 5, 9),
        "k": (-273.15, 1, 1),
    },
    "V": {
        "v": (0, 1, 1),
        "vdc": (0, 1, 1),
        "vac": (0, 1, 1),
        "mv": (0, 1, 1000),
        "kv": (0, 1000, 1),
    },
    "mA": {"ma": (0, 1, 1), "a": (0, 1000, 1)},
    "ms": {
        "ms": (0, 1, 1),
        "s": (0, 1000, 1),
        "sec": (0, 1000, 1),
        "us": (0, 1, 1000),
        "µs": (0, 1, 1000),
        "min": (0, 60000, 1),
    },
    "g": {
        "g": (0, 1, 1),
        "kg": (0, 1000, 1),
        "mg": (0, 1, 1000),
        "lb": (0, 453.592, 1),
        "lbs": (0, 453.592, 1),
        "oz": (0, 28.3495, 1),
    },
    "mm": {
        "mm": (0, 1, 1),
        "cm": (0, 10, 1),
        "m": (0, 1000, 1),
        "in": (0, 25.4, 1),
        "inch": (0, 25.4, 1),
    },
}

_DROPPED = BLANKS + "°º"


def normalise_unit(unit: Column) -> Column:
    """Lower-case, without blanks and degree signs."""
    return F.lower(F.translate(unit, _DROPPED, ""))


CONVERSION = "struct<shift:double,factor:double,divisor:double>"


def unit_table(canonical: str) -> Column:
    """The conversions to one canonical unit as a literal map."""
    entries = ", ".join(
        f"'{spelling}', named_struct('shift', {shift!r}D, 'factor', {factor!r}D, 'divisor', {divisor!r}D)"
        for spelling, (shift, factor, divisor) in CONVERSIONS[canonical].items()
    )
    return F.expr(f"map({entries})")


def conversion(unit: Column, table: Column) -> Column:
    """Struct (shift, factor, divisor) for a normalised unit, null when unknown."""
    return F.try_element_at(table, unit)


def convert(number: Column, how: Column) -> Column:
    """Apply a conversion struct in the fixed order shift, factor, divisor."""
    return (number + how["shift"]) * how["factor"] / how["divisor"]
