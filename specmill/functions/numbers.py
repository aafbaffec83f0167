"""Number parsing, rounding and display as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from specmill.functions.text import strip

# Every Unicode decimal digit outside ASCII, and the ASCII digit it stands for.
_FOREIGN_DIGITS = [
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
]
_ASCII_DIGITS = [str(unicodedata.decimal(d)) for d in _FOREIGN_DIGITS]

_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def as_double(plain: Column) -> Column:
    """Text without outer blanks as a double, null when it is no number.

    ``try_cast`` alone is too lenient (it takes ``12d``) and too strict (``1_000``,
    full-width digits), so the text is checked against the number grammar first. The cast is
    never tried on other text, where each failure would cost an exception.
    """
    ascii_only = F.octet_length(plain) == F.length(plain)
    plain = F.when(ascii_only, plain).otherwise(
        F.translate(plain, "".join(_FOREIGN_DIGITS), "".join(_ASCII_DIGITS))
    )
    return F.when(plain.rlike(_NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def parse_finite(text: Column) -> Column:
    """``text`` as a finite double, or null when it is not one."""
    return finite(as_double(strip(text)))


def finite(number: Column) -> Column:
    """The number, or null when it is infinite or not a number."""
    return F.when(F.abs(number) < float("inf"), number)


# Doubles below this magnitude keep ``2000 * x`` and its nearest odd integer exact.
_EXACT_BELOW = 2.0**52 / 2000
# Splits a double into two halves whose products with small integers are exact.
_SPLITTER = 2.0**27 + 1


def round3(number: Column) -> Column:
    """Round to three decimals on the exact binary value, ties to even.

    Spark rounds the shortest decimal form half-up, which differs exactly where the
    fourth decimal is a final 5. There, the sign of ``2000 x - odd integer`` is
    computed without rounding error and decides. The sum with 0.0 turns -0.0 into 0.0.
    """
    doubled = number * F.lit(2000.0)
    odd = F.floor(doubled / 2) * F.lit(2.0) + F.lit(1.0)
    near_tie = (F.abs(number) < _EXACT_BELOW) & (
        F.abs(doubled - odd) <= F.abs(doubled) * F.lit(1e-15)
    )
    spread = number * F.lit(_SPLITTER)
    high = spread - (spread - number)
    low = number - high
    excess = (high * F.lit(2000.0) - odd) + low * F.lit(2000.0)
    below, above = (odd - 1) / 2, (odd + 1) / 2
    even = F.when(below % 2 == 0, below).otherwise(above)
    tie = F.when(excess > 0, above).when(excess < 0, below).otherwise(even) / F.lit(1000.0)
    return F.when(near_tie, tie).otherwise(F.bround(number, 3)) + F.lit(0.0)


def shown(number: Column) -> Column:
    """A rounded number as text: whole numbers without a decimal point."""
    fixed = number.try_cast("decimal(38,3)").cast("string")
    return F.coalesce(F.regexp_replace(fixed, r"\.?0+$", ""), number.cast("string"))
