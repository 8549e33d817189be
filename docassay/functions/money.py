"""Money columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printed shapes of an amount.
NUMBER = r"-?\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?|-?\d+(?:\.\d{1,2})?"
MONEY = rf"(?i)^[\s₹$€£rs.]*({NUMBER})\s*(?:dr|cr)?\.?$"
NUMBERS_IN_TEXT = r"(-?\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|-?\d+(?:\.\d{1,2})?)"
CURRENCY_LIKE = r"^(?:\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+\.\d{2})$"
CURRENCY_MARK = r"(?i)^(?:₹|rs\.?)\s*"


def parse_money(c: Column) -> Column:
    """Printed amount to DECIMAL(20,2); null when it is not one."""
    squeezed = F.regexp_replace(c, r"\s+", "")
    digits = F.regexp_replace(F.regexp_extract(squeezed, MONEY, 1), ",", "")
    return digits.try_cast("decimal(20,2)")


def numbers_in(c: Column) -> Column:
    """Distinct amounts of a text: as a whole, per token, and every number inside."""
    inside = F.regexp_extract_all(c, F.lit(NUMBERS_IN_TEXT), F.lit(1))
    every = F.concat(F.array(c), F.split(c, r"\s+"), inside)
    return F.array_distinct(F.array_compact(F.transform(every, parse_money)))


def currency_like(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), CURRENCY_MARK, "").rlike(CURRENCY_LIKE)


def close(a: Column, b: Column, tol) -> Column:
    """|a - b| <= tol on exact decimals; null when a side is null."""
    return F.abs(a - b) <= F.lit(tol).cast("decimal(10,4)")
