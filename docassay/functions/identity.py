"""Identity columns: checksum, PAN structure, labelled fields in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten (rotations 0-4, reflections 5-9)."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


# The permutation of the Verhoeff scheme.
_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _powers() -> list[int]:
    rows, row = [], list(range(10))
    for _ in range(8):
        rows.extend(row)
        row = [_STEP[d] for d in row]
    return rows


_D = F.array
_TABLES: dict[str, list[int]] = {
    "mul": [_dihedral(a, b) for a in range(10) for b in range(10)],
    "perm": _powers(),
    "inv": [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)],
}


def _lit(name: str) -> Column:
    return F.array(*[F.lit(v) for v in _TABLES[name]])


def _fold(number: Column, shift: int) -> Column:
    # digits with their places, made once: what a step names would be made again for every digit
    digits = F.transform(F.split(F.reverse(number), ""), lambda d, i: ((i + shift) % 8) * 10 + d.cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, at: F.get(_lit("mul"), acc * 10 + F.get(_lit("perm"), at)))


def verhoeff_ok(number: Column) -> Column:
    """True when an all-digit string passes its check digit; false for anything else, null for null."""
    return F.when(number.isNull(), None).when(number.rlike("^[0-9]+$"), _fold(number, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(number: Column) -> Column:
    """The check digit to append to an all-digit string."""
    return F.get(_lit("inv"), _fold(number, 1))
