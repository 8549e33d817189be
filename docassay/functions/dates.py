"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes in the order they are tried, with the pattern that reads them.
FORMATS = [
    ("dd/mm/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("dd-mm-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    ("yyyy-mm-dd", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("dd mon yyyy", r"(?i)^\d{1,2} [a-z]{3} \d{4}$", "d MMM yyyy"),
    ("dd month yyyy", r"(?i)^\d{1,2} [a-z]{4,9} \d{4}$", "d MMMM yyyy"),
    ("dd.mm.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
]


def parse_date(c: Column) -> Column:
    """First shape that reads the text; null otherwise."""
    t = F.trim(c)
    month_case = F.initcap(F.lower(t))
    reads = []
    for _, shape, fmt in FORMATS:
        source = month_case if "MMM" in fmt else t
        reads.append(F.when(t.rlike(shape), F.try_to_timestamp(source, F.lit(fmt)).cast("date")))
    return F.coalesce(*reads)


def date_shape(c: Column) -> Column:
    """Name of the shape that read the text, 'rejected' when none did."""
    t = F.trim(c)
    out = F.lit("rejected")
    for name, shape, _ in reversed(FORMATS):
        out = F.when(t.rlike(shape) & parse_date(c).isNotNull(), F.lit(name)).otherwise(out)
    return out


def parse_pdf_date(c: Column) -> Column:
    """Timestamp from a D:YYYYMMDDhhmmss text; missing parts are zero (month and day one)."""
    shape = r"^D?:?\s*(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?"

    def part(i: int, low: str | None = None) -> Column:
        g = F.regexp_extract(F.trim(c), shape, i)
        g = F.when(g == "", F.lit("00")).otherwise(g)
        return F.when(g == "00", F.lit(low)).otherwise(g) if low else g

    text = F.concat(part(1), part(2, "01"), part(3, "01"), part(4), part(5), part(6))
    return F.when(F.trim(c).rlike(shape), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def birth_date(c: Column) -> Column:
    """Birth date text as yyyy-MM-dd; two-digit years from 30 on belong to the last century."""
    parts = F.split(F.trim(c), r"[\s./-]+")
    n = F.transform(parts, lambda p: p.try_cast("int"))
    first, month, third = F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2))
    year = F.when(first > 31, first).otherwise(third)
    day = F.when(first > 31, third).otherwise(first)
    year = F.when(year < 100, year + F.when(year >= 30, 1900).otherwise(2000)).otherwise(year)
    ok = (F.size(parts) == 3) & month.between(1, 12) & day.between(1, 31) & year.between(1900, 2100)
    return F.when(
        ok,
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                    F.lpad(day.cast("string"), 2, "0")),
    )
