"""Amounts written in words (English with lakh and crore) as decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.binding import let

# Number words.
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
         "seventeen eighteen nineteen").split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80,
        "ninety": 90}
SCALES = {"thousand": 1000, "lakh": 100000, "lakhs": 100000, "crore": 10000000, "crores": 10000000}
FILLER = ["rupees", "rupee", "rs", "inr", "only", "and", "of", "the"]


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])


def _number(text: Column) -> Column:
    """Integer of a group of number words; null on an unknown word or when there is none."""
    words = F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin(FILLER))
    return let(words, _fold)


def _fold(words: Column) -> Column:
    adds = _map({**{w: i for i, w in enumerate(UNITS)}, **TENS})
    scales = _map(SCALES)
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("run"),
                     F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        add, scale = F.try_element_at(adds, w), F.try_element_at(scales, w)
        one = F.when(s["run"] == 0, F.lit(1).cast("bigint")).otherwise(s["run"])
        run = F.when(add.isNotNull(), s["run"] + add).when(w == "hundred", one * 100).otherwise(
            F.lit(0).cast("bigint"))
        total = F.when(scale.isNotNull(), s["total"] + one * scale).otherwise(s["total"])
        known = add.isNotNull() | scale.isNotNull() | (w == "hundred")
        return F.struct(total.alias("total"), run.alias("run"), (s["ok"] & known).alias("ok"))

    return let(F.aggregate(words, start, step), lambda s: F.when((F.size(words) > 0) & s["ok"], s["total"] + s["run"]))


def words_to_decimal(c: Column) -> Column:
    """Amount in words to DECIMAL(20,2); the last 'and' before 'paise' starts the paise."""
    low = F.lower(c)
    has_paise = low.rlike(r"\bpaise?\b")
    head = F.get(F.split(low, r"\bpaise?\b", 2), F.lit(0))
    cut = F.instr(F.reverse(head), " dna ")  # position of the last " and "
    rupee = F.when(~has_paise, low).when(cut > 0, F.substring(head, F.lit(1), F.length(head) - cut - 4)).otherwise("")
    paise = F.when(has_paise & (cut > 0), F.substring(head, F.length(head) - cut + 2, F.length(head))).when(
        has_paise, head).otherwise("")
    paise_value = F.when(F.trim(paise) != "", _number(paise))
    both = F.struct(_number(rupee).alias("r"), paise_value.alias("p"))

    def value(x: Column) -> Column:
        hundredths = F.when(x["p"].between(0, 99), x["p"]).otherwise(F.lit(0))
        paid = (F.coalesce(x["r"], F.lit(0)) * 100 + hundredths).cast("decimal(22,0)")
        return F.when(x["r"].isNotNull() | x["p"].isNotNull(),
                      (paid * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)"))

    return let(both, value)
