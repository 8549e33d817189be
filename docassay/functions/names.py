"""Name, organisation and free-text similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.binding import let
from docassay.rulebook import ORG_SUFFIXES


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 when a side is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)
    )


def text_ratio(a: Column, b: Column) -> Column:
    return edit_ratio(normal_text(a), normal_text(b))


def normal_org(c: Column) -> Column:
    """Lower case, legal suffixes and punctuation removed, spaces collapsed."""
    s = F.regexp_replace(F.lower(c), ORG_SUFFIXES, " ")
    s = F.regexp_replace(s, "[^a-z0-9\\s]", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def org_ratio(a: Column, b: Column) -> Column:
    return edit_ratio(normal_org(a), normal_org(b))


# Labels that may follow a name on its line, and titles before it.
LABELS = ["a/?c", "account", "pan", "aadhaar", "dob", "address"]
TITLES = ["mr", "mrs", "ms", "miss", "shri", "smt", "dr", "m/s"]


def normal_name(c: Column) -> Column:
    """Person name in capitals, without titles and trailing labels; null when nothing is left."""
    s = F.regexp_replace(F.trim(c), rf"(?i)\s+(?:{'|'.join(LABELS)}).*$", "")
    s = F.regexp_replace(s, rf"(?i)^(?:{'|'.join(TITLES)})\.?\s+", "")
    s = F.regexp_replace(s, r"[^A-Za-z\s]", " ")
    return F.nullif(F.upper(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit(""))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _compatible(t: Column, u: Column) -> Column:
    """Equal, or one is the other's initial."""
    return (t == u) | ((F.length(t) == 1) & u.startswith(t)) | ((F.length(u) == 1) & t.startswith(u))


def _given_match(x: Column) -> Column:
    """Every given name of ``x.short`` takes a compatible, still free one of ``x.long``, in order."""

    def place(taken: Column, t: Column) -> Column:
        free = F.filter(
            F.sequence(F.lit(0), F.size(x["long"]) - 1),
            lambda j: ~F.array_contains(taken, j) & _compatible(t, F.get(x["long"], j)),
        )
        return F.concat(taken, F.slice(free, 1, 1))

    placed = F.aggregate(x["short"], F.array().cast("array<int>"), place)
    return F.when(F.size(x["short"]) == 0, F.lit(True)).otherwise(F.size(placed) == F.size(x["short"]))


def _parts(p: Column) -> Column:
    a, b = p["a"], p["b"]
    sa, sb = F.get(a, F.size(a) - 1), F.get(b, F.size(b) - 1)
    ga, gb = F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1)
    a_short = F.size(a) <= F.size(b)
    sides = F.struct(F.when(a_short, ga).otherwise(gb).alias("short"), F.when(a_short, gb).otherwise(ga).alias("long"))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False))
        .when((sa != sb) & (F.levenshtein(sa, sb) > 1), F.lit(False))
        .otherwise(let(sides, _given_match))
    )


def names_match(a: Column, b: Column) -> Column:
    """Surnames equal or one edit apart, and every given name of the shorter side finds a partner."""
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when((a == b) & (F.trim(a) != ""), F.lit(True))
        .otherwise(let(F.struct(_tokens(a).alias("a"), _tokens(b).alias("b")), _parts))
    )


def names_agree(a: Column, b: Column) -> Column:
    """Name comparison after text normalisation."""
    both = F.struct(F.upper(normal_text(a)).alias("a"), F.upper(normal_text(b)).alias("b"))
    return let(both, lambda p: names_match(p["a"], p["b"]))
