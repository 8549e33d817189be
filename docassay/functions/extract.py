"""Identity fields, scripts, document types and issuers from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.binding import let
from docassay.functions.dates import birth_date
from docassay.functions.identity import verhoeff_ok
from docassay.functions.names import normal_name
from docassay.rulebook import DIGITAL_TEXT_MIN_CHARS, ISSUERS, PAN_HOLDER, TYPE_KEYWORDS

# Printed shapes of identity fields.
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
TWELVE = r"\b([2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4})\b"
NAME = r"(?i)(?:account\s*holder|customer\s*name|holder\s*name|\bname)\s*[:\-]\s*([^\n\r]{2,60})"
ACCOUNT = r"(?i)(?:a/?c\.?\s*(?:no\.?|number)?|account\s*(?:no\.?|number))\s*[:\-]?\s*([0-9][0-9\s-]{7,24}[0-9])"
BORN = (r"(?i)(?:date\s*of\s*birth|d\.?o\.?b\.?|born)\s*[:\-]?\s*"
        r"([0-3]?\d[\s./-][0-1]?\d[\s./-]\d{2,4}|\d{4}[\s./-][0-1]?\d[\s./-][0-3]?\d)")
ID_CONTEXT = r"(?i)aadhaa?r|uidai|\buid\b|\bvid\b|आधार"
CONTEXT_CHARS = 40

# Letter blocks of the scripts.
SCRIPTS = {
    "Devanagari": "ऀ-ॿ", "Bengali": "ঀ-৿", "Gurmukhi": "਀-੿", "Gujarati": "઀-૿",
    "Oriya": "଀-୿", "Tamil": "஀-௿", "Telugu": "ఀ-౿", "Kannada": "ಀ-೿",
    "Malayalam": "ഀ-ൿ",
}
LATIN = "A-Za-zÀ-ɏ"


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def twelve_digit_ids(text: Column) -> Column:
    """12-digit candidates in order as struct<digits, ok>: printed 4-4-4 or labelled within 40 characters on the line.

    Matches are marked and the text is cut there. Five neighbouring pieces always cover the 40 characters before.
    """
    marked = F.regexp_replace(text, TWELVE, "\u0001$1\u0002")

    def from_pieces(pieces: Column) -> Column:
        def one(i: Column) -> Column:
            raw = F.get(F.split(F.get(pieces, i), "\u0002"), F.lit(0))
            before = F.regexp_replace(F.array_join(F.slice(pieces, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), ""), "\u0002", "")
            line = F.element_at(F.split(F.right(before, F.lit(CONTEXT_CHARS)), "\n"), -1)
            known = raw.rlike(r"^[0-9]{4}\s[0-9]{4}\s[0-9]{4}$") | line.rlike(ID_CONTEXT)
            return F.struct(F.regexp_replace(raw, r"\s", "").alias("digits"), known.alias("known"))

        some = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), one)
        some = F.filter(some, lambda c: c["known"] & (F.length(c["digits"]) == 12))
        return F.when(F.size(pieces) > 1, F.transform(some, lambda c: F.struct(
            c["digits"].alias("digits"), verhoeff_ok(c["digits"]).alias("ok"))))

    return let(F.split(marked, "\u0001"), from_pieces)


def identity_fields(text: Column) -> list[Column]:
    """pan, aadhaar, aadhaar_invalid, ifsc, account_number, name, dob."""
    up = F.upper(text)
    ids = twelve_digit_ids(text)
    good = let(ids, lambda a: F.get(F.filter(a, lambda c: c["ok"]), F.lit(0)))
    # a failing id counts only when it comes before the first passing one
    bad = let(ids, lambda a: F.when(F.get(a, F.lit(0))["ok"], None).otherwise(F.get(a, F.lit(0))["digits"]))
    return [
        first(up, PAN).alias("pan"), good["digits"].alias("aadhaar"), bad.alias("aadhaar_invalid"), first(up, IFSC).alias("ifsc"),
        F.regexp_replace(first(text, ACCOUNT), r"[\s-]", "").alias("account_number"),
        normal_name(first(text, NAME)).alias("name"), birth_date(first(text, BORN)).alias("dob"),
    ]


def letters_in(text: Column, block: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{block}]+", ""))


def script_counts(text: Column) -> list[Column]:
    return [letters_in(text, b).alias(n) for n, b in {"Latin": LATIN, **SCRIPTS}.items()]


def script_family(counts: dict[str, Column]) -> tuple[Column, Column]:
    """(family, dominant script): Indic when Indic letters outnumber Latin ones."""
    indic = sum((counts[n] for n in list(SCRIPTS)[1:]), counts["Devanagari"])
    most = F.greatest(*[counts[n] for n in SCRIPTS])
    script = F.lit("")
    for n in reversed(list(SCRIPTS)):
        script = F.when(counts[n] == most, F.lit(n)).otherwise(script)
    is_indic = indic > counts["Latin"]
    none = (indic + counts["Latin"]) == 0
    return (F.when(none, "unknown").when(is_indic, "indic").otherwise("latin"),
            F.when(none, "").when(is_indic, script).otherwise("Latin"))


def document_type(text: Column) -> Column:
    """Family with most distinct keyword hits; UNKNOWN without a hit or on a tie."""
    norm = F.regexp_replace(F.lower(text), r"\s+", " ")

    def decide(n: Column) -> Column:
        scores = F.array(*[
            F.struct(sum((F.contains(n, F.lit(k)).cast("int") for k in kws[1:]), F.contains(n, F.lit(kws[0])).cast("int")).alias("s"),
                     F.lit(fam).alias("f")) for fam, kws in TYPE_KEYWORDS.items()])

        def top(a: Column) -> Column:
            best = F.array_max(F.transform(a, lambda x: x["s"]))
            won = F.filter(a, lambda x: x["s"] == best)
            return F.when((best > 0) & (F.size(won) == 1), F.get(won, F.lit(0))["f"]).otherwise(F.lit("UNKNOWN"))

        return let(scores, top)

    return let(norm, decide)


def sufficiency(text: Column, doc_type: Column, pullable: Column) -> list[Column]:
    quality = F.when(F.length(F.trim(text)) >= DIGITAL_TEXT_MIN_CHARS, "digital_native").otherwise("scanned")
    level = F.when(pullable, "high").when((doc_type != "UNKNOWN") & (quality == "digital_native"), "moderate").otherwise("low")
    return [quality.alias("quality"), level.alias("achievable")]


def issuer(text: Column) -> Column:
    """Own routing-code prefix first; else the earliest printed bank name, the longer name on a tie."""
    code = F.substring(first(F.upper(text), IFSC), 1, 4)
    by_code = F.create_map(*[x for k, _, p, _ in ISSUERS for x in (F.lit(p), F.lit(k))])
    norm = F.regexp_replace(F.lower(text), r"\s+", " ")

    def earliest(n: Column) -> Column:
        spots = []
        for i, (key, name, _, _) in enumerate(ISSUERS):
            at = F.instr(n, name)
            spots.append(F.struct(F.when(at > 0, at).alias("at"), F.lit(0).alias("short"), F.lit(i).alias("i"), F.lit(key).alias("k")))
            word = F.regexp_instr(n, F.lit(rf"\b{key}\b"))
            spots.append(F.struct(F.when(word > 0, word).alias("at"), F.lit(1).alias("short"), F.lit(i).alias("i"), F.lit(key).alias("k")))
        return F.array_min(F.filter(F.array(*spots), lambda s: s["at"].isNotNull()))["k"]

    return F.coalesce(F.try_element_at(by_code, code), let(norm, earliest))


def pan_structure(pan: Column) -> list[Column]:
    """Shape and holder-type letter."""
    p = F.upper(F.trim(pan))
    types = F.create_map(*[x for k, v in PAN_HOLDER.items() for x in (F.lit(k), F.lit(v))])
    shaped = p.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    holder = F.when(shaped, F.try_element_at(types, F.substring(p, 4, 1)))
    return [F.coalesce(holder.isNotNull(), F.lit(False)).alias("valid"), F.coalesce(holder, F.lit("")).alias("holder")]


def source_status(status: Column, name_match: Column, valid: Column) -> Column:
    """verified / invalid / not verified, from the answer of a source."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    good = (s != "") & ~s.rlike("invalid|not|deactiv|fake") & s.rlike("valid|existing|active")
    return F.when(~valid | status.isNull(), "NOT_VERIFIED").when(good & F.coalesce(name_match, F.lit(True)), "VERIFIED").otherwise("INVALID")
