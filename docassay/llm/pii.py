"""Surrogates for personal data, in DataFrame operations only.

Patterns find mail addresses, phone, card and social-security numbers, IP addresses and names behind a title or a known
given name, with any number of further given names, initials, particles and capitalised words. What identifies an entity
is its canonical form (lower case, digits only, each word of a surname), so all its mentions in all documents get one
surrogate: "Smith" is one entity in "Mr. John Smith", "Mrs Smith" and "Mr J. Smith". Surrogates come from a keyed digest: digits for digits, letters for
letters of the same script, address parts in range, card numbers with a valid check digit where the original has one,
given names of the same gender and script, Slavic surnames with the ending of the title's gender. They are rendered in
each mention's own format and case.

Two entities never share a surrogate, and no surrogate is itself an entity of the corpus: surrogates of all distinct
entities are grouped, and whatever clashes is drawn again, with longer numbers or names after some draws, so the rounds
end. Only the documents that mention something are joined with their replacements; the others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.session import durable

_LETTER = r"\p{L}"
#: Titles by gender of the person, fixed values.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа", "Κυρία"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
          "n": ["Dr", "Prof"]}
#: Given names by script and gender; surrogates are drawn from the list their original is in.
GIVEN = {("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sara", "Sofia"],
         ("latin", "m"): ["Adam", "Bruno", "Carlos", "David", "Felix", "Hugo", "John", "Leon", "Martin", "Oscar", "Paul", "Thomas"],
         ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"],
         ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Максим", "Павел", "Сергей"]}
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_PARTICLES = "van von vom zu zur der den ten ter de del della di da do dos das du la las le los el al bin ibn".split()
#: Letters of a name; initials; a word of a surname, and one that follows another, which is no title.
_IN = r"[\p{L}\p{M}'’-]"
_INITIAL = r"(?:\p{Lu}\.-?)+|\p{Lu}"
_BETWEEN = rf"(?:(?:{_INITIAL}|{'|'.join(_PARTICLES)}) )*+"
_WORD = rf"\p{{Lu}}{_IN}+"
#: What follows a title or given name. Possessive, so that long runs of capitalised words need no stack.
_REST = rf"{_BETWEEN}{_WORD}(?: {_BETWEEN}(?!(?:{_TITLE})(?!{_LETTER})){_WORD})*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<!{_LETTER})(?:(?:(?:{_TITLE})\.? )+|(?:{_GIVEN}) ){_REST}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity contains.
HINT = rf"[0-9@]|(?:{_TITLE}|{_GIVEN})\.? "
#: Draws that keep the length, and draws that shun the corpus' own entities.
SAME_LENGTH, SHUN = 4, 12
_SYLLABLES = {"latin": "ba be do fi ga hu ka le mi no pa re sa to va wi".split(), "cyrillic": "ба ве до фи га ну ка ле ми но па ре са то ва зи".split(),
              "greek": "βα γε δο φι κα λε μι νο πα ρε σα το ζα θη χε ξυ".split()}


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind(raw: Column) -> Column:
    out = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stem(word: Column) -> Column:
    """What identifies a word of a surname. Slavic surnames of a man and a woman of one family differ in the ending."""
    return F.when(script(word) == "cyrillic", F.regexp_replace(F.lower(word), "(ов|ев|ин)а?$", "")).otherwise(F.lower(word))


def _forename(word: Column, person: Column, key: str) -> Column:
    """A title or particle as it is; given names and initials follow the person, so mentions of one keep one given name."""
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), person, word), 256), 1, 8), 16, 10).cast("bigint")
    out = word
    for names in GIVEN.values():
        out = F.when(word.isin(names), F.element_at(F.array(*[F.lit(x) for x in names]), (number % len(names) + 1).cast("int"))).otherwise(out)
    letters = F.when(script(word) == "cyrillic", "АБВГДЕЖЗИКЛМНОПРСТУФХ").when(script(word) == "greek", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    # each letter moves by a number of places that is not 0
    initials = F.array_join(F.transform(F.split(word, ""), lambda c: F.when(c.rlike(r"\p{Lu}"), F.substr(
        letters, ((F.greatest(F.instr(letters, c), F.lit(1)) + number % (F.length(letters) - 1)) % F.length(letters) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    return F.when(word.rlike(rf"^(?:{_INITIAL})$"), initials).otherwise(out)


def _parts(df: DataFrame, key: str = "") -> DataFrame:
    """Adds ``kind``, ``part``, ``before``, ``proper`` and ``canonical``.

    A mention is one row, a name of more than two words one for each of its words, numbered by ``part``. ``before`` is what
    to show before the surname's word ``proper``; a word that is none has it all in ``before`` and no ``canonical``. ``lead``
    is the first word of a name.
    """
    raw, k, n, word = F.col("raw"), F.col("kind"), F.col("_n"), F.col("word")
    words = F.split(raw, " ")
    df = df.withColumn("kind", kind(raw))
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("word")))
    two = F.array(F.struct(F.lit(0).alias("part"), F.regexp_extract(raw, r"^(\S+) ", 1).alias("first"), F.regexp_extract(raw, r"^\S+ (.*)$", 1).alias("word")))
    more = F.transform(words, lambda w, i: F.struct(i.alias("part"), F.lit(None).cast("string").alias("first"), w.alias("word")))
    df = df.withColumn("lead", F.when(k == "name", F.regexp_extract(raw, r"^(\S+) ", 1))).withColumn("_last", F.when(k == "name", F.regexp_extract(raw, r"(\S+)$", 1)))
    df = df.withColumn("_n", F.when(k == "name", F.size(words))).withColumn("_part", F.explode(F.when(k != "name", one).when(raw.rlike(r"^\S+ \S+$"), two).otherwise(more)))
    df = df.select("*", "_part.*").drop("_part")
    fixed = [x for names in GIVEN.values() for x in names] + _PARTICLES
    surname = F.col("first").isNotNull() | (F.col("part") == n - 1) | ~(word.isin(fixed) | word.rlike(rf"^(?:{_INITIAL})$|^(?:{_TITLE})\.?$"))
    person, blank = _stem(F.col("_last")), F.when(F.col("part") > 0, " ").otherwise("")
    df = df.withColumn("before", F.when(k != "name", None).when(F.col("first").isNotNull(), F.concat(_forename(F.col("first"), person, key), F.lit(" "))).when(
        surname, blank).otherwise(F.concat(blank, _forename(word, person, key)))).withColumn("proper", F.when((k == "name") & surname, word))
    df = df.withColumn("canonical", F.when(k == "name", _stem(F.col("proper"))).when(k == "email", F.lower(raw)).when(k == "ip", raw).otherwise(F.regexp_replace(raw, "[^0-9]", "")))
    return df.drop("_n", "_last", "first", "word")


def _stream(key: str, length: Column) -> Column:
    """At least four keyed hex digits for each character of an entity."""
    blocks = F.sequence(F.lit(0), F.ceil(length / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("canonical"), F.col("draw").cast("string"), b.cast("string")), 256)), "")


def _number(stream: Column, i: Column, modulus) -> Column:
    return F.conv(F.substr(stream, i * 4 - 3, F.lit(4)), 16, 10).cast("int") % modulus


def _characters(s: Column) -> Column:
    """Letters for letters (lower case Latin) and digits for digits; a leading digit stays above 0."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(
        F.substr(s, i, F.lit(1)).rlike("[0-9]"), F.when(i == 1, _number(F.col("stream"), i, 9) + 1).otherwise(_number(F.col("stream"), i, 10)).cast("string")).when(
        F.substr(s, i, F.lit(1)).rlike("[a-z]"), F.substr(letters, _number(F.col("stream"), i, 26) + 1, F.lit(1))).otherwise(F.substr(s, i, F.lit(1)))), "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits, 0 where it is valid."""
    n = F.length(digits)
    def one(i):
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, d: a + d) % 10


def draw(entities_: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate``, the canonical form to show for ``kind, canonical, draw``."""
    c, extra = F.col("canonical"), F.greatest(F.lit(0), F.col("draw") - SAME_LENGTH)
    df = entities_.withColumn("stream", _stream(key, F.length(c) + extra + 8))
    more = F.repeat(F.lit("1"), extra)
    digits = _characters(F.concat(c, more))
    # the first digit of a card names its issuer; the last one is the check digit
    body = F.concat(F.substr(c, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(digits) - 2))
    check = ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.when(luhn(c) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substr(digits, F.length(digits), F.lit(1))))
    octets = F.split(c, r"\.")
    low = F.when(F.col("draw") < SAME_LENGTH, F.lit(1)).otherwise(0)
    def octet(o, i):
        n, at = F.length(o), i + 1
        return F.when((n >= 3) & (low == 1), 100 + _number(F.col("stream"), at, 156)).when((n == 2) & (low == 1), 10 + _number(F.col("stream"), at, 90)).when(
            low == 1, 1 + _number(F.col("stream"), at, 9)).otherwise(_number(F.col("stream"), at, 256)).cast("string")
    # address space is finite: past the last draws an octet group is added, which keeps surrogates distinct
    ip = F.concat(F.array_join(F.transform(octets, octet), "."), F.when(F.col("draw") >= SHUN, F.concat(F.lit("."), F.array_join(F.transform(F.array(F.lit(1), F.lit(2)), lambda i: _number(F.col("stream"), i + 5, 65536).cast("string")), "."))).otherwise(""))
    tld = F.regexp_extract(c, r"(\.[^.]*)$", 1)
    mail = F.concat(_characters(F.concat(more, F.substr(c, F.lit(1), F.length(c) - F.length(tld)))), tld)
    which = script(c)
    name = F.concat(*[F.when(which == s, F.array_join(F.transform(F.sequence(F.lit(1), 3 + extra), lambda i: F.element_at(
        F.array(*[F.lit(x) for x in syllables]), _number(F.col("stream"), i, len(syllables)) + 1)), "")).otherwise("") for s, syllables in _SYLLABLES.items()])
    phone = F.when(F.length(c) > 10, F.concat(F.substr(c, F.lit(1), F.length(c) - 10), F.substr(digits, F.length(c) - 9, F.length(digits)))).otherwise(digits)
    out = F.when(F.col("kind") == "email", mail).when(F.col("kind") == "ip", ip).when(F.col("kind") == "card", card).when(
        F.col("kind") == "phone", phone).when(F.col("kind") == "name", name).otherwise(digits)
    return df.withColumn("surrogate", out).drop("stream")


def mapping(found: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` of all distinct entities, surrogates distinct within a kind and, as long as draws
    allow, none of them an entity itself."""
    known = durable(found.filter("canonical is not null").select("kind", "canonical").distinct())
    settled, waiting, at = None, known.withColumn("draw", F.lit(0)), 0
    while True:
        drawn = durable(draw(waiting, key))
        fresh = drawn
        if settled is not None:
            fresh = fresh.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        if at < SHUN:
            fresh = fresh.join(known.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        won = fresh.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        won = durable(won.select("kind", "canonical", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        left = durable(drawn.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("draw") + 1).alias("draw")))
        if left.isEmpty():
            return settled
        waiting, at = left, at + 1


def _rendered() -> Column:
    """The surrogate in the format of the mention ``raw``."""
    raw, s, k = F.col("raw"), F.col("surrogate"), F.col("kind")
    n = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    # digits take the places of digits; what the surrogate has beyond them follows the last one
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(
        F.substr(raw, i, F.lit(1)).rlike("[0-9]"), F.substr(s, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(
        F.substr(raw, i, F.lit(1)))), "")
    numbers = F.concat(digits, F.substr(s, n + 1, F.length(s)))
    shift = F.length(s) - F.length(raw)
    mail = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(
        F.substr(raw, F.greatest(i - shift, F.lit(1)), F.lit(1)).rlike("[A-Z]"), F.upper(F.substr(s, i, F.lit(1)))).otherwise(F.substr(s, i, F.lit(1)))), "")
    female = F.regexp_replace("lead", r"\.$", "").isin(TITLES["f"] + [x for (_, g), names in GIVEN.items() if g == "f" for x in names])
    proper = F.when(script(F.col("proper")) == "cyrillic", F.concat(s, F.when(F.col("proper").rlike("[а-я](ова|ева|ина|ов|ев|ин)$"), F.when(female, "ова").otherwise("ов")).otherwise(""))).otherwise(s)
    proper = F.when(F.col("proper") == F.upper("proper"), F.upper(proper)).otherwise(F.concat(F.upper(F.substr(proper, F.lit(1), F.lit(1))), F.substr(proper, F.lit(2), F.length(proper))))
    return F.when(k == "name", F.concat(F.col("before"), proper)).when(k == "email", mail).when(k == "ip", s).otherwise(numbers)


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and ``n_email, n_ip, n_phone, n_ssn, n_card, n_name`` counted.

    Defined cases: null and empty texts stay as they are, with no entity; rows that share an id, or have none, are kept
    apart by a hash of id and text; an empty table gives an empty table. Columns of the counts' names are replaced.
    """
    counts = [f"n_{k}" for k in PATTERNS]
    kept = [c for c in docs.columns if c not in counts]
    keyed = docs.select(*kept).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_tid", F.xxhash64("doc_id", "text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    names = F.when(hinted, entities(F.col("text")))
    found = keyed.filter(hinted).select("_id", "_tid", F.posexplode(names).alias("place", "raw")).distinct()
    found = durable(_parts(found, key))
    replaced = found.join(mapping(found, key), ["kind", "canonical"]).withColumn("shown", _rendered()).select("_id", "_tid", "kind", "place", "part", "shown")
    replaced = replaced.unionByName(found.filter("canonical is null").select("_id", "_tid", "kind", "place", "part", F.col("before").alias("shown")))
    per_doc = replaced.groupBy("_id", "_tid").agg(F.sort_array(F.collect_list(F.struct("place", "part", "shown"))).alias("_shown"),
                                                  *[F.sum(((F.col("kind") == k) & (F.col("part") == 0)).cast("bigint")).alias(f"n_{k}") for k in PATTERNS])
    per_doc = durable(per_doc)
    has = hinted & F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    # split before the join, so that it is not done again for each piece
    split = keyed.filter(has).withColumn("text", F.split("text", ANY, -1))
    # the text before a mention comes with its first part
    rebuilt = F.concat(F.array_join(F.transform("_shown", lambda x: F.concat(F.when(x["part"] == 0, F.get("text", x["place"])).otherwise(F.lit("")), x["shown"])), ""), F.element_at("text", -1))
    changed = split.join(per_doc, ["_id", "_tid"]).withColumn("text", rebuilt).select(*kept, *counts)
    plain = keyed.filter(~has).select(*kept, *[F.lit(0).cast("bigint").alias(c) for c in counts])
    return plain.unionByName(changed)
