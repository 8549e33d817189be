"""The catalogue of invariant checks.

Column checks return ``struct<evaluated, passed, expected, printed>``; checks over rows return a DataFrame with one row
per document. A missing input gives ``evaluated = false`` and ``passed = false``: never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.money import close
from docassay.functions.names import names_agree, names_match, normal_text, text_ratio
from docassay.functions.binding import let
from docassay.functions.numwords import words_to_decimal
from docassay.operators.scan import ordered, running, with_chunks
from docassay.rulebook import AREA_FACTORS, MONEY_TOLERANCE, TIME_FACTORS
from docassay.session import by_key, dealt


def outcome(ok: Column, expected: Column | None = None, printed: Column | None = None) -> Column:
    """Outcome struct from a three-valued condition."""
    return F.struct(
        ok.isNotNull().alias("evaluated"),
        F.coalesce(ok, F.lit(False)).alias("passed"),
        (expected if expected is not None else F.lit(None)).cast("double").alias("expected"),
        (printed if printed is not None else F.lit(None)).cast("double").alias("printed"),
    )


def regex_validate(c: Column, pattern: str) -> Column:
    return outcome(c.rlike(pattern))


def equation(terms: list[tuple[int, Column]], rhs: Column, tol: str = MONEY_TOLERANCE) -> Column:
    """Sum of coefficient * term = rhs within tolerance; any null leaves it unevaluated."""
    lhs = None
    for coef, c in terms:
        t = c if coef == 1 else c * F.lit(coef).cast("decimal(3,0)")
        lhs = t if lhs is None else lhs + t
    return outcome(close(lhs, rhs, tol), lhs, rhs)


_COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def comparison(left: Column, op: str, right: Column) -> Column:
    return outcome(_COMPARE[op](left, right), right, left)


def in_range(c: Column, low, high) -> Column:
    return outcome(c.between(low, high))


def date_order(left: Column, op: str, right: Column) -> Column:
    return outcome(_COMPARE[op](left, right))


def date_within(d: Column, after: Column, months: Column | int) -> Column:
    return outcome(d.between(after, F.add_months(after, months)))


def date_offset_equals(start: Column, months: Column, end: Column, days: int) -> Column:
    return outcome(F.abs(F.datediff(end, F.add_months(start, months))) <= days)


def words_equal_figures(words: Column, figure: Column, tol: str = MONEY_TOLERANCE) -> Column:
    return let(words_to_decimal(words), lambda parsed: outcome(close(parsed, figure, tol), parsed, figure))


def fuzzy_match(a: Column, b: Column, min_ratio: float) -> Column:
    return outcome(text_ratio(a, b) >= min_ratio)


def presence_count(n: Column, minimum: Column | int, exact: Column | int | None = None) -> Column:
    ok = n >= minimum
    return outcome(ok if exact is None else ok & (n == exact))


def instalment(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Amortised instalment P r (1+r)^n / ((1+r)^n - 1) with r = annual percent / 1200."""
    r = annual_rate.cast("double") / 1200.0
    growth = F.pow(1 + r, months)
    return principal.cast("double") * r * growth / (growth - 1)


def formula_instalment(principal: Column, annual_rate: Column, months: Column, observed: Column, tol: float = 1.0):
    expected = instalment(principal, annual_rate, months)
    return outcome(F.abs(expected - observed.cast("double")) <= tol, expected, observed)


def unit_factor(unit: Column, dimension: str) -> Column:
    """Factor to the canonical unit; null where the unit is unknown or depends on the region."""
    factors = AREA_FACTORS if dimension == "area" else TIME_FACTORS
    known = [x for u, f in factors.items() if f is not None for x in (F.lit(u), F.lit(f))]
    return F.try_element_at(F.create_map(*known), unit)


def to_canonical(df: DataFrame, value: str, unit: str, out: str, dimension: str) -> DataFrame:
    """Value in the canonical unit."""
    return df.withColumn(out, F.col(value) * unit_factor(F.col(unit), dimension))


def quantity_equal(df: DataFrame, left: tuple[str, str], right: tuple[str, str], dimension: str, tol: float):
    """Add ``check``: equal after unit conversion."""
    df = to_canonical(df, left[0], left[1], "_l", dimension)
    df = to_canonical(df, right[0], right[1], "_r", dimension)
    ok = F.abs(F.col("_l") - F.col("_r")) <= tol
    return df.withColumn("check", outcome(ok, F.col("_r"), F.col("_l"))).drop("_l", "_r")


def table_lookup(df: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of an external rate table; a missing rate stays null (the check is then unevaluated)."""
    return df.join(rates, keys, "left")


def linear_balance(rows: DataFrame, keys: list[str], base: DataFrame | None = None, tol: str = MONEY_TOLERANCE):
    """Running balance carried forward and re-anchored on every printed figure.

    ``rows`` has ``index, credit, debit, printed, anchor``. Adds ``expected``, ``unread`` (uncompared rows just before)
    and ``broken`` (null where nothing is printed).
    """
    move = F.coalesce("credit", F.lit(0).cast("decimal(20,2)")) - F.coalesce("debit", F.lit(0).cast("decimal(20,2)"))
    base = rows if base is None else base
    rows = with_chunks(rows, keys, ["index"], base)
    rows = running(rows, keys, ["index"], sums={"_cum": move, "_pos": F.lit(1).cast("bigint")})
    printed = F.when(F.col("printed").isNotNull(), F.struct(F.col("printed").alias("b"), F.col("_cum").alias("c"),
                                                            F.col("_pos").alias("p")))
    rows = running(rows, keys, ["index"], lasts={"_last": printed})
    since = F.col("_cum") - F.coalesce("_last.c", F.lit(0).cast("decimal(20,2)"))
    rows = rows.withColumn("expected", F.coalesce("_last.b", "anchor") + since)
    rows = rows.withColumn("unread", F.col("_pos") - 1 - F.coalesce("_last.p", F.lit(0)))
    rows = rows.withColumn("broken", ~close(F.col("expected"), F.col("printed"), tol))
    return rows.drop("_chunk", "_cum", "_pos", "_last")


def linear_balance_evaluable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: an anchor, at least two printed balances, at least one movement."""
    return rows.groupBy(*keys).agg(
        (
            F.max(F.col("anchor").isNotNull())
            & (F.count("printed") >= 2)
            & (F.count_if(F.col("credit").isNotNull() | F.col("debit").isNotNull()) >= 1)
        ).alias("evaluated")
    )


def sum_equals(rows: DataFrame, stated: DataFrame, keys: list[str], value: str, tol: str = MONEY_TOLERANCE):
    """Sum of ``value`` per key against ``stated.stated``; no rows sum to zero."""
    g = rows.groupBy(*keys).agg(F.sum(value).alias("_s"))
    total = F.coalesce("_s", F.lit(0).cast("decimal(28,2)"))
    df = stated.join(g, keys, "left")
    return df.withColumn("check", outcome(close(total, F.col("stated"), tol), total, F.col("stated"))).drop("_s")


def sequence_monotonic(rows: DataFrame, keys: list[str], index: str, value: str, strict: bool = False,
                       base: DataFrame | None = None) -> DataFrame:
    """Present values with ``previous`` and ``broken``; null values are skipped."""
    present = rows.filter(F.col(value).isNotNull())
    present = ordered(present, keys, [index], lasts={"previous": F.col(value)}, base=base)
    bad = F.col(value) <= F.col("previous") if strict else F.col(value) < F.col("previous")
    return present.withColumn("broken", bad)


def monotonic_outcome(rows: DataFrame, keys: list[str], index: str, value: str, strict: bool = False,
                      base: DataFrame | None = None) -> DataFrame:
    seq = sequence_monotonic(rows, keys, index, value, strict, base)
    return seq.groupBy(*keys).agg(
        (F.count(F.lit(1)) >= 2).alias("evaluated"),
        F.count_if("broken").alias("breaks"),
        F.min(F.when(F.col("broken"), F.col(index))).alias("first_break"),
    )


def sequence_complete(numbers: DataFrame, expected: DataFrame, keys: list[str], number: str, n: str, start: int = 1):
    """Integers are exactly start .. start+n-1, without gaps or repeats.

    Counted, not collected: distinct in-range numbers against n, and repeats or strays as a second count.
    """
    last = F.col(n) + (start - 1)
    seen = numbers.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("_k"))
    g = (
        seen.join(expected, keys)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col(number).between(F.lit(start), last)).alias("_in"),
            F.count_if(F.col("_k") > 1).alias("repeated"),
            F.count_if(~F.col(number).between(F.lit(start), last)).alias("stray"),
        )
    )
    out = expected.join(g, keys, "left")
    has = F.col("_in").isNotNull() & F.col(n).isNotNull()
    missing = F.greatest(F.col(n) - F.coalesce("_in", F.lit(0)), F.lit(0))
    return out.select(
        *keys,
        has.alias("evaluated"),
        (has & (missing == 0) & (F.col("repeated") == 0) & (F.col("stray") == 0)).alias("passed"),
        missing.cast("bigint").alias("missing"),
        F.coalesce("repeated", F.lit(0)).alias("repeated"),
        F.coalesce("stray", F.lit(0)).alias("stray"),
    )


def set_subset(subset: DataFrame, superset: DataFrame, keys: list[str], item: str, universe: DataFrame) -> DataFrame:
    """Per key of ``universe``: items of A that B lacks. An empty A passes; no B at all leaves it unevaluated."""
    missing = subset.join(superset.select(*keys, item).distinct(), [*keys, item], "left_anti")
    m = missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"), F.min(item).alias("first_missing"))
    has_b = superset.select(*keys).distinct().withColumn("_b", F.lit(True))
    out = universe.select(*keys).distinct().join(has_b, keys, "left").join(m, keys, "left")
    n = F.coalesce("missing", F.lit(0))
    ev = F.coalesce("_b", F.lit(False))
    return out.select(*keys, ev.alias("evaluated"), (ev & (n == 0)).alias("passed"), n.alias("missing"),
                      F.coalesce("first_missing", F.lit("")).alias("first_missing"))


def references_resolve(refs: DataFrame, targets: DataFrame, keys: list[str], ref: str, target: str) -> DataFrame:
    """Every reference has a target, compared trimmed and in lower case; no references leaves it unevaluated."""
    r = refs.withColumn("_t", F.lower(F.trim(ref)))
    t = targets.select(*keys, F.lower(F.trim(target)).alias("_t")).distinct().withColumn("_hit", F.lit(True))
    j = r.join(t, [*keys, "_t"], "left")
    lost = F.col("_hit").isNull()
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("references"),
        F.count_if(lost).alias("unresolved"),
        F.coalesce(F.min(F.when(lost, F.col(ref))), F.lit("")).alias("first_unresolved"),
    )


def consistency_across(values: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One logical field agrees over the documents of a key; fewer than two leave it unevaluated."""
    v = F.nullif(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit(""))
    g = values.withColumn("_v", v).groupBy(*keys).agg(F.count("_v").alias("present"), F.count_distinct("_v").alias("d"))
    ev = F.col("present") >= 2
    return g.select(*keys, "present", ev.alias("evaluated"), (ev & (F.col("d") == 1)).alias("passed"))


def all_equal_fuzzy(values: DataFrame, keys: list[str], order: str, value: str, parts: int | None = None) -> DataFrame:
    """All names of a key agree pairwise; the first failing pair otherwise.

    Copies collapse first (same normalised text, earliest place). Every name is then compared with the first one: a failure
    there is the first failing pair, and one distinct name needs no pair. Only groups that pass this and still hold
    three or more distinct names go on to the pairwise join. ``parts``: the names are written once, dealt by key into so
    many, instead of made and shuffled for each of these steps.
    """
    d = values.groupBy(*keys, normal_text(F.col(value)).alias("_norm")).agg(
        F.min(order).alias("_o"), F.count(F.lit(1)).alias("_n"), F.min_by(value, order).alias(value))
    if parts:
        d = by_key(dealt(d.repartition(parts, *keys), keys, parts))
    first = d.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value).alias("name"), "_norm"), "_o").alias("_p"), F.sum("_n").alias("_total"),
        F.count(F.lit(1)).alias("_d"),
    )
    # the normalised texts are at hand, and the verdict is read twice
    bad = F.col("_bad")
    met = d.join(first, keys).withColumn("_bad", ~names_match(F.upper("_p._norm"), F.upper("_norm")))
    against = met.groupBy(*keys).agg(
        F.any_value("_total").alias("_total"),
        F.any_value("_d").alias("_d"),
        F.any_value("_p.name").alias("_first"),
        F.min_by(F.when(bad, F.col(value)), F.when(bad, F.col("_o"))).alias("_q"),
    )
    open_groups = against.filter(F.col("_q").isNull() & (F.col("_d") >= 3)).select(*keys)
    left = d.join(open_groups, keys, "left_semi").select(*keys, F.col(value).alias("_a"), F.col("_o").alias("_i"))
    right = d.select(*keys, F.col(value).alias("_b"), F.col("_o").alias("_j"))
    pairs = left.join(right, keys).filter((F.col("_i") < F.col("_j")) & ~names_agree(F.col("_a"), F.col("_b")))
    worst = pairs.groupBy(*keys).agg(F.min_by(F.struct("_a", "_b"), F.struct("_i", "_j")).alias("_w"))
    out = against.join(worst, keys, "left")
    ev = F.col("_total") >= 2
    failed = F.col("_q").isNotNull() | F.col("_w").isNotNull()
    return out.select(
        *keys,
        ev.alias("evaluated"),
        (ev & ~failed).alias("passed"),
        F.coalesce(F.when(F.col("_q").isNotNull(), F.col("_first")), F.col("_w._a"), F.lit("")).alias("left_name"),
        F.coalesce("_q", F.col("_w._b"), F.lit("")).alias("right_name"),
    )


def page_zipper(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Closing of a page beside the opening of the next; pages are few, the window is over page totals."""
    w = Window.partitionBy(*keys).orderBy("page")
    return pages.withColumn("next_open", F.lead("opening").over(w)).filter(
        F.col("closing").isNotNull() & F.col("next_open").isNotNull()
    )
