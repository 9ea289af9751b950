"""Column functions: numbers from text, safe arithmetic, classes and bands. All are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series for the normal distribution function.
SERIES_TERMS = 48
SUPPORTIVE, ADVERSE, NEUTRAL, CONFLICTED, INELIGIBLE = "SUPPORTIVE", "ADVERSE", "NEUTRAL", "CONFLICTED", "INELIGIBLE"


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first predicate that is true, else null (a null predicate does not count)."""
    return F.coalesce(*[F.when(predicate, F.lit(reason)) for predicate, reason in cases])


def duration_days(start: Column, end: Column) -> Column:
    """Inclusive length of a period in days."""
    return F.date_diff(end, start) + 1


def duration_class(start: Column, end: Column) -> Column:
    days = duration_days(start, end)
    return (
        F.when(days.between(70, 110), "QUARTER")
        .when(days.between(150, 210), "HALF_YEAR_YTD")
        .when(days.between(240, 300), "NINE_MONTH_YTD")
        .when(days.between(340, 380), "FISCAL_YEAR")
        .otherwise("OTHER_DURATION")
    )


def unit_family(unit: Column) -> Column:
    return F.when(F.lower(unit).contains("usd"), "USD").otherwise(F.lower(unit))


def local_name(name: Column) -> Column:
    """The part after the last colon."""
    return F.substring_index(name, ":", -1)


def accounting_number(text: Column, scale: Column | int = 0, sign: Column | None = None) -> Column:
    """Decimal from accounting text: unicode minus, commas, currency signs, dashes for nothing, parentheses for negative, a power of ten."""
    plain = F.regexp_replace(F.translate(F.trim(text), "−,$€  ", "-"), r"\s", "")
    negative = plain.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(plain, r"[()]", "")
    value = F.expr("1") * F.when(bare.rlike(r"^[-–—]*$"), F.lit(None)).otherwise(bare).try_cast("decimal(28,6)")
    value = F.when(negative, -value).otherwise(value)
    if sign is not None:
        value = F.when(sign == "-", -value).otherwise(value)
    power = F.pow(F.lit(10.0), F.lit(scale) if isinstance(scale, int) else scale).cast("decimal(18,6)")
    return (value * power).cast("decimal(28,6)")


def rounding_bound(decimals: Column) -> Column:
    """Half a unit of the last exact place of a reported value; 0 when the attribute is no integer."""
    whole = F.trim(decimals).rlike(r"^-?\d+$")
    return F.when(whole, F.pow(F.lit(10.0), -F.trim(decimals).try_cast("int")) / 2).otherwise(F.lit(0.0))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient in double precision; null for a null or zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def safe_change(current: Column, prior: Column) -> tuple[Column, Column, Column]:
    """(rate, absolute change, method): a rate only over a positive base."""
    both = current.isNotNull() & prior.isNotNull()
    rate = F.when(both & (prior > 0), safe_ratio(current, prior) - 1)
    method = F.when(both & (prior > 0), "PERCENT_CHANGE").when(both, "ABSOLUTE_CHANGE_NONPOSITIVE_BASE")
    return rate, F.when(both, current - prior), method


def direction(value: Column, band: Column | float) -> Column:
    """Strictly beyond the band, or neutral; null is ineligible and never adverse."""
    band = F.lit(band) if not isinstance(band, Column) else band
    return F.when(value.isNull(), INELIGIBLE).when(value > band, SUPPORTIVE).when(value < -band, ADVERSE).otherwise(NEUTRAL)


def reconcile_directions(classes: Iterable[Column]) -> Column:
    """One class for a family from the classes of its members."""
    all_of = F.array(*classes)
    up, down = F.array_contains(all_of, SUPPORTIVE), F.array_contains(all_of, ADVERSE)
    return F.when(up & down, CONFLICTED).when(up, SUPPORTIVE).when(down, ADVERSE).when(F.forall(all_of, lambda c: c == INELIGIBLE), INELIGIBLE).otherwise(NEUTRAL)


def persistence_pattern(values: Column) -> Column:
    """Label of the last four of an array: all positive or negative, and monotone or not."""
    last = F.slice(values, F.greatest(F.size(values) - 3, F.lit(1)), F.lit(4))
    pairs = F.arrays_zip(F.slice(last, F.lit(1), F.size(last) - 1).alias("a"), F.slice(last, F.lit(2), F.size(last)).alias("b"))
    up, down = F.forall(pairs, lambda p: p["a"] <= p["b"]), F.forall(pairs, lambda p: p["a"] >= p["b"])
    positive, negative = F.forall(last, lambda v: v > 0), F.forall(last, lambda v: v < 0)
    return (
        F.when(values.isNull() | (F.size(values) < 2), "INSUFFICIENT_HISTORY")
        .when(positive & up, "CONSISTENTLY_POSITIVE_IMPROVING")
        .when(positive & down, "POSITIVE_BUT_SLOWING")
        .when(negative & up, "NEGATIVE_BUT_RECOVERING")
        .when(negative & down, "CONSISTENTLY_NEGATIVE_DETERIORATING")
        .otherwise("NEUTRAL_OR_ALTERNATING")
    )


def persistence_score(values: Column, band: Column | float, weights: tuple[float, ...]) -> Column:
    """50 (1 + sum of weight times state) over exactly as many values as weights, oldest first; else null."""
    band = F.lit(band) if not isinstance(band, Column) else band
    states = F.transform(values, lambda v: F.when(v > band, 1.0).when(v < -band, -1.0).otherwise(0.0))
    total = F.aggregate(F.zip_with(states, F.array(*[F.lit(w) for w in weights]), lambda s, w: s * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) == len(weights), 50 * (1 + total))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    return F.greatest(F.least(value, high), low)


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function for values between -4 and 4, which the capped z keeps to.

    Spark has no error function; the power series of the integral converges to double precision in
    that range, and stays inside generated code. Generated code is shortest for a column that is never
    null; where ``z`` is an expression, give it a column of its own first.
    """
    z = F.col(z) if isinstance(z, str) else z
    series = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = 1.0 + series * z * z * (1.0 / (2 * k + 1))
    return 0.5 + z * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def stable_json(*columns: str) -> Column:
    """JSON of named columns in name order."""
    return F.to_json(F.struct(*sorted(columns)))


def split_sum(amount: Column, name: str) -> list[Column]:
    """The sum of a long column in two parts, which no number of rows makes overflow; ``joined_sum`` puts them together."""
    return [F.sum(F.shiftright(amount, 30)).alias(f"_{name}_high"), F.sum(amount.bitwiseAND(F.lit((1 << 30) - 1))).alias(f"_{name}_low")]


def joined_sum(name: str, places: int = 4) -> Column:
    """The sum of ``split_sum`` as a decimal with ``places`` places."""
    high, low = (F.col(f"_{name}_{part}").cast("decimal(20,0)") for part in ("high", "low"))
    unit = F.lit("0." + "0" * (places - 1) + "1").cast(f"decimal({places},{places})")
    return (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("decimal(30,0)") * unit
