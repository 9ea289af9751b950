"""Diagnostics of the method text: filing summaries, anchors, checks by a second route, calendars, deductions and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import ADVERSE, INELIGIBLE, SUPPORTIVE, first_reason, safe_ratio
from vintara.operators.pit import VINTAGE


def filing_summary(filings: DataFrame, least: int = 9) -> DataFrame:
    """Per issuer, from ``gates.filing_row``: eligible and look-ahead filings, the latest eligible period, and whether the history is short."""
    rows = filings.groupBy("issuer").agg(
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("exclusion") == "EXCLUDED_LOOKAHEAD").alias("look_ahead"),
        F.max(F.when(F.col("eligible"), F.col("report_period"))).alias("latest_period"), F.max_by(F.when(F.col("eligible"), F.col("accession")), F.when(F.col("eligible"), F.struct(*VINTAGE))).alias("latest_accession"),
    )
    return rows.withColumn("history_risk", F.col("eligible") < least)


def update_register(register: DataFrame, summary: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``register`` with ``columns`` replaced by the summary's values where there are any; members without a summary keep theirs."""
    new = summary.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = register.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in register.columns])


def period_anchor(rows: DataFrame, keys: tuple[str, ...], anchors: tuple[str, ...], concept: str = "concept", period: str = "q_end") -> DataFrame:
    """Per key: the latest period of the anchor concepts, or of any where no anchor is there."""
    anchored = F.max(F.when(F.col(concept).isin(*anchors), F.col(period)))
    return rows.groupBy(*keys).agg(F.coalesce(anchored, F.max(period)).alias("as_of_period_end"), anchored.isNotNull().alias("anchored"))


def nine_current(quarters: DataFrame, targets: DataFrame, least: int = 9) -> DataFrame:
    """Per issuer: whether its last ``least`` validated quarters are consecutive and end at its latest target period.

    ``quarters`` has issuer, q_start, q_end of validated quarters; ``targets`` issuer and report_period.
    """
    w = Window.partitionBy("issuer").orderBy("q_end")
    rows = quarters.withColumn("_first", F.lag("q_start", least - 1).over(w)).withColumn("_break", (F.col("q_start") != F.date_add(F.lag("q_end").over(w), 1)).cast("int"))
    rows = rows.withColumn("_breaks", F.sum("_break").over(w.rowsBetween(-(least - 2), 0)))
    last = rows.groupBy("issuer").agg(F.max_by(F.struct("q_end", (F.col("_first").isNotNull() & (F.coalesce("_breaks", F.lit(0)) == 0)).alias("whole")), "q_end").alias("_l"))
    latest = targets.groupBy("issuer").agg(F.max("report_period").alias("target"))
    rows = latest.join(last, "issuer", "left")
    reason = first_reason((F.col("_l").isNull(), "NO_VALIDATED_QUARTERS"), (F.col("_l.q_end") != F.col("target"), "NOT_CURRENT"), (~F.col("_l.whole"), "NOT_NINE_CONSECUTIVE"))
    return rows.select("issuer", "target", F.col("_l.q_end").alias("last_quarter"), F.coalesce(reason, F.lit("PASS")).alias("current"))


def derive_again(cells: DataFrame) -> DataFrame:
    """issuer, concept, q_end, ttm, prior_ttm, prior_q by calendar arithmetic and joins alone, as a check on the windows.

    A quarter's number is its year times four plus its quarter. Each cell is sent to the four ends
    whose trailing year it belongs to, as their current year and as their prior one.
    """
    numbered = cells.select("issuer", "concept", (F.year("q_start") * 4 + F.quarter("q_start")).alias("n"), "q_end", "value")
    sent = numbered.select("issuer", "concept", "value", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("back"))
    sums = sent.groupBy("issuer", "concept", (F.col("n") + F.col("back")).alias("n")).agg(
        F.sum(F.when(F.col("back") < 4, F.col("value"))).alias("now"), F.count_if(F.col("back") < 4).alias("k"), F.sum(F.when(F.col("back") >= 4, F.col("value"))).alias("before"),
        F.count(F.lit(1)).alias("all"), F.max(F.when(F.col("back") == 4, F.col("value"))).alias("year_ago"), F.count_if(F.col("back") <= 4).alias("five"),
    )
    rows = numbered.join(sums, ["issuer", "concept", "n"])
    return rows.select("issuer", "concept", "q_end", F.when(F.col("k") == 4, F.col("now")).alias("ttm"), F.when(F.col("all") == 8, F.col("before")).alias("prior_ttm"), F.when(F.col("five") == 5, F.col("year_ago")).alias("prior_q"))


def compare_routes(stored: DataFrame, again: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per row of ``stored``: MATCH, or the first of ``columns`` that differs from the second route."""
    other = again.select("issuer", "concept", "q_end", *[F.col(c).alias(f"_{c}") for c in columns])
    both = stored.join(other, ["issuer", "concept", "q_end"], "left")
    return both.withColumn("rederivation", F.coalesce(first_reason(*[(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"MISMATCH_{c.upper()}") for c in columns]), F.lit("MATCH"))).drop(*[f"_{c}" for c in columns])


def extra_week(start: Column, end: Column, other_start: Column, other_end: Column) -> tuple[Column, Column, Column]:
    """(extra_week_current, extra_week_comparable, duration_difference_days) of a quarter and the one it is compared with; 98 days are 14 weeks."""
    now, before = F.date_diff(end, start) + 1, F.date_diff(other_end, other_start) + 1
    return now.between(97, 99), before.between(97, 99), now - before


def per_day(value: Column, start: Column, end: Column, reference: int) -> Column:
    """A flow brought to ``reference`` days, a diagnostic with no weight."""
    return safe_ratio(value, F.date_diff(end, start) + 1) * float(reference)


def period_label(start: Column, end: Column, before: Column) -> Column:
    """REGULAR, STUB (shorter than a quarter), TRANSITION (does not begin the day after the period before) or FIRST."""
    days = F.date_diff(end, start) + 1
    return F.when(days < 70, "STUB").when(before.isNull(), "FIRST").when(start != F.date_add(before, 1), "TRANSITION").otherwise("REGULAR")


def transformation_choice(current: Column, prior: Column, near_zero: float) -> Column:
    """How a change may enter: by the base effect of its two values."""
    return (
        F.when(current.isNull() | prior.isNull(), "UNAVAILABLE").when(F.abs(prior) <= near_zero, "STABLE_DENOMINATOR_SCALED").when((current > 0) & (prior < 0), "SIGN_CHANGE_TO_POSITIVE")
        .when((current < 0) & (prior > 0), "SIGN_CHANGE_TO_NEGATIVE").when((current < 0) & (prior < 0), "LEVEL_CHANGE_BOTH_NEGATIVE").otherwise("PERCENT_CHANGE")
    )


def aligned(value: Column, multiplier: Column) -> Column:
    """A signal with higher always better: times 1 or -1, null where the direction is conditional."""
    return F.when(multiplier.isin(1, -1), value * multiplier)


def deducted(available: Column, *lost: tuple[Column, float]) -> Column:
    """Points of one confidence component after its attributable deductions, never below 0."""
    return F.greatest(F.lit(0.0), available - sum((F.when(when, F.lit(points)).otherwise(F.lit(0.0)) for when, points in lost), F.lit(0.0)))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 85, "HIGH").when(value >= 70, "USABLE_WITH_LIMITATIONS").when(value >= 55, "REVIEW_REQUIRED").when(value.isNotNull(), "INSUFFICIENT")


def employee_weight(age_days: Column, approximate: Column) -> Column:
    """Weight of an employee count by its age in steps, less for an approximate disclosure."""
    step = F.when(age_days <= 120, 1.0).when(age_days <= 240, 0.75).when(age_days <= 365, 0.5).otherwise(0.0)
    return F.when(age_days.isNotNull(), step * F.when(approximate, 0.8).otherwise(1.0))


def transitions(rows: DataFrame, state: str, order: str, key: str = "issuer") -> DataFrame:
    """Adjacent states of each key: (previous, current, n, reversals), a reversal being a change that goes back to the state before the last."""
    w = Window.partitionBy(key).orderBy(order)
    steps = rows.select(F.lag(state).over(w).alias("previous"), F.col(state).alias("current"), F.lag(state, 2).over(w).alias("_older")).where("previous is not null")
    back = (F.col("_older") == F.col("current")) & (F.col("previous") != F.col("current"))
    return steps.groupBy("previous", "current").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(back, F.lit(False))).alias("reversals"))


def capex_class(intensity_change: Column, growth: Column, profit: Column, cash: Column, margin: Column) -> tuple[Column, Column]:
    """(class, provisional input) of a change of capital intensity beside the classes of four families."""
    weak = (cash == ADVERSE) | (margin == ADVERSE)
    name = (
        F.when(intensity_change.isNull() | (growth == INELIGIBLE) | (cash == INELIGIBLE), "INELIGIBLE").when((intensity_change <= 0) & (profit != ADVERSE), "EFFICIENCY_SUPPORT")
        .when((intensity_change > 0) & (growth == SUPPORTIVE) & ~weak, "INVESTMENT_SUPPORT").when((intensity_change > 0) & weak & (growth != SUPPORTIVE), "CASH_BURDEN").otherwise("AMBIGUOUS")
    )
    points = F.when(name == "EFFICIENCY_SUPPORT", 65.0).when(name == "INVESTMENT_SUPPORT", 60.0).when(name == "CASH_BURDEN", 25.0).when(name == "AMBIGUOUS", 50.0)
    return name, points
