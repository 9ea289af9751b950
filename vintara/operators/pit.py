"""Point-in-time selection: what was known on a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dates that one as-of join takes.
MAX_DATES = 10_000
#: A total order of vintages: knowledge date, acceptance, id.
VINTAGE = ("available", "accepted", "accession")


def eligible(filings: DataFrame, model_date: str, forms: tuple[str, ...] = ("10-Q", "10-K", "10-Q/A", "10-K/A")) -> DataFrame:
    """Filings of the given forms known by the model date; the predicates reach the scan."""
    return filings.where(F.col("form").isin(*forms) & (F.col("available") <= F.lit(model_date).cast("date")))


def latest_vintage(filings: DataFrame, keys: tuple[str, ...] = ("issuer", "report_period")) -> DataFrame:
    """The latest row per key. A struct maximum is pre-aggregated before the shuffle, so no window is needed."""
    rest = [c for c in filings.columns if c not in keys]
    order = F.struct(*VINTAGE)
    return filings.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_periods(vintages: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` report periods of each issuer with sequence 1 to n in time order."""
    newest = Window.partitionBy("issuer").orderBy(F.desc("report_period"))
    kept = vintages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
    return kept.withColumn("sequence", F.row_number().over(Window.partitionBy("issuer").orderBy("report_period")))


def history_audit(periods: DataFrame, quarters: int = 8, years: int = 2, span: int = 900) -> DataFrame:
    """Whether each issuer's kept filings are enough: counts of forms and the span in days."""
    rows = periods.groupBy("issuer").agg(
        F.count_if(F.col("form").startswith("10-Q")).alias("quarterly"), F.count_if(F.col("form").startswith("10-K")).alias("yearly"),
        F.date_diff(F.max("report_period"), F.min("report_period")).alias("span_days"),
    )
    ok = (F.col("quarterly") >= quarters) & (F.col("yearly") >= years) & (F.col("span_days") >= span)
    return rows.withColumn("history", F.when(ok, "PASS_TARGET_HISTORY").otherwise("REVIEW_HISTORY_GAP"))


def latest_values(facts: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """One row per key: values, how many different ones its latest available date has, and fact, what was accepted last on that date.

    Values lie in order within a date and are counted as they pass, so one ordering by key is all that a task holds; only ``fact`` takes another, where it is used.
    """
    rest = [c for c in facts.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("available"), F.asc_nulls_first(value))
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.col("available").eqNullSafe(F.first("available").over(past))
    ends = F.lead(F.lit(True)).over(order).isNull() | ~F.lead("available").over(order).eqNullSafe(F.col("available"))
    values = F.dense_rank().over(order) - F.first(value).over(past).isNull().cast("int")  # nulls stand first and are no value
    fact = F.max_by(F.struct(*rest), F.struct("accepted", "accession")).over(Window.partitionBy(*keys, "available"))
    return facts.withColumn("fact", fact).select(*keys, "fact", values.cast("long").alias("values"), (latest & ends).alias("_last")).where("_last").drop("_last")


def select_parent(facts: DataFrame, keys: tuple[str, ...], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(selected, conflicts): the latest available fact per key; keys with several values on that date are conflicts and select nothing."""
    kinds = latest_values(facts, keys, value)
    rest = [c for c in facts.columns if c not in keys]
    chosen = kinds.where("values = 1").select(*keys, *[F.col(f"fact.{c}").alias(c) for c in rest])
    return chosen, kinds.where("values > 1").select(*keys, "values")


def as_known_on(facts: DataFrame, dates: DataFrame, keys: tuple[str, ...], date: str = "model_date") -> DataFrame:
    """For each of many dates, the latest fact per key known by then.

    Each fact is known from its available date until the next fact of its key, so one window gives
    intervals and one range join with the dates does all cutoffs at once (no loop). ``dates``
    is broadcast and may have MAX_DATES rows at most; more is an error.
    """
    if dates.limit(MAX_DATES + 1).count() > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} dates")
    w = Window.partitionBy(*keys).orderBy(*VINTAGE)
    spans = facts.withColumn("_until", F.lead("available").over(w))
    spans = spans.where("_until is null or _until > available")
    on = (F.col(date) >= F.col("available")) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    return spans.join(F.broadcast(dates), on).drop("_until")


def restatements(facts: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """First and last vintage per key with the difference, its share of the first, and how many vintages there are."""
    order = F.struct(*VINTAGE)
    rows = facts.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count(F.lit(1)).alias("vintages"))
    change = F.col("last_value") - F.col("first_value")
    return rows.withColumn("restated_by", change).withColumn("restated_share", F.try_divide(change.cast("double"), F.abs("first_value").cast("double"))).withColumn("differs", F.col("first_value") != F.col("last_value"))


def choose_by_priority(facts: DataFrame, keys: tuple[str, ...], priority: str = "priority", value: str = "value") -> DataFrame:
    """Add choice: SELECTED for the least priority number of a key, CONFLICT where that has several values, else SUPERSEDED."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(priority))
    best = F.first(priority).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = order.rangeBetween(Window.currentRow, Window.currentRow)  # the rows of one priority
    several = F.min(value).over(same) != F.max(value).over(same)
    return facts.withColumn("choice", F.when(F.col(priority) > best, "SUPERSEDED").when(several, "CONFLICT").otherwise("SELECTED"))


def valid_on(history: DataFrame, day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Slowly changing rows in force on a day: from start inclusive to end exclusive, a null end is open."""
    d = F.lit(day).cast("date")
    return history.where((F.col(start) <= d) & (F.col(end).isNull() | (d < F.col(end))))
