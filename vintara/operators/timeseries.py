"""Gap-aware series: every windowed value is masked unless its rows are one consecutive run of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import safe_change, safe_ratio

SERIES = ("issuer", "concept")


def _w(keys=SERIES):
    return Window.partitionBy(*keys).orderBy("q_end", "q_start")


def mark_runs(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add run: a number that grows wherever a period does not begin the day after the one before with the next fiscal quarter.

    Only rows with a value take part: a missing value is a hole, and adjacency shows it.
    """
    w = _w(keys)
    follows = (F.col("q_start") == F.date_add(F.lag("q_end").over(w), 1)) & (F.col("fiscal_quarter") == F.lag("fiscal_quarter").over(w) % 4 + 1)
    broken = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    return cells.where("value is not null").withColumn("_break", broken).withColumn("run", F.sum("_break").over(w)).drop("_break")


def whole(k: int, keys: tuple[str, ...] = SERIES) -> Column:
    """Whether this row and the k - 1 rows before it are one run (constant time, no scan of the window)."""
    return F.coalesce(F.lag("run", k - 1).over(_w(keys)) == F.col("run"), F.lit(False))


def trailing(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ttm and prior_ttm: sums of the last four quarters and of the four before, each in one unbroken run of eight for the latter."""
    w = _w(keys)
    return cells.withColumn("ttm", F.when(whole(4, keys), F.sum("value").over(w.rowsBetween(-3, 0)))).withColumn("prior_ttm", F.when(whole(8, keys), F.sum("value").over(w.rowsBetween(-7, -4))))


def trailing_of_rows(rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """``rows`` (a row a quarter, a column a concept) with ttm_{name} for each of ``names``, as ``trailing`` gives it: one ordering for all concepts.

    A missing value of a concept is a hole in that concept alone.
    """
    w = _w(keys)
    follows = (F.col("q_start") == F.date_add(F.lag("q_end").over(w), 1)) & (F.col("fiscal_quarter") == F.lag("fiscal_quarter").over(w) % 4 + 1)
    marked = rows.withColumn("_break", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_break").over(w))
    four = w.rowsBetween(-3, 0)
    whole_year = whole(4, keys)
    return marked.withColumns({f"ttm_{c}": F.when(whole_year & (F.count(c).over(four) == 4), F.sum(c).over(four)) for c in names}).drop("_break", "run")


def year_over_year(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add q_yoy and ttm_yoy, each with its absolute change and its method (see ``safe_change``)."""
    w = _w(keys)
    out = cells.withColumn("prior_q", F.when(whole(5, keys), F.lag("value", 4).over(w)))
    for name, now, before in (("q_yoy", "value", "prior_q"), ("ttm_yoy", "ttm", "prior_ttm")):
        rate, change, method = safe_change(F.col(now), F.col(before))
        out = out.withColumn(name, rate).withColumn(f"{name}_change", change).withColumn(f"{name}_method", method)
    return out


def acceleration(cells: DataFrame, name: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add {name}_acceleration, {name}_acceleration_change and the method: rates if both quarters have one, else absolute changes."""
    w, near = _w(keys), whole(2, keys)
    rate = F.when(near, F.col(name) - F.lag(name).over(w))
    change = F.when(near & rate.isNull(), F.col(f"{name}_change") - F.lag(f"{name}_change").over(w))
    method = F.when(rate.isNotNull(), "YOY_RATE_DELTA").when(change.isNotNull(), "ABSOLUTE_CHANGE_DELTA")
    return cells.withColumn(f"{name}_acceleration", rate).withColumn(f"{name}_acceleration_change", change).withColumn(f"{name}_acceleration_method", method)


def quarter_on_quarter(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add qoq and qoq_change against the quarter before (a diagnostic with no weight)."""
    rate, change, _ = safe_change(F.col("value"), F.when(whole(2, keys), F.lag("value").over(_w(keys))))
    return cells.withColumn("qoq", rate).withColumn("qoq_change", change)


def roll_forward(cells: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add rollforward: PASS or FAIL of ttm = last ttm + quarter - quarter four before; null where these do not exist."""
    w = _w(keys)
    expected = F.when(whole(5, keys), F.lag("ttm").over(w) + F.col("value") - F.lag("value", 4).over(w))
    return cells.withColumn("rollforward", F.when(expected == F.col("ttm"), "PASS").when(expected.isNotNull() & F.col("ttm").isNotNull(), "FAIL"))


def free_cash_flow(cells: DataFrame) -> DataFrame:
    """``cells`` and a derived concept: cash from operations less capital expenditures of the same period and quarter."""
    keys = ["issuer", "q_start", "q_end", "fiscal_quarter"]
    pair = F.col("concept").isin("cash_from_operations", "capital_expenditures")
    both = cells.where(pair).groupBy(*keys).agg(F.max(F.when(F.col("concept") == "cash_from_operations", F.col("value"))).alias("a"), F.max(F.when(F.col("concept") == "capital_expenditures", F.col("value"))).alias("b"))
    made = both.where("a is not null and b is not null").select(*keys, F.lit("free_cash_flow").alias("concept"), (F.col("a") - F.col("b")).cast(cells.schema["value"].dataType).alias("value"))
    return cells.unionByName(made.select(*cells.columns))


def margins(cells: DataFrame, numerator: str, denominator: str = "revenue") -> DataFrame:
    """issuer, q_end and the trailing margin of two concepts: margin, prior_margin, yoy_pp, acceleration_pp.

    The two series are aligned period by period before any window, so a hole in either breaks the run.
    """
    keys = ["issuer", "q_start", "q_end", "fiscal_quarter"]
    top = F.max(F.when(F.col("concept") == numerator, F.col("value"))).alias("value")
    bottom = F.max(F.when(F.col("concept") == denominator, F.col("value"))).alias("base")
    joint = cells.where(F.col("concept").isin(numerator, denominator)).groupBy(*keys).agg(top, bottom).where("value is not null and base is not null")
    by = ("issuer",)
    rows, w = mark_runs(joint, by), _w(by)

    def total(column: str, first: int, last: int, k: int) -> Column:
        return F.when(whole(k, by), F.sum(column).over(w.rowsBetween(first, last)))

    def margin(first: int, last: int, k: int) -> Column:
        down = total("base", first, last, k)
        return F.when(down > 0, safe_ratio(total("value", first, last, k), down))

    rows = rows.withColumn("margin", margin(-3, 0, 4)).withColumn("prior_margin", margin(-7, -4, 8))
    rows = rows.withColumn("yoy_pp", F.col("margin") - F.col("prior_margin"))
    rows = rows.withColumn("acceleration_pp", F.when(whole(2, by), F.col("yoy_pp") - F.lag("yoy_pp").over(w)))
    return rows.select("issuer", "q_end", "margin", "prior_margin", "yoy_pp", "acceleration_pp")


def leverage_spread(changes: DataFrame) -> DataFrame:
    """issuer, q_end, spread: profit's trailing growth rate less revenue's, where both are rates."""
    rate = lambda c: F.max(F.when(F.col("concept") == c, F.col("ttm_yoy")))
    both = changes.where(F.col("concept").isin("revenue", "operating_income")).groupBy("issuer", "q_end").agg(rate("operating_income").alias("p"), rate("revenue").alias("r"))
    return both.where("p is not null and r is not null").select("issuer", "q_end", (F.col("p") - F.col("r")).alias("spread"))


def growth_history(changes: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add history: up to four latest quarterly growth rates, oldest first; a hole or a change without a rate starts it anew."""
    w = _w(keys)
    fresh = F.when(F.col("q_yoy").isNotNull() & F.coalesce(F.lag("q_yoy").over(w).isNotNull() & (F.lag("run").over(w) == F.col("run")), F.lit(False)), 0).otherwise(1)
    rows = changes.withColumn("_fresh", fresh).withColumn("_streak", F.sum("_fresh").over(w))
    recent = F.collect_list(F.struct("_streak", "q_yoy")).over(w.rowsBetween(-3, 0))
    mine = F.transform(F.filter(recent, lambda x: x["_streak"] == F.col("_streak")), lambda x: x["q_yoy"])
    return rows.withColumn("history", F.when(F.col("q_yoy").isNotNull(), mine)).drop("_fresh", "_streak")


def observations(cells: DataFrame) -> DataFrame:
    """All of the above on one partitioning by issuer and concept."""
    rows = year_over_year(trailing(mark_runs(free_cash_flow(cells))))
    for name in ("q_yoy", "ttm_yoy"):
        rows = acceleration(rows, name)
    return growth_history(roll_forward(quarter_on_quarter(rows)))


def audit(rows: DataFrame) -> DataFrame:
    """Per issuer and concept: counts of signals and of roll-forward failures, and the latest state."""
    return rows.groupBy("issuer", "concept").agg(
        F.count(F.lit(1)).alias("quarters"),
        F.count("q_yoy_change").alias("q_yoy_count"),
        F.count("ttm_yoy_change").alias("ttm_yoy_count"),
        F.count_if(F.col("rollforward") == "FAIL").alias("rollforward_failures"),
        F.max_by("ttm_yoy_method", "q_end").alias("latest_method"),
    )
