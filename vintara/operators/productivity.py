"""Figures per head: irregular head counts carried to period ends, with a weight that falls with their age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import safe_change, safe_ratio
from vintara.operators.asof import merge_asof

# Fixed values: (from day, to day, weight) of a count's age, and the factor of an approximate disclosure.
DECAY = ((0, 120, 1.0), (121, 240, 0.75), (241, 365, 0.5), (366, 100_000, 0.0))
APPROXIMATE = 0.8


def carried_counts(periods: DataFrame, disclosures: DataFrame, keys: tuple[str, ...] = ("issuer",), *, at: str = "q_end", max_age: int | None = None) -> DataFrame:
    """``periods`` with heads, counted_on, head_age, head_weight and employee_class: the latest disclosure on or before each period's end.

    ``disclosures`` has keys, counted_on, heads and approximate. The weight is the step of the decay
    relation that holds the age, less for an approximate count. OBSERVED_EMPLOYEE is a count of the first step, CARRIED_EMPLOYEE an
    older one with weight; with none, or one older than ``max_age`` days or of no weight, there is NO_EMPLOYEE_SIGNAL and no count.
    """
    met = merge_asof(periods, disclosures, keys, at, "counted_on", ("heads", "approximate", "counted_on"), order=("heads",), max_age=max_age, span_days=365)
    steps = periods.sparkSession.createDataFrame(DECAY, "_from int, _to int, _weight double")  # four rows
    aged = met.withColumn("head_age", F.date_diff(at, "counted_on")).join(F.broadcast(steps), F.col("head_age").between(F.col("_from"), F.col("_to")), "left")
    weight = F.coalesce(F.col("_weight") * F.when(F.col("approximate"), APPROXIMATE).otherwise(1.0), F.lit(0.0))
    state = F.when(weight == 0, "NO_EMPLOYEE_SIGNAL").when(F.col("head_age") <= DECAY[0][1], "OBSERVED_EMPLOYEE").otherwise("CARRIED_EMPLOYEE")
    return aged.withColumns({"head_weight": weight, "employee_class": state, "heads": F.when(weight > 0, F.col("heads"))}).drop("_from", "_to", "_weight", "approximate")


def per_head(rows: DataFrame, keys: tuple[str, ...] = ("issuer",), flows: tuple[str, ...] = ("revenue", "operating_income")) -> DataFrame:
    """Add {flow}_per_head, its change on the year before, heads_yoy and growth_spread (yearly growth of the first flow less that of heads).

    ``rows`` has keys, q_end, heads and trailing flows, a row a quarter. The year before is the row four quarters
    earlier by date; a count that is the very same disclosure still counts as no growth.
    """
    w = Window.partitionBy(*keys).orderBy("q_end")
    year_ago = F.months_between("q_end", F.lag("q_end", 4).over(w)) == 12
    before = lambda c: F.when(year_ago, F.lag(c, 4).over(w))
    out = rows.withColumns({f"{f}_per_head": safe_ratio(F.col(f), F.col("heads")) for f in flows})
    changes = {f"{f}_per_head_yoy": safe_change(F.col(f"{f}_per_head"), before(f"{f}_per_head"))[0] for f in flows}
    heads, first = safe_change(F.col("heads"), before("heads"))[0], safe_change(F.col(flows[0]), before(flows[0]))[0]
    return out.withColumns(changes | {"heads_yoy": heads, "growth_spread": first - heads})
