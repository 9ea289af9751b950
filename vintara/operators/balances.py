"""Balances at instants from what was added and taken away, and their averages beside flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import joined_sum, split_sum
from vintara.plans.settle import settle


def quarter_end(day):
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def balances(deltas: DataFrame, keys: tuple[str, ...], *, day: str = "day", amount: str = "amount", upto: str | None = None) -> DataFrame:
    """(keys, q_end, balance, opened, closed) at every quarter's end from a key's first change to the last of all (or ``upto``).

    Changes are first summed by key and quarter, before any ordering, so the running sum sees one row a
    key and quarter however many changes there were. Quarters without changes keep the balance.
    Changes without a day or an amount are left out.
    """
    usable = deltas.where(F.col(day).isNotNull() & F.col(amount).isNotNull())
    kind = f"decimal(28,{usable.schema[amount].dataType.scale})" if usable.schema[amount].dataType.typeName() == "decimal" else "double"
    summed = usable.groupBy(*keys, quarter_end(day).alias("q_end")).agg(
        F.sum(amount).cast(kind).alias("change"), F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0)).cast(kind).alias("opened"), F.sum(F.when(F.col(amount) < 0, -F.col(amount)).otherwise(0)).cast(kind).alias("closed")
    )
    return _carried(summed, keys, upto)


def spell_balances(spells: DataFrame, keys: tuple[str, ...], *, since: str = "since", until: str = "until", amount: str = "amount", places: int = 2, upto: str | None = None) -> DataFrame:
    """``balances`` of amounts that are added on one day and taken away on another; ``amount`` is a long, in units of ``places`` decimal places.

    Spells are summed by key, both quarters and sign before they are opened into changes, so one thin row a spell moves at most.
    """
    quarter = lambda c: F.trunc(c, "quarter")
    usable = spells.where(F.col(amount).isNotNull()).select(*keys, quarter(since).alias("_since"), quarter(until).alias("_until"), (F.col(amount) > 0).alias("_up"), F.col(amount).alias("_x"))
    paired = usable.groupBy(*keys, "_since", "_until", "_up").agg(*split_sum(F.col("_x"), "x")).select(*keys, "_since", "_until", "_up", joined_sum("x", places).cast(f"decimal(28,{places})").alias("_x"))
    zero = F.lit(0).cast(f"decimal(28,{places})")
    change = lambda day, x, up: F.struct(F.col(day).alias("_day"), x.alias("change"), F.when(up, x).otherwise(zero).alias("opened"), F.when(up, zero).otherwise(-x).alias("closed"))
    changes = paired.select(*keys, F.inline(F.array(change("_since", F.col("_x"), F.col("_up")), change("_until", -F.col("_x"), ~F.col("_up"))))).where("_day is not null")
    kind = f"decimal(28,{places})"
    summed = changes.groupBy(*keys, "_day").agg(*[F.sum(c).cast(kind).alias(c) for c in ("change", "opened", "closed")])
    return _carried(summed.select(*keys, quarter_end("_day").alias("q_end"), "change", "opened", "closed"), keys, upto)


def _carried(summed: DataFrame, keys: tuple[str, ...], upto: str | None) -> DataFrame:
    """Changes by key and quarter as balances at every quarter's end: each is carried until the key's next change, without a grid to join."""
    zero = F.lit(0).cast(summed.schema["change"].dataType)
    if upto is None:
        summed = settle(summed)  # read for the last date and for the balances
    last = F.lit(upto).cast("date") if upto else F.lit(summed.agg(F.max("q_end")).first()[0]).cast("date")  # one date
    order = Window.partitionBy(*keys).orderBy("q_end")
    start = F.trunc("q_end", "quarter")
    balance = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(summed.schema["change"].dataType)
    rows = summed.where(start <= last).select(*keys, start.alias("_start"), "opened", "closed", balance.alias("balance"), F.lead(start).over(order).alias("_next"))
    quarters = F.sequence("_start", F.coalesce(F.add_months("_next", -3), last), F.expr("interval 3 months"))
    rows = rows.select("*", F.explode(quarters).alias("_q"))
    own = lambda c: F.when(F.col("_q") == F.col("_start"), F.col(c)).otherwise(zero).alias(c)
    return rows.select(*keys, quarter_end(F.col("_q")).alias("q_end"), "balance", own("opened"), own("closed"))


def averaged(held: DataFrame, keys: tuple[str, ...], instants: int = 5, value: str = "balance") -> DataFrame:
    """Add average (of the last ``instants`` quarter ends, both ends of the span among them) and beginning (the first of them); null where there are fewer or a quarter is missing."""
    w = Window.partitionBy(*keys).orderBy("q_end")
    span = w.rowsBetween(1 - instants, 0)
    whole = (F.count(value).over(span) == instants) & (F.months_between("q_end", F.lag("q_end", instants - 1).over(w)) == 3 * (instants - 1))
    mean = F.sum(F.col(value).cast("double")).over(span) / instants
    return held.withColumns({"average": F.when(whole, mean), "beginning": F.when(whole, F.lag(value, instants - 1).over(w))})


def returns_on(average: DataFrame, flows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Average balances joined to trailing flows: turnover, its change on the year, return and incremental return on the balance.

    ``flows`` has keys, q_end, revenue and profit, both trailing sums, a row a quarter. A quotient over zero or nothing is null.
    The incremental return is the year's change of profit over the change of the average.
    """
    both = average.join(flows, [*keys, "q_end"])
    year_ago = Window.partitionBy(*keys).orderBy(F.year("q_end") * 4 + F.quarter("q_end")).rangeBetween(-4, -4)
    both = both.select("*", *[F.first(c).over(year_ago).alias(f"_{c}") for c in ("average", "revenue", "profit")])
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    turnover, before = ratio(F.col("revenue"), F.col("average")), ratio(F.col("_revenue"), F.col("_average"))
    step = F.col("average") - F.col("_average")
    return both.select(
        *keys, "q_end", "balance", "average", turnover.alias("turnover"), (turnover - before).alias("turnover_change"), ratio(F.col("profit"), F.col("average")).alias("return_on_average"),
        ratio(F.col("profit") - F.col("_profit"), step).alias("incremental_return"),
    )
