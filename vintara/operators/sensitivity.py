"""What other thresholds and other scores would change: counts, entries and exits of every alternative from one pass over the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(values: DataFrame, cuts: DataFrame, group: tuple[str, ...] = ("dimension", "q_end")) -> DataFrame:
    """(group, alternative, passing, entered, dropped, turnover) for every group and every alternative of its dimension.

    ``values`` has the group's columns (dimension among them), a value and how many rows it stands for (column n, optional); ``cuts`` has dimension, alternative, cut, at_least
    (a value passes at or above the cut, else at or below) and is_primary, one primary a dimension. It is a small
    relation of fixed size and is broadcast. Cuts divide each dimension's values into intervals; a row
    only learns its interval, rows are counted by interval, and running counts over these few answer all alternatives. entered and
    dropped compare with the primary cut, turnover is their sum over the primary count (null over nothing).
    """
    w = Window.partitionBy("dimension").orderBy("cut", "alternative")
    points = cuts.withColumn("_at", F.row_number().over(w))
    bounds = points.groupBy("dimension").agg(F.sort_array(F.collect_list(F.struct("_at", "cut", "at_least"))).alias("_cuts"))
    n = F.col("n") if "n" in values.columns else F.lit(1)
    placed = values.where("value is not null").join(F.broadcast(bounds), "dimension")
    # a cut lies below a value that passes it from above, or that it stops from above
    below = F.size(F.filter("_cuts", lambda c: F.when(c["at_least"], c["cut"] <= F.col("value")).otherwise(c["cut"] < F.col("value"))))
    counted = placed.groupBy(*group, below.alias("_k")).agg(F.sum(n).alias("_n"))
    known = values.select(*group).distinct()
    wanted = known.join(F.broadcast(points), "dimension")
    primary = points.where("is_primary").select("dimension", F.col("_at").alias("_p"))
    side = lambda at: F.when(F.col("at_least"), F.col("_k") >= at).otherwise(F.col("_k") < at)
    met = wanted.join(F.broadcast(primary), "dimension").join(counted, list(group), "left")
    here, there = F.coalesce(side(F.col("_at")), F.lit(False)), F.coalesce(side(F.col("_p")), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    out = met.groupBy(*group, "alternative").agg(total(here).alias("passing"), total(here & ~there).alias("entered"), total(~here & there).alias("dropped"), total(there).alias("_base"))
    return out.select(*group, "alternative", "passing", "entered", "dropped", F.try_divide((F.col("entered") + F.col("dropped")).cast("double"), F.col("_base")).alias("turnover"))


def compare(rows: DataFrame, dimension: str, primary: tuple[str, str], others: dict[str, str], cut: float, date: str = "q_end") -> DataFrame:
    """The same columns where an alternative is another score and not another cut: ``primary`` and ``others`` name alternatives and their score columns."""
    names = {primary[0]: primary[1]} | others
    passes = lambda c: F.coalesce(F.col(c) >= cut, F.lit(False))
    base = passes(primary[1])
    count = lambda c: F.count_if(c)
    wide = rows.groupBy(date).agg(count(base).alias("_base"), *[x for k, c in enumerate(names.values()) for x in (count(passes(c)).alias(f"p{k}"), count(passes(c) & ~base).alias(f"e{k}"), count(~passes(c) & base).alias(f"d{k}"))])
    each = F.array(*[F.struct(F.lit(a).alias("alternative"), F.col(f"p{k}").alias("passing"), F.col(f"e{k}").alias("entered"), F.col(f"d{k}").alias("dropped")) for k, a in enumerate(names)])
    out = wide.select(F.lit(dimension).alias("dimension"), date, "_base", F.inline(each))
    return out.select("dimension", date, "alternative", "passing", "entered", "dropped", F.try_divide((F.col("entered") + F.col("dropped")).cast("double"), F.col("_base")).alias("turnover"))
