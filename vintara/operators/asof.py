"""As-of joins of two large tables: the latest row of one at or before each row of the other, by key and time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spans(at: Column, days: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(86_400_000_000 * days)).cast("long")


def merge_asof(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_at: str, right_at: str, values: tuple[str, ...], *, order: tuple[str, ...] = (), max_age: int | None = None, strict: bool = False, span_days: int = 30
) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` that has the same keys and came at or before it.

    Both tables become one, and the last right row seen is carried along a single ordering of key and
    time; neither side is broadcast and no pair is formed. The ordering runs inside spans of
    ``span_days``, so a key that holds much of the rows is shared by as many tasks as it has spans. What a
    span inherits is the last right row of the spans before it: one pre-aggregated row for each key
    and span, chained over spans alone.

    ``order`` decides between right rows of one time (the greatest wins, nulls first). With ``strict`` a right row of
    the same time does not count. A right row older than ``max_age`` days gives nulls. Times are
    dates or timestamps. Rows of ``right`` without a key or time are left out; rows of ``left``
    without one stay, with nulls. Repeated left rows stay as they are. A left column named like a value is an error.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")

    def unplaceable(at_name: str) -> Column:
        return reduce(or_, [F.col(c).isNull() for c in (*keys, at_name)])

    at = lambda c: F.col(c).cast("timestamp")
    known = right.where(~unplaceable(right_at)).select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], at(right_at).alias("_at"), F.struct(at(right_at).alias("_from"), *values).alias("_found"), F.struct(at(right_at), *order).alias("_order"),
        _spans(at(right_at), span_days).alias("_span"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_row"),
    )
    kinds = known.schema
    asked = left.where(~unplaceable(left_at)).select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], at(left_at).alias("_at"), F.lit(None).cast(kinds["_found"].dataType).alias("_found"), F.lit(None).cast(kinds["_order"].dataType).alias("_order"),
        _spans(at(left_at), span_days).alias("_span"), F.lit(-1 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row"),
    )
    by = [f"_k{n}" for n in range(len(keys))]
    light = known.select(*by, "_span", "_found", "_order").unionByName(asked.select(*by, "_span", "_found", "_order"))
    spans = light.groupBy(*by, "_span").agg(F.max_by("_found", "_order").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    start = F.timestamp_micros(F.col("_span") * F.lit(86_400_000_000 * span_days))
    inherited = spans.withColumn("_found", F.last("_last", ignorenulls=True).over(earlier)).where("_found is not null").select(
        *by, start.alias("_at"), "_found", F.lit(None).cast(kinds["_order"].dataType).alias("_order"), "_span", F.lit(-2).alias("_side"), F.lit(None).cast(left.schema).alias("_row")
    )
    merged = known.unionByName(asked).unionByName(inherited)
    run = Window.partitionBy(*by, "_span").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = merged.withColumn("_found", F.last("_found", ignorenulls=True).over(run)).where("_row is not null")
    if max_age is not None:
        met = met.withColumn("_found", F.when(F.col("_at") <= F.col("_found._from") + F.make_interval(days=F.lit(max_age)), F.col("_found")))
    found = met.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[F.col("_found")[v].alias(v) for v in values])
    unplaced = left.where(unplaceable(left_at)).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return found.unionByName(unplaced)
