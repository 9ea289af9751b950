"""Checks as tables: each gate returns the rows that break it, or fails the job when asked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import first_reason


def duplicates(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that are there more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows``, or a failed job if a key repeats (counted in a window, so data and check are one pass)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", F.when(n > 1, F.raise_error(F.lit(f"duplicate key in {', '.join(keys)}"))).otherwise(n)).where("_n > 0").drop("_n")


def set_difference(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys found on one side only, with that side."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(True)), right.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, list(keys), "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "RIGHT_ONLY").otherwise("LEFT_ONLY").alias("side"))


def unresolved(rows: DataFrame, references: str, catalog: DataFrame, key: str) -> DataFrame:
    """Elements of an array column that the catalog lacks."""
    return rows.select(F.explode(references).alias(key)).distinct().join(catalog.select(key), key, "left_anti")


def missing_cells(rows: DataFrame, entity: str, metric: str) -> DataFrame:
    """Pairs of entity and metric that a complete rectangle would have and ``rows`` has not.

    The list of metrics is one aggregated row, which bounds it to some ten thousand names; what each
    entity lacks is an array difference, so the rectangle itself is never built.
    """
    every = rows.agg(F.collect_set(metric).alias("_all"))
    held = rows.groupBy(entity).agg(F.collect_set(metric).alias("_own"))
    return held.crossJoin(every).select(entity, F.explode(F.array_except("_all", "_own")).alias(metric))


def with_missing_members(rows: DataFrame, members: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` and a row of defaults for each member that has none."""
    absent = members.select(key).distinct().join(rows.select(key), key, "left_anti")
    return rows.unionByName(absent.select(key, *[c.alias(n) for n, c in defaults.items()]), allowMissingColumns=True)


def fallback_union(first: DataFrame, second: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``first`` and those rows of ``second`` whose key it lacks; columns may differ."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def cell_differences(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, field, old_value, new_value) of cells that differ; numerically equal texts are equal, missing rows count."""

    def cells(rows: DataFrame, name: str) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(list(keys), values, "field", name)

    both = cells(old, "old_value").join(cells(new, "new_value"), [*keys, "field"], "full_outer")
    same_number = F.coalesce(F.col("old_value").try_cast("decimal(38,12)") == F.col("new_value").try_cast("decimal(38,12)"), F.lit(False))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")) & ~same_number)


def row_differences(reference: DataFrame, actual: DataFrame, keys: tuple[str, ...], first: int = 10) -> DataFrame:
    """The first differing rows in key order: keys and the names of unequal columns; a row on one side only differs in all."""
    values = [c for c in reference.columns if c not in keys]
    a, b = reference.select(*keys, F.struct(*values).alias("_a")), actual.select(*keys, F.struct(*values).alias("_b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in values]))
    both = a.join(b, list(keys), "full_outer").withColumn("columns", names).where("_a is null or _b is null or size(columns) > 0")
    return both.orderBy(*keys).limit(first).select(*keys, F.array_join("columns", "|").alias("columns"))


def first_differences(reference: DataFrame, actual: DataFrame, artifact: str, keys: tuple[str, ...], first: int = 10) -> DataFrame:
    """The first differing rows of each artifact in key order: artifact, keys, place and the names of unequal columns."""
    every = (artifact, *keys)
    values = [c for c in reference.columns if c not in every]
    a, b = reference.select(*every, F.struct(*values).alias("_a")), actual.select(*every, F.struct(*values).alias("_b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in values]))
    both = a.join(b, list(every), "full_outer").withColumn("columns", names).where("_a is null or _b is null or size(columns) > 0")
    place = F.row_number().over(Window.partitionBy(artifact).orderBy(*keys))
    return both.withColumn("place", place).where(F.col("place") <= first).select(*every, "place", F.array_join("columns", "|").alias("columns"))


def observation_reason(model_date: Column, current: bool = True) -> Column:
    """First thing wrong with an observation, null if nothing: identity, date, lineage, construction, look-ahead, order, age."""
    d, available, end = F.col("model_date"), F.col("available"), F.col("q_end")
    cases = [
        (F.col("value").isNull(), "MISSING_OBSERVATION"),
        (d != model_date, "MODEL_DATE_MISMATCH"),
        (F.col("lineage").isNull() | (F.size("lineage") == 0), "MISSING_SOURCE_LINEAGE"),
        (~F.col("status").startswith("PASS_") | F.col("rollforward").eqNullSafe("FAIL"), "PERIOD_INCOMPARABLE_OR_CONSTRUCTION_FAILURE"),
        (available.isNull() | (available > model_date) | (end > model_date), "LOOK_AHEAD_OR_MISSING_AVAILABILITY"),
        (available < end, "AVAILABILITY_PRECEDES_PERIOD_END"),
    ]
    if current:
        cases.append((F.date_diff(model_date, available) > 180, "STALE_EXCLUDED_OVER_180_DAYS"))
    return first_reason(*cases)


def metric_reason(model_date: Column, excluded_days: Column) -> Column:
    """First reason why a metric may not enter its peer distribution, null if it may."""
    age = F.greatest(F.col("age_days"), F.date_diff(model_date, F.col("available")))
    return first_reason(
        (F.col("required").isNull(), "DIAGNOSTIC_OR_CONDITIONAL_INPUT"),
        (F.col("model_date") != model_date, "MODEL_DATE_OR_ROSTER_MISMATCH"),
        (~F.col("eligible") | F.col("value").isNull(), "SOURCE_INPUT_INELIGIBLE"),
        (F.col("available").isNull() | (F.col("available") > model_date) | (F.col("q_end") > model_date), "LOOK_AHEAD_OR_MISSING_PERIOD"),
        (F.col("transformation") != F.col("required"), "FALLBACK_OR_UNAPPROVED_TRANSFORMATION"),
        (age > excluded_days, "STALE_EXCLUDED"),
        (F.isnan("value") | (F.abs("value") == float("inf")), "NONFINITE_VALUE"),
    )


def filing_row(rows: DataFrame, model_date: Column) -> DataFrame:
    """Add is_amendment, eligible, exclusion and consistent for a filing index row."""
    exclusion = first_reason(
        (F.col("available") > model_date, "EXCLUDED_LOOKAHEAD"),
        (~F.col("form").isin("10-Q", "10-K", "10-Q/A", "10-K/A"), "EXCLUDED_FORM"),
        (F.col("report_period").isNull(), "MISSING_PERIOD"),
    )
    consistent = (F.col("report_period") <= F.to_date("accepted")) & (F.to_date("accepted") <= F.col("available"))
    return rows.withColumn("is_amendment", F.col("form").endswith("/A")).withColumn("exclusion", exclusion).withColumn("eligible", exclusion.isNull()).withColumn("consistent", consistent)


def unresolved_rows(cited: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Distinct keys that rows cite and the catalog lacks; references stay rows, whoever cites them."""
    return cited.select(key).where(F.col(key).isNotNull()).distinct().join(catalog.select(key), key, "left_anti")
