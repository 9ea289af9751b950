"""Standalone quarters from direct and year-to-date facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import duration_class

KEYS = ("issuer", "concept")


def tolerance(bounds: Column, *values: Column) -> Column:
    """The greatest of 1, a billionth of the largest value, and the summed rounding bounds."""
    return F.greatest(F.lit(1.0), *[F.abs(v).cast("double") * 1e-9 for v in values], bounds)


def one_parent(facts: DataFrame) -> DataFrame:
    """One fact per issuer, concept, start and end: the latest available, then the highest id (a total order, so input order never counts)."""
    extra = [c for c in ("accepted", "accession") if c in facts.columns]
    order = [F.desc("available"), *[F.desc(c) for c in extra], F.desc("value")]
    return facts.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS, "start", "end").orderBy(*order))).where("_n = 1").drop("_n")


def standalone_quarters(facts: DataFrame) -> DataFrame:
    """issuer, concept, fy_start, fiscal_quarter, q_start, q_end, value, method, status, reason, delta, available.

    ``facts`` has issuer, concept, start, end, value, mapping_rule, unit, bound and available. A
    fiscal year is the common start of its half-year, nine-month and yearly facts; a series of plain
    quarters gives nothing. The first quarter is direct, the others are direct and checked against
    the difference of neighbouring year-to-date facts, or that difference alone. Direct quarters are
    matched by their end only, the earliest start first. Outside the tolerance the value is null and
    the row says so. A quarter found in two fiscal years keeps the later available.
    """
    one = one_parent(facts).withColumn("class", duration_class(F.col("start"), F.col("end")))
    fact = F.struct("end", "value", "mapping_rule", "unit", "bound", "available", "start")
    long = one.where(F.col("class").isin("HALF_YEAR_YTD", "NINE_MONTH_YTD", "FISCAL_YEAR")).groupBy(*KEYS, F.col("start").alias("fy_start")).agg(
        *[F.max_by(F.when(F.col("class") == c, fact), F.when(F.col("class") == c, F.struct("available", "end"))).alias(n) for c, n in (("HALF_YEAR_YTD", "h1"), ("NINE_MONTH_YTD", "m9"), ("FISCAL_YEAR", "fy"))]
    )
    long = long.withColumn("least_end", F.least("h1.end", "m9.end", "fy.end"))
    quarter = one.where("class = 'QUARTER'")
    firsts = quarter.select(*KEYS, F.col("start").alias("fy_start"), fact.alias("q1"))
    q1 = long.select(*KEYS, "fy_start", "least_end").join(firsts, [*KEYS, "fy_start"]).where("q1.end < least_end").groupBy(*KEYS, "fy_start").agg(F.min_by("q1", "q1.end").alias("q1"))
    long = long.join(q1, [*KEYS, "fy_start"], "left")
    specs = F.array(
        F.struct(F.lit(1).alias("fiscal_quarter"), F.col("q1").alias("long"), F.lit(None).cast(long.schema["q1"].dataType).alias("short")),
        F.struct(F.lit(2).alias("fiscal_quarter"), F.col("h1").alias("long"), F.col("q1").alias("short")),
        F.struct(F.lit(3).alias("fiscal_quarter"), F.col("m9").alias("long"), F.col("h1").alias("short")),
        F.struct(F.lit(4).alias("fiscal_quarter"), F.col("fy").alias("long"), F.col("m9").alias("short")),
    )
    spec = long.select(*KEYS, "fy_start", F.inline(specs)).where("long is not null")
    direct = quarter.groupBy(*KEYS, F.col("end").alias("q_end")).agg(F.min_by(fact, "start").alias("direct"))
    rows = spec.withColumn("q_end", F.col("long.end")).join(direct, [*KEYS, "q_end"], "left")
    rows = rows.withColumn("direct", F.when(F.col("fiscal_quarter") == 1, F.col("long")).otherwise(F.col("direct")))
    same = (F.col("long.mapping_rule") == F.col("short.mapping_rule")) & (F.lower("long.unit") == F.lower("short.unit"))
    rows = rows.withColumn("derived", F.when(same, F.col("long.value") - F.col("short.value")).cast(facts.schema["value"].dataType))
    has_direct, has_derived = F.col("direct").isNotNull(), F.col("derived").isNotNull() & (F.col("fiscal_quarter") > 1)
    bounds = F.coalesce("direct.bound", F.lit(0.0)) + F.coalesce("long.bound", F.lit(0.0)) + F.coalesce("short.bound", F.lit(0.0))
    delta = F.when(has_direct & has_derived, F.col("direct.value") - F.col("derived"))
    near = F.abs(delta).cast("double") <= tolerance(bounds, F.col("direct.value"), F.col("derived"))
    method = (
        F.when(has_direct & has_derived & near, "DIRECT_CONFIRMED_BY_DERIVATION").when(has_direct & has_derived, "DIRECT_DERIVED_CONFLICT").when(has_direct, "DIRECT")
        .when(has_derived, F.concat(F.lit("DERIVED_Q"), F.col("fiscal_quarter").cast("string"))).otherwise("UNCONSTRUCTED")
    )
    missing = F.element_at(F.array(F.lit("MISSING_Q1_PARENT"), F.lit("MISSING_HALF_YEAR_PARENT"), F.lit("MISSING_NINE_MONTH_PARENT")), F.greatest(F.col("fiscal_quarter") - 1, F.lit(1)))
    rows = rows.withColumn("method", method).select(
        *KEYS,
        "fy_start",
        "fiscal_quarter",
        F.coalesce("direct.start", F.date_add("short.end", 1)).alias("q_start"),
        "q_end",
        F.when(F.col("method").isin("DIRECT", "DIRECT_CONFIRMED_BY_DERIVATION"), F.col("direct.value")).when(F.col("method").startswith("DERIVED"), F.col("derived")).alias("value"),
        "method",
        F.when(F.col("method") == "DIRECT", "PASS_DIRECT").when(F.col("method") == "DIRECT_CONFIRMED_BY_DERIVATION", "PASS_DIRECT_DERIVED_RECONCILED").when(F.col("method").startswith("DERIVED"), "PASS_DERIVED")
        .when(F.col("method") == "DIRECT_DERIVED_CONFLICT", "REVIEW_DIRECT_DERIVED_MISMATCH").otherwise("MISSING_COMPATIBLE_PARENTS").alias("status"),
        F.when(F.col("method") == "DIRECT_DERIVED_CONFLICT", "DIRECT_DERIVED_OUTSIDE_TOLERANCE").when((F.col("method") == "UNCONSTRUCTED") & F.col("short").isNotNull(), "INCOMPATIBLE_PARENT_BASIS").when(F.col("method") == "UNCONSTRUCTED", missing).alias("reason"),
        delta.alias("delta"),
        F.greatest("direct.available", "long.available", "short.available").alias("available"),
    )
    best = Window.partitionBy(*KEYS, "q_start", "q_end").orderBy(F.desc("available"), "fy_start", "fiscal_quarter")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def quarter_audit(quarters: DataFrame, least: int = 9) -> DataFrame:
    """Per issuer and concept: rows by outcome, span of the validated ones, and whether there are ``least`` of them."""
    good = F.col("status").startswith("PASS_") & F.col("value").isNotNull()
    return quarters.groupBy(*KEYS).agg(
        F.count_if(F.col("status") == "PASS_DIRECT").alias("direct"),
        F.count_if(F.col("status") == "PASS_DIRECT_DERIVED_RECONCILED").alias("reconciled"),
        F.count_if(F.col("status") == "PASS_DERIVED").alias("derived"),
        F.count_if(F.col("status") == "REVIEW_DIRECT_DERIVED_MISMATCH").alias("conflicts"),
        F.count_if(F.col("status") == "MISSING_COMPATIBLE_PARENTS").alias("missing"),
        F.min(F.when(good, F.col("q_end"))).alias("first_end"),
        F.max(F.when(good, F.col("q_end"))).alias("last_end"),
        F.when(F.count_if(good) >= least, "PASS_NINE_QUARTERS").otherwise("REVIEW_SHORT_HISTORY").alias("governance"),
    )


def ytd_identities(facts: DataFrame) -> DataFrame:
    """Fiscal years whose direct quarters are all there: each year-to-date fact against the sum of its quarters (identity_ok)."""
    one = one_parent(facts).withColumn("class", duration_class(F.col("start"), F.col("end")))
    long = one.where(F.col("class").isin("HALF_YEAR_YTD", "NINE_MONTH_YTD", "FISCAL_YEAR")).select(*KEYS, F.col("start").alias("fy_start"), F.col("end").alias("fy_end"), "class", F.col("value").alias("total"))
    quarter = one.where("class = 'QUARTER'").select(*KEYS, "start", "end", "value", F.year("start").alias("_y"))
    long = long.withColumn("_y", F.explode(F.sequence(F.year("fy_start"), F.year("fy_end"))))  # so that a year meets its own quarters alone
    inside = long.join(quarter, [*KEYS, "_y"]).where("start >= fy_start and end <= fy_end")
    need = F.when(F.col("class") == "HALF_YEAR_YTD", 2).when(F.col("class") == "NINE_MONTH_YTD", 3).otherwise(4)
    sums = inside.groupBy(*KEYS, "fy_start", "class", "total").agg(F.sum("value").alias("quarters_sum"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") == need)
    return sums.select(*KEYS, "fy_start", "class", (F.abs(F.col("total") - F.col("quarters_sum")) <= 1).alias("identity_ok"))
