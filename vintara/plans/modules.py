"""Metric modules as data: what a metric is made of is rows of a relation, so a further metric is a row more and no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (module, metric, side, concept, basis, sign). A metric is the signed sum of its upper terms over that of its lower ones.
TERMS = (
    ("OPERATING", "OPERATING_MARGIN", "upper", "operating_income", "ttm", 1),
    ("OPERATING", "OPERATING_MARGIN", "lower", "revenue", "ttm", 1),
    ("OPERATING", "FCF_MARGIN", "upper", "cash_from_operations", "ttm", 1),
    ("OPERATING", "FCF_MARGIN", "upper", "capital_expenditures", "ttm", -1),
    ("OPERATING", "FCF_MARGIN", "lower", "revenue", "ttm", 1),
    ("OPERATING", "CAPEX_INTENSITY", "upper", "capital_expenditures", "ttm", 1),
    ("OPERATING", "CAPEX_INTENSITY", "lower", "revenue", "ttm", 1),
    ("BANK", "EFFICIENCY_RATIO", "upper", "revenue", "ttm", 1),
    ("BANK", "EFFICIENCY_RATIO", "upper", "operating_income", "ttm", -1),
    ("BANK", "EFFICIENCY_RATIO", "lower", "revenue", "ttm", 1),
    ("BANK", "NET_CHARGE_OFF_RATE", "upper", "returned", "ttm", 1),
    ("BANK", "NET_CHARGE_OFF_RATE", "lower", "open_lines", "average", 1),
    ("BANK", "PREPROVISION_YIELD", "upper", "operating_income", "ttm", 1),
    ("BANK", "PREPROVISION_YIELD", "upper", "returned", "ttm", 1),
    ("BANK", "PREPROVISION_YIELD", "lower", "open_lines", "average", 1),
    ("INSURER", "LOSS_RATIO", "upper", "returned", "ttm", 1),
    ("INSURER", "LOSS_RATIO", "lower", "revenue", "ttm", 1),
    ("INSURER", "EXPENSE_RATIO", "upper", "rebates", "ttm", 1),
    ("INSURER", "EXPENSE_RATIO", "lower", "revenue", "ttm", 1),
    ("INSURER", "COMBINED_RATIO", "upper", "returned", "ttm", 1),
    ("INSURER", "COMBINED_RATIO", "upper", "rebates", "ttm", 1),
    ("INSURER", "COMBINED_RATIO", "lower", "revenue", "ttm", 1),
    ("ASSET_MANAGER", "FEE_RATE", "upper", "cash_from_operations", "ttm", 1),
    ("ASSET_MANAGER", "FEE_RATE", "lower", "open_lines", "average", 1),
    ("ASSET_MANAGER", "ORGANIC_GROWTH_RATE", "upper", "opened", "ttm", 1),
    ("ASSET_MANAGER", "ORGANIC_GROWTH_RATE", "upper", "closed", "ttm", -1),
    ("ASSET_MANAGER", "ORGANIC_GROWTH_RATE", "lower", "open_lines", "beginning", 1),
    ("REIT", "INTEREST_BURDEN", "upper", "rebates", "ttm", 1),
    ("REIT", "INTEREST_BURDEN", "lower", "operating_income", "ttm", 1),
    ("REIT", "INTEREST_BURDEN", "lower", "rebates", "ttm", 1),
)
#: (metric, unit, scale, direction): 1 higher is better, -1 lower, 0 conditional.
METRICS = (
    ("OPERATING_MARGIN", "pp", 100.0, 1), ("FCF_MARGIN", "pp", 100.0, 1), ("CAPEX_INTENSITY", "pp", 100.0, 0), ("EFFICIENCY_RATIO", "bp", 10_000.0, -1), ("NET_CHARGE_OFF_RATE", "bp", 10_000.0, -1), ("PREPROVISION_YIELD", "bp", 10_000.0, 1),
    ("LOSS_RATIO", "bp", 10_000.0, -1), ("EXPENSE_RATIO", "bp", 10_000.0, -1), ("COMBINED_RATIO", "bp", 10_000.0, -1), ("FEE_RATE", "bp", 10_000.0, 1), ("ORGANIC_GROWTH_RATE", "pp", 100.0, 1), ("INTEREST_BURDEN", "pp", 100.0, -1),
)


def formulas(spark: SparkSession) -> DataFrame:
    """One row a term, with its metric's unit, scale and direction and how many terms the metric has."""
    terms = spark.createDataFrame(TERMS, "module string, metric string, side string, concept string, basis string, sign int")
    told = spark.createDataFrame(METRICS, "metric string, unit string, scale double, direction int")
    return terms.join(told, "metric").join(terms.groupBy("metric").agg(F.count(F.lit(1)).alias("terms")), "metric")


def evaluate(values: DataFrame, members: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("issuer", "q_end"), entity: str = "issuer") -> DataFrame:
    """(keys, module, metric, unit, value, aligned) for every metric of the module that an entity belongs to.

    ``values`` is long: keys, concept, basis, value, one row each. ``members`` gives each entity's module, where ``values`` does not have it already, and
    ``table`` is like ``formulas``, a relation of fixed size, which is broadcast. One join and one
    aggregation work out all metrics. A metric with a missing term, or over a zero, has no row. aligned is the value with higher always
    better, null where that is conditional.
    """
    placed = values.where("value is not null")
    if "module" not in values.columns:
        placed = placed.join(members.select(entity, "module"), entity)
    terms = placed.join(F.broadcast(table.select("module", "metric", "side", "concept", "basis", "sign")), ["module", "concept", "basis"])
    side = lambda name: F.sum(F.when(F.col("side") == name, F.col("sign") * F.col("value").cast("double")))
    summed = terms.groupBy(*keys, "module", "metric").agg(side("upper").alias("_upper"), side("lower").alias("_lower"), F.count(F.lit(1)).alias("_found"))
    summed = summed.join(F.broadcast(table.select("module", "metric", "terms", "unit", "scale", "direction").distinct()), ["module", "metric"])
    whole = summed.where(F.col("_found") == F.col("terms")).withColumn("value", F.try_divide(F.col("_upper"), F.col("_lower")) * F.col("scale")).where("value is not null")
    return whole.select(*keys, "module", "metric", "unit", "value", F.when(F.col("direction") != 0, F.col("value") * F.col("direction")).alias("aligned"))
