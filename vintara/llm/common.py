"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.plans.settle import settle as cut
from vintara.plans.settle import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read the Parquet table ``name`` and keep ``columns`` (all when none are named)."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def null_safe(left: DataFrame, right: DataFrame, *names: str):
    """A join condition that also matches null with null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


__all__ = ["cut", "null_safe", "shared_folder", "table"]
