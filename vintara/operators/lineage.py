"""Where values come from: parents collected, joined back, and checked against the filings they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_parents(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], value: str, available: str = "available") -> DataFrame:
    """Per key: sum of a value, the parents as a sorted array of structs, their sorted distinct ids, and the latest knowledge date."""
    return rows.groupBy(*keys).agg(
        F.sum(value).alias(value),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("parents"),
        F.array_sort(F.collect_set(fields[0])).alias("parent_ids"),
        F.max(available).alias("signal_available"),
        F.count(F.lit(1)).alias("parent_count"),
    )


def cite_once(rows: DataFrame, source: DataFrame, keys: tuple[str, ...], value: str, source_value: str) -> DataFrame:
    """Each row with how many source rows it cites and lineage: PASS for exactly one of equal value, else what is wrong."""
    found = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("sources"), F.max(source_value).alias("_v"))
    out = rows.join(found, list(keys), "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    state = F.when(F.col("sources") == 0, "NO_SOURCE").when(F.col("sources") > 1, "SEVERAL_SOURCES").when(F.col(value).eqNullSafe(F.col("_v")), "PASS").otherwise("VALUE_MISMATCH")
    return out.withColumn("lineage", state).drop("_v")


def audit_parents(rows: DataFrame, filings: DataFrame, model_date: str) -> DataFrame:
    """One row per cited parent: the filing behind it and whether it was knowable on the model date."""
    cited = rows.select("issuer", F.explode("parent_ids").alias("accession")).distinct()
    known = cited.join(filings.select("accession", "available"), "accession", "left")
    day = F.lit(model_date).cast("date")
    return known.withColumn("vintage", F.when(F.col("available").isNull(), "MISSING_VINTAGE").when(F.col("available") > day, "FUTURE_FILING").otherwise("PASS_KNOWABLE_AT_MODEL_DATE"))


def company_summary(parents: DataFrame) -> DataFrame:
    return parents.groupBy("issuer").agg(F.count(F.lit(1)).alias("parents"), F.count_if(F.col("vintage") != "PASS_KNOWABLE_AT_MODEL_DATE").alias("failures"))
