"""Nested facts from JSON text whose taxonomies, concepts, units and fields nobody has listed beforehand, as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_FIELDS = ("accn", "start", "end", "val", "form", "filed")


def _explode(rows: DataFrame, value: Column, *names: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for each member of an object or item of an array, under ``names`` (key or place, value); other values give none."""
    spark, outer = rows.sparkSession, F.col("_walk").outer()
    walked = rows.withColumn("_walk", value).lateralJoin(spark.tvf.variant_explode(outer))
    return walked.select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias(names[0]), F.col("value").alias(names[1]))


def _is_object(value: Column) -> Column:
    """Whether a variant is an object, told without a walk through what lies in it."""
    return F.try_variant_get(value, "$", "struct<_none: variant>").isNotNull()


def _is_array(value: Column) -> Column:
    """Whether a variant is an array, told by its first item; only what has none is looked at as text."""
    return F.try_variant_get(value, "$[0]", "variant").isNotNull() | F.coalesce(F.to_json(value) == "[]", F.lit(False))


def variant_facts(documents: DataFrame, key: str, text: str = "json", root: str = "$.facts") -> tuple[DataFrame, DataFrame]:
    """(facts, rejects) of documents {facts: {taxonomy: {concept: {units: {unit: [observation, ...]}}}}}.

    facts: key, taxonomy, concept, unit, place, accession, start, end, value (DECIMAL(28,4)), form,
    filed and extra, the names of fields beyond the known ones. Numbers may be given as text. Nothing is dropped in silence:
    rejects has key, path and problem for what is no fact. Problems: NOT_JSON, NO_FACTS (nothing
    at ``root``), NOT_AN_OBJECT (a taxonomy, concept, or its units), NOT_A_LIST (a unit), NOT_AN_OBSERVATION, NO_ACCESSION,
    BAD_END, BAD_VALUE; of several the first in this order. Empty objects and lists give nothing. A null text is NOT_JSON.
    """
    parsed = documents.select(F.col(key).alias("_key"), F.try_parse_json(text).alias("_doc")).withColumn("_facts", F.try_variant_get("_doc", root, "variant"))
    at_root = F.when(F.col("_doc").isNull(), "NOT_JSON").when(F.col("_facts").isNull(), "NO_FACTS").when(~_is_object(F.col("_facts")), "NOT_AN_OBJECT")
    top = parsed.withColumn("problem", at_root)
    rejects = [top.where("problem is not null").select("_key", F.lit(root).alias("path"), "problem")]
    path = F.lit(root)

    def step(rows: DataFrame, value: Column, name: str, keep: tuple[str, ...], needed: Callable[[Column], Column], problem: str) -> DataFrame:
        """Members of ``value``; those whose value is not of the needed kind become rejects."""
        nonlocal path
        found = _explode(rows, value, name, "_v", keep=keep)
        path = F.concat(path, F.lit("."), F.col(name))
        right = needed(F.col("_v"))
        rejects.append(found.where(~right).select("_key", path.alias("path"), F.lit(problem).alias("problem")))
        return found.where(right)

    taxonomies = step(top.where("problem is null"), F.col("_facts"), "taxonomy", ("_key",), _is_object, "NOT_AN_OBJECT")
    concepts = step(taxonomies, F.col("_v"), "concept", ("_key", "taxonomy"), _is_object, "NOT_AN_OBJECT")
    held = concepts.withColumn("_units", F.try_variant_get("_v", "$.units", "variant"))
    no_units = F.coalesce(_is_object(F.col("_units")), F.lit(False))
    rejects.append(held.where(~no_units).select("_key", F.concat(path, F.lit(".units")).alias("path"), F.lit("NOT_AN_OBJECT").alias("problem")))
    path = F.concat(path, F.lit(".units"))
    units = step(held.where(no_units), F.col("_units"), "unit", ("_key", "taxonomy", "concept"), _is_array, "NOT_A_LIST")
    seen = _explode(units, F.col("_v"), "place", "_v", keep=("_key", "taxonomy", "concept", "unit"))
    # one pass gives an observation's fields as text, known or not
    seen = seen.select("_key", "taxonomy", "concept", "unit", "place", F.try_variant_get("_v", "$", "map<string,string>").alias("_m"))
    get = lambda name: F.col("_m")[name]
    fields = seen.select(
        "_key", "taxonomy", "concept", "unit", F.col("place").cast("int").alias("place"), F.col("_m").isNotNull().alias("_whole"), get("accn").alias("accession"), get("start").try_cast("date").alias("start"), get("end").try_cast("date").alias("end"),
        F.trim(get("val")).try_cast("decimal(28,4)").alias("value"), get("form").alias("form"), get("filed").try_cast("date").alias("filed"), F.array_except(F.map_keys("_m"), F.array(*[F.lit(n) for n in KNOWN_FIELDS])).alias("extra"),
    )
    problem = F.when(~F.col("_whole"), "NOT_AN_OBSERVATION").when(F.coalesce(F.trim("accession"), F.lit("")) == "", "NO_ACCESSION").when(F.col("end").isNull(), "BAD_END").when(F.col("value").isNull(), "BAD_VALUE")
    judged = fields.withColumn("problem", problem)
    rejects.append(judged.where("problem is not null").select("_key", F.concat(path, F.lit("."), F.col("place").cast("string")).alias("path"), "problem"))
    out = rejects[0]
    for part in rejects[1:]:
        out = out.unionByName(part)
    return judged.where("problem is null").drop("problem", "_whole").withColumnRenamed("_key", key), out.withColumnRenamed("_key", key)
