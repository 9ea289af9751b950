"""Matching reported facts to the contexts that prove them, and resolving names to entities."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCH = ("accession", "local_concept", "start", "end", "value")


def match_contexts(candidates: DataFrame, inline: DataFrame) -> DataFrame:
    """Each candidate with its contexts by accession, concept, dates and exact decimal value.

    ``inline`` has the same keys with context_id and dimensions (a count); values are compared as
    decimals of one type. Adds context_id (one context, no dimensions), contexts and match: EXACT,
    NO_MATCH, ONLY_DIMENSIONED or MULTIPLE_DEFAULT_CONTEXTS. Repeated facts of one context count once.
    """
    told = F.col("context_id")
    proofs = inline.select(*MATCH, told.alias("_any"), F.when(F.col("dimensions") == 0, told).alias("_plain"), F.lit(True).alias("_seen"))
    # both sides lie in one ordering, so that no pair is formed and rows that lie together by accession need not move
    rows = candidates.withColumn("_own", F.lit(True)).unionByName(proofs, allowMissingColumns=True)
    group = Window.partitionBy(*MATCH)
    least, most = F.min("_plain").over(group), F.max("_plain").over(group)
    rows = rows.select("*", least.alias("_least"), most.alias("_most"), F.max("_seen").over(group).alias("_met"), F.size(F.collect_set("_any").over(group)).cast("long").alias("_contexts")).where("_own")
    met = reduce(and_, [F.col(c).isNotNull() for c in MATCH], F.coalesce("_met", F.lit(False)))  # nulls match nothing
    match = F.when(~met, "NO_MATCH").when(F.col("_least").isNull(), "ONLY_DIMENSIONED").when(F.col("_least") != F.col("_most"), "MULTIPLE_DEFAULT_CONTEXTS").otherwise("EXACT")
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in candidates.schema if f.name not in ("match", "context_id", "contexts")]
    return rows.select(*kept, F.when(met, F.col("_contexts")).otherwise(0).alias("contexts"), match.alias("match"), F.when(match == "EXACT", F.col("_least")).alias("context_id"))


def map_concepts(facts: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Attach canonical concept and priority from a mapping; an issuer's own rule replaces the standard one. Spark broadcasts small mappings by their size."""
    rows = facts.join(mapping, "taxonomy_concept", "left")
    if overrides is not None:
        own = overrides.select("issuer", "taxonomy_concept", F.col("canonical_concept").alias("_c"), F.col("priority").alias("_p"))
        rows = rows.join(own, ["issuer", "taxonomy_concept"], "left")
        rows = rows.withColumn("canonical_concept", F.coalesce("_c", "canonical_concept")).withColumn("priority", F.coalesce("_p", "priority")).drop("_c", "_p")
    return rows.where("canonical_concept is not null")


def resolve_identity(requests: DataFrame, symbols: DataFrame, symbol: str = "symbol", entity: str = "entity") -> DataFrame:
    """Each request with its entity if there is just one, and resolution RESOLVED, UNKNOWN or AMBIGUOUS."""
    known = symbols.select(symbol, entity).distinct().groupBy(symbol).agg(F.count(F.lit(1)).alias("candidates"), F.min(entity).alias("_e"))
    rows = requests.join(known, symbol, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    resolution = F.when(F.col("candidates") == 0, "UNKNOWN").when(F.col("candidates") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return rows.withColumn("resolution", resolution).withColumn(entity, F.when(F.col("candidates") == 1, F.col("_e"))).drop("_e")


def select_requested(requests: DataFrame, results: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Every requested row in the order asked for (column pos); those without a result are explicitly UNSCORED."""
    rows = requests.join(results.withColumn("_found", F.lit(True)), key, "left")
    return rows.withColumn(status, F.when(F.col("_found").isNull(), "UNSCORED").otherwise(F.col(status))).drop("_found")


def batch_slices(members: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Add position and batch: fixed-size slices of each group in order; ties of ``order`` and nulls first, in any order among themselves.

    Rows are dealt into ranges of (group, order) and settled there; positions are counted inside a range and shifted
    by the rows of the group's ranges before it, so a group of any size is numbered by many tasks.
    """
    from vintara.plans.settle import settle

    ranged = settle(members.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order, "_row"))
    rows = ranged.withColumn("_inside", inside).join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn("position", (F.col("_before") + F.col("_inside")).cast("int")).withColumn("batch", F.ceil(F.col("position") / size).cast("int")).drop("_range", "_row", "_g", "_r", "_before", "_inside")


def membership_audit(holdings: DataFrame, requests: DataFrame, as_of: str, model_date: str, *, symbol: str = "symbol", max_age_days: int = 14) -> DataFrame:
    """(symbol, status, requested) of every holding and of every requested symbol that is no candidate.

    ``holdings`` has a class (see ``landing.holding_classes``). Those of class CANDIDATE are peers, the others keep their
    class. A requested symbol without a peer is REQUESTED_NOT_IN_PROXY, whatever other class a holding of that name has. A source dated after
    the model date is a look-ahead and one older than ``max_age_days`` is stale: either fails the job.
    """
    age = F.date_diff(F.lit(model_date).cast("date"), F.lit(as_of).cast("date"))
    sure = F.when(age < 0, F.raise_error(F.lit("holdings are dated after the model date"))).when(age > max_age_days, F.raise_error(F.lit("holdings are too old for the model date"))).otherwise(F.lit(True))
    asked = requests.select(F.col(symbol)).distinct().withColumn("_asked", F.lit(True))
    rows = holdings.where(sure).select(symbol, F.when(F.col("class") == "CANDIDATE", "PEER_CANDIDATE").otherwise(F.col("class")).alias("status"))
    held = rows.join(asked, symbol, "left").select(symbol, "status", F.coalesce("_asked", F.lit(False)).alias("requested"))
    lacking = asked.join(rows.where("status = 'PEER_CANDIDATE'"), symbol, "left_anti")
    return held.unionByName(lacking.select(symbol, F.lit("REQUESTED_NOT_IN_PROXY").alias("status"), F.lit(True).alias("requested")))
