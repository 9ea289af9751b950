"""Weighted scores with coverage: missing evidence carries no weight and never counts as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import ADVERSE, CONFLICTED, NEUTRAL, SUPPORTIVE, safe_ratio
from vintara.plans import policy


def component_table(scores: DataFrame, components: DataFrame, keys: tuple[str, ...] = ("issuer",), entities: DataFrame | None = None) -> DataFrame:
    """Every entity with every component (the small side is broadcast) and its score where there is one: original and applied weight.

    ``entities`` has the keys of all entities; by default they are those with any score.
    """
    grid = (scores if entities is None else entities).select(*keys).distinct().crossJoin(F.broadcast(components))
    rows = grid.join(scores.select(*keys, "input_id", "score"), [*keys, "input_id"], "left")
    return rows.withColumn("applied", F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(F.lit(0.0)))


def reweight_quarter_factor(rows: DataFrame, keys: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """The one allowed shift of weight: without gross profit, revenue and operating income of F2 count half each."""
    has = lambda name: F.max(F.when((F.col("input_id") == name) & F.col("score").isNotNull(), 1).otherwise(0))
    flags = rows.where("factor = 'F2_QUARTER'").groupBy(*keys).agg(has("revenue_q_yoy").alias("_r"), has("operating_income_q_yoy").alias("_o"), has("gross_profit_q_yoy").alias("_g"))
    half = (F.col("factor") == "F2_QUARTER") & F.col("input_id").isin("revenue_q_yoy", "operating_income_q_yoy") & (F.col("_r") == 1) & (F.col("_o") == 1) & (F.col("_g") == 0)
    return rows.join(flags, list(keys), "left").withColumn("applied", F.when(half, F.lit(0.5)).otherwise(F.col("applied"))).drop("_r", "_o", "_g")


def check_cap(rows: DataFrame, cap: float = policy.WEIGHT_CAP) -> DataFrame:
    """Fail the job if an applied weight exceeds the cap or a missing score carries weight."""
    bad = (F.col("applied") < 0) | (F.col("applied") > F.col("weight") * cap + 1e-12) | ((F.col("applied") > 0) & F.col("score").isNull())
    return rows.withColumn("applied", F.when(bad, F.raise_error(F.lit("applied weight breaks the cap or lacks a score"))).otherwise(F.col("applied")))


def factor_scores(rows: DataFrame, keys: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """Per entity and factor: score over the observed weight, original and applied coverage, families and whether its floor is met."""
    has = lambda name: F.max(F.when((F.col("input_id") == name) & F.col("score").isNotNull(), 1).otherwise(0)) == 1
    out = rows.groupBy(*keys, "factor").agg(
        F.sum(F.col("applied") * F.coalesce("score", F.lit(0.0))).alias("_num"),
        F.sum("applied").alias("applied_coverage"),
        F.sum(F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(0.0)).alias("original_coverage"),
        F.array_sort(F.collect_set(F.when(F.col("score").isNotNull(), F.col("family")))).alias("families"),
        has("revenue_ttm_yoy").alias("_rt"), has("operating_income_ttm_yoy").alias("_ot"), has("revenue_q_yoy").alias("_rq"), has("operating_income_q_yoy").alias("_oq"),
        has("operating_margin_yoy_pp").alias("_om"), has("fcf_margin_yoy_pp").alias("_fm"),
    )
    eps = 1e-9
    independent = F.size(F.array_except("families", F.array(F.lit("CROSS_FAMILY"))))
    floor = (
        F.when(F.col("factor") == "F1_TTM", F.col("_rt") & F.col("_ot") & F.array_contains("families", "CASH") & (F.col("original_coverage") >= 0.60 - eps))
        .when(F.col("factor") == "F2_QUARTER", F.col("_rq") & F.col("_oq") & (F.col("applied_coverage") >= 0.90 - eps))
        .when(F.col("factor") == "F3_QUALITY", F.col("_om") & F.col("_fm") & (F.col("original_coverage") >= 0.50 - eps))
        .otherwise((independent >= 2) & (F.col("original_coverage") >= 0.40 - eps))
    )
    return out.select(*keys, "factor", safe_ratio(F.col("_num"), F.col("applied_coverage")).alias("factor_score"), "original_coverage", "applied_coverage", (1 - F.col("applied_coverage")).alias("residual_weight"), "families", floor.alias("floor_met"))


def weighted_scores(scores: DataFrame, components: DataFrame, keys: tuple[str, ...] = ("issuer",), entities: DataFrame | None = None) -> DataFrame:
    """``factor_scores`` of the reweighted components of every entity, in one grouping of the scores that are there.

    A missing score only matters as weight that is not there, so no row is made for it: the shift of F2's
    weight is decided over an entity's own rows, and an entity without any score of a factor gets the factor's empty row at the end.
    ``entities`` has the keys of all entities; by default they are those with any score.
    """
    every = Window.partitionBy(*keys)
    there = lambda name: F.max((F.col("input_id") == name).cast("int")).over(every) == 1
    rows = scores.where(F.col("score").isNotNull()).select(*keys, "input_id", "score").join(F.broadcast(components), "input_id")
    half = (F.col("factor") == "F2_QUARTER") & F.col("input_id").isin("revenue_q_yoy", "operating_income_q_yoy") & there("revenue_q_yoy") & there("operating_income_q_yoy") & ~there("gross_profit_q_yoy")
    found = factor_scores(check_cap(rows.withColumn("applied", F.when(half, F.lit(0.5)).otherwise(F.col("weight")))), keys)
    grid = (scores if entities is None else entities).select(*keys).distinct().crossJoin(F.broadcast(components.select("factor").distinct()))
    zero = F.lit(0.0)
    return grid.join(found, [*keys, "factor"], "left").select(
        *keys, "factor", "factor_score", F.coalesce("original_coverage", zero).alias("original_coverage"), F.coalesce("applied_coverage", zero).alias("applied_coverage"), F.coalesce("residual_weight", F.lit(1.0)).alias("residual_weight"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("floor_met", F.lit(False)).alias("floor_met"),
    )


def scores_of_row(score: dict[str, Column], components: tuple[tuple[str, str, float, str], ...] = policy.COMPONENTS) -> dict[str, Column]:
    """``weighted_scores`` where an entity's scores are columns of its row: per factor a struct of what that has but the residual weight.

    Nothing is exchanged or grouped. An input without a column is missing.
    """
    has = {n: c.isNotNull() for n, c in score.items()}
    there = lambda n: has.get(n, F.lit(False))
    half = there("revenue_q_yoy") & there("operating_income_q_yoy") & ~there("gross_profit_q_yoy")
    total = lambda parts: sum(parts, F.lit(0.0))
    out = {}
    for factor in dict.fromkeys(f for f, *_ in components):
        own = [(n, w, family) for f, n, w, family in components if f == factor and n in score]
        shifted = {n for n, *_ in own if factor == "F2_QUARTER" and n in ("revenue_q_yoy", "operating_income_q_yoy")}
        if any(0.5 > w * policy.WEIGHT_CAP + 1e-12 for n, w, _ in own if n in shifted):
            raise ValueError("applied weight breaks the cap")
        applied = {n: F.when(has[n], F.when(half, 0.5).otherwise(w) if n in shifted else F.lit(w)).otherwise(0.0) for n, w, _ in own}
        original, used = total(F.when(has[n], w).otherwise(0.0) for n, w, _ in own), total(applied.values())
        points = total(applied[n] * F.coalesce(score[n], F.lit(0.0)) for n, *_ in own)
        kinds = {family: reduce(Column.__or__, [has[n] for n, _, k in own if k == family]) for family in dict.fromkeys(k for *_, k in own)}
        independent = sum((c.cast("int") for k, c in kinds.items() if k != "CROSS_FAMILY"), F.lit(0))
        eps = 1e-9
        floor = {
            "F1_TTM": there("revenue_ttm_yoy") & there("operating_income_ttm_yoy") & kinds.get("CASH", F.lit(False)) & (original >= 0.60 - eps),
            "F2_QUARTER": there("revenue_q_yoy") & there("operating_income_q_yoy") & (used >= 0.90 - eps),
            "F3_QUALITY": there("operating_margin_yoy_pp") & there("fcf_margin_yoy_pp") & (original >= 0.50 - eps),
        }.get(factor, (independent >= 2) & (original >= 0.40 - eps))
        families = F.array_compact(F.array(*[F.when(kinds[k], k) for k in sorted(kinds)])) if kinds else F.array().cast("array<string>")
        out[factor] = F.struct(safe_ratio(points, used).alias("factor_score"), original.alias("original_coverage"), used.alias("applied_coverage"), families.alias("families"), floor.alias("floor_met"))
    return out


def breadth(classes: DataFrame, conflict: str | float = 0.25, keys: tuple[str, ...] = ("issuer",), least: int = 3) -> DataFrame:
    """Per entity: mean value of eligible family classes times 100, null below ``least`` families. ``conflict`` is a value or a column."""
    worth = F.col(conflict) if isinstance(conflict, str) else F.lit(conflict)
    value = F.when(F.col("class") == SUPPORTIVE, 1.0).when(F.col("class") == NEUTRAL, 0.5).when(F.col("class") == ADVERSE, 0.0).when(F.col("class") == CONFLICTED, worth)
    rows = classes.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("families"))
    return rows.select(*keys, "families", F.when(F.col("families") >= least, 100.0 * F.col("_s") / F.col("families")).alias("breadth_score"))


def breadth_of_row(classes: list[Column], conflict: float = 0.25, least: int = 3) -> dict[str, Column]:
    """families and breadth_score as in ``breadth``, of family classes that lie in one row."""
    worth = lambda c: F.when(c == SUPPORTIVE, 1.0).when(c == NEUTRAL, 0.5).when(c == ADVERSE, 0.0).when(c == CONFLICTED, F.lit(conflict))
    n = sum((worth(c).isNotNull().cast("long") for c in classes), F.lit(0).cast("long"))
    points = sum((F.coalesce(worth(c), F.lit(0.0)) for c in classes), F.lit(0.0))
    return {"families": n, "breadth_score": F.when(n >= least, F.try_divide(100.0 * points, n))}


def persistence_candidates(scores: DataFrame, scenarios: DataFrame, keys: tuple[str, ...] = ("issuer",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Each entity under each scenario: score and coverage of the persistence sleeve.

    ``scores`` is wide: the keys and a column per concept. Revenue and operating income are needed,
    under the strict scenario all four; a missing cash concept keeps its weight unused. ``keep`` names columns that go along.
    """
    four = ("revenue", "operating_income", "cash_from_operations", "free_cash_flow")
    rows = scores.crossJoin(F.broadcast(scenarios))
    weight = {"revenue": F.col("w_revenue"), "operating_income": F.col("w_profit"), "cash_from_operations": F.col("w_cash") * F.col("cfo_share"), "free_cash_flow": F.col("w_cash") * (1 - F.col("cfo_share"))}
    has = {c: F.col(c).isNotNull() for c in four}
    passed = has["revenue"] & has["operating_income"] & (~F.col("strict") | (has["cash_from_operations"] & has["free_cash_flow"]))
    zero = F.lit(0.0)
    total = F.col("w_revenue") + F.col("w_profit") + F.col("w_cash")
    used = sum((F.when(has[c], weight[c]).otherwise(zero) for c in four), zero)
    points = sum((F.when(has[c], weight[c] * F.col(c)).otherwise(zero) for c in four), zero)
    return rows.select(*keys, *keep, "scenario", passed.alias("passed"), F.when(passed, points / used).alias("persistence_score"), F.when(passed, used / total).otherwise(zero).alias("persistence_coverage"))


def merge_persistence(factors: DataFrame, candidates: DataFrame, share: float = 0.15, keys: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """Per entity and scenario: the acceleration factor with its persistence sleeve, total coverage, composite and hold reason.

    ``factors`` is wide: the keys, a column per factor, f4_applied, base_coverage (weighted coverage of
    the other factors) and allowed. The composite needs all factors and a coverage of 0.70.
    """
    return merged_persistence(factors.join(candidates, list(keys)), share, keys)


def merged_persistence(rows: DataFrame, share: float = 0.15, keys: tuple[str, ...] = ("issuer",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``merge_persistence`` of rows that have both sides' columns; those in ``keep`` go along."""
    publish = F.col("allowed") & F.col("passed")
    sleeve = F.when(publish, share * F.col("persistence_coverage")).otherwise(0.0)
    rows = rows.withColumn("f4_coverage", F.col("f4_applied") + sleeve)
    f4 = F.when(publish, (F.col("F4_ACCELERATION") * F.col("f4_applied") + F.col("persistence_score") * sleeve) / F.col("f4_coverage"))
    rows = rows.withColumn("f4_score", f4).withColumn("total_coverage", F.col("base_coverage") + policy.FACTOR_WEIGHTS["F4_ACCELERATION"] * F.col("f4_coverage"))
    parts = {**{f: F.col(f) for f in policy.FACTOR_WEIGHTS if f != "F4_ACCELERATION"}, "F4_ACCELERATION": F.col("f4_score")}
    score = sum((policy.FACTOR_WEIGHTS[f] * parts[f] for f in policy.FACTOR_WEIGHTS), F.lit(0.0))
    composite = F.when(publish & (F.col("total_coverage") >= policy.TOTAL_FLOOR - 1e-9), score)
    hold = F.when(~F.col("allowed"), "EXISTING_COMPANY_HOLD").when(~F.col("passed"), "PERSISTENCE_HISTORY_INCOMPLETE").when(composite.isNull(), "TOTAL_COVERAGE_BELOW_70_PERCENT")
    return rows.select(*keys, *keep, "scenario", "f4_score", "f4_coverage", "total_coverage", composite.alias("composite"), hold.alias("hold_reason"))


def confidence(evidence: DataFrame) -> DataFrame:
    """Bounds of confidence from coverage, derived_q4 and stale: six weighted components, two of them unknown within limits."""
    w = policy.CONFIDENCE_WEIGHTS
    cover = F.least(F.lit(100.0), 100.0 * F.col("coverage") / 0.85)
    period, timely = F.when(F.col("derived_q4"), 98.0).otherwise(100.0), F.when(F.col("stale"), 85.0).otherwise(100.0)
    fixed = w["source_authority"] * 100.0 + w["period_integrity"] * period + w["comparability_timeliness"] * timely + w["metric_factor_coverage"] * cover
    return evidence.withColumn("confidence_low", fixed).withColumn("confidence_high", fixed + w["point_in_time"] * 95.0 + w["denominator_definition"] * 100.0)


def peer_coverage(inputs: DataFrame, least: int) -> DataFrame:
    """Distinct eligible issuers per input and transformation, never pooled, with whether they suffice."""
    rows = inputs.where("eligible").groupBy("input_id", "transformation").agg(F.count_distinct("issuer").alias("peers"))
    return rows.withColumn("coverage", F.when(F.col("peers") >= least, "PASS").otherwise("PEER_GROUP_INSUFFICIENT"))


def company_coverage(inputs: DataFrame, components: DataFrame) -> DataFrame:
    """Per issuer and factor: weight of eligible components; absent components count 0 and every factor has a row."""
    grid = inputs.select("issuer").distinct().crossJoin(F.broadcast(components))
    have = inputs.where("eligible").select("issuer", "input_id", F.lit(1).alias("_have")).distinct()
    return grid.join(have, ["issuer", "input_id"], "left").groupBy("issuer", "factor").agg(F.sum(F.when(F.col("_have") == 1, F.col("weight")).otherwise(0.0)).alias("coverage"))


def acquisition_coverage(facts: DataFrame, issuers: DataFrame, concepts: DataFrame, errors: DataFrame) -> DataFrame:
    """Every issuer with every concept: number of facts, distinct accessions and distinct periods (start, end), 0 where there are none, and the status.

    ``errors`` lists the issuers whose download failed.
    """
    grid = issuers.select("issuer").distinct().crossJoin(F.broadcast(concepts.select("concept").distinct()))
    counts = facts.groupBy("issuer", "concept").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("accession").alias("accessions"), F.count_distinct(F.struct("start", "end")).alias("periods"))
    rows = grid.join(counts, ["issuer", "concept"], "left").join(errors.select("issuer", F.lit(True).alias("_failed")).distinct(), "issuer", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("facts", "accessions", "periods")}
    status = F.when(F.col("_failed"), "DOWNLOAD_FAILED").when(n["facts"] == 0, "MISSING_STANDARD_TAG_CANDIDATE").otherwise("ACQUIRED_REQUIRES_INLINE_CONTEXT_REVIEW")
    return rows.select("issuer", "concept", *[v.alias(c) for c, v in n.items()], status.alias("acquisition_status"))


def factor_coverage(companies: DataFrame, factors: DataFrame, least: int) -> DataFrame:
    """Every factor with the number of issuers that meet its floor (issuer, factor, floor_met) and whether they suffice."""
    met = companies.where("floor_met").groupBy("factor").agg(F.count_distinct("issuer").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return factors.select("factor").distinct().join(met, "factor", "left").select("factor", n.alias("companies"), F.when(n >= least, "PASS").otherwise("PEER_GROUP_INSUFFICIENT").alias("coverage"))


def sleeve_coverage(inputs: DataFrame, sleeves: DataFrame, keys: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """Per entity and factor: the sum of the weights of sleeves of which enough inputs are there; every factor has a row.

    ``inputs`` has the keys, input_id and present; ``sleeves`` has factor, sleeve, input_id and weight,
    the weight being the sleeve's own and the same for each of its inputs, and may have needed (how many of the inputs, default 1).
    """
    rules = sleeves if "needed" in sleeves.columns else sleeves.withColumn("needed", F.lit(1))
    entities = inputs.select(*keys).distinct()
    there = inputs.where("present").select(*keys, "input_id").distinct().join(F.broadcast(rules), "input_id")
    filled = there.groupBy(*keys, "factor", "sleeve").agg(F.count(F.lit(1)).alias("_n"), F.max("weight").alias("weight"), F.max("needed").alias("needed")).where("_n >= needed")
    summed = filled.groupBy(*keys, "factor").agg(F.sum("weight").alias("_c"))
    every = entities.crossJoin(F.broadcast(rules.select("factor").distinct()))
    return every.join(summed, [*keys, "factor"], "left").select(*keys, "factor", F.coalesce("_c", F.lit(0.0)).alias("coverage"))


def complete_sum(rows: DataFrame, keys: tuple[str, ...], needed: tuple[str, ...], component: str = "component", value: str = "value") -> DataFrame:
    """Sum over components, null unless every needed one is there, with the list of those that are missing."""
    out = rows.groupBy(*keys).agg(F.sum(value).alias("_s"), F.collect_set(component).alias("_c"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in needed]), "_c"))
    return out.select(*keys, F.when(F.size(missing) == 0, F.col("_s")).alias("total"), F.array_join(missing, "|").alias("missing"))
