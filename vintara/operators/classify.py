"""Classes with a fixed precedence: status, publication gate, bands, data status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.scalars import ADVERSE, CONFLICTED, INELIGIBLE, NEUTRAL, SUPPORTIVE, first_reason


def direction_index(families: Column) -> tuple[Column, dict[str, Column], Column]:
    """(index, counts, eligible): (supportive - adverse) / eligible over an array of classes."""

    def of(name: str) -> Column:
        return F.size(F.filter(families, lambda x: x == name))

    count = {c: of(c) for c in (SUPPORTIVE, ADVERSE, NEUTRAL, CONFLICTED, INELIGIBLE)}
    n = F.size(families) - count[INELIGIBLE]
    return F.try_divide((count[SUPPORTIVE] - count[ADVERSE]).cast("double"), n.cast("double")), count, n


def classify_status(rows: DataFrame, neutral_fraction: float = 0.5) -> DataFrame:
    """Add status and status_reason.

    Needs level, momentum, families and accelerations (maps of name to class), recovered (families
    that recovered), opposing (boolean), eligible, threshold and conflict_is_mixed. Material conflict
    comes first, then deteriorating, decelerating, accelerating, improving twice, stable, else mixed.
    """
    adi, count, n = direction_index(F.map_values("families"))
    acc, acc_count, _ = direction_index(F.map_values("accelerations"))
    level, momentum, t = F.col("level"), F.col("momentum"), F.col("threshold")
    no = F.lit(False)
    against = F.coalesce(((adi >= t) & (level < 47.5)) | ((adi <= -t) & (level >= 52.5)), no) | F.coalesce(((acc >= t) & (momentum < 47.5)) | ((acc <= -t) & (momentum >= 52.5)), no)
    conflicted = count[CONFLICTED] > 0
    explicit = ((count[SUPPORTIVE] >= 2) & (count[ADVERSE] + count[CONFLICTED] >= 2)) | F.col("opposing")
    f = lambda name: F.coalesce(F.col("families")[name], F.lit(INELIGIBLE))
    cash_capital = (f("growth") == SUPPORTIVE) & (f("profit") == SUPPORTIVE) & f("cash").isin(ADVERSE, CONFLICTED) & f("capital").isin(ADVERSE, CONFLICTED)
    mixed = explicit | cash_capital | against | (conflicted & F.col("conflict_is_mixed"))
    strong = F.coalesce(adi >= t, no)
    cases = (
        (~F.col("eligible") | level.isNull() | momentum.isNull(), "UNSCORED", "DATA_OR_METHODOLOGY_GATE"),
        (mixed, "MIXED", "MATERIAL_CONFLICT_PRECEDENCE"),
        ((level < 42.5) & (momentum < 47.5) & (count[ADVERSE] >= 3) & (count[ADVERSE] - count[SUPPORTIVE] >= 2), "DETERIORATING", "DETERIORATING"),
        (((level >= 47.5) | strong) & ((momentum < 42.5) | (acc_count[ADVERSE] >= 2)), "DECELERATING", "DECELERATING"),
        ((level >= 55) & (momentum >= 60) & (count[SUPPORTIVE] >= 3) & (count[SUPPORTIVE] - count[ADVERSE] >= 2) & ~conflicted & F.coalesce(adi > -t, no), "ACCELERATING", "ACCELERATING"),
        ((level >= 52.5) & ((momentum >= 47.5) | strong), "IMPROVING", "IMPROVING_POSITIVE"),
        ((level >= 35) & (level < 52.5) & (momentum >= 60) & (F.col("recovered") >= 2) & F.coalesce(acc > 0, no), "IMPROVING", "IMPROVING_RECOVERY"),
        ((level >= 45) & (level <= 55) & (momentum >= 42.5) & (momentum <= 57.5) & (n > 0) & (count[NEUTRAL] >= neutral_fraction * n) & ~conflicted, "STABLE", "STABLE"),
    )
    both = F.coalesce(*[F.when(p, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))) for p, s, r in cases], F.struct(F.lit("MIXED").alias("status"), F.lit("NO_DIRECTIONAL_RULE_MATCH_REVIEW").alias("reason")))
    return rows.withColumn("_s", both).withColumn("status", F.col("_s.status")).withColumn("status_reason", F.col("_s.reason")).drop("_s")


def recovered(level: Column, change: Column, neutral: float, band: float = 0.01) -> Column:
    """Formerly below its neutral band and now rising by more than the band."""
    return F.coalesce((level - change < -neutral) & (change > band), F.lit(False))


def publication_gate(rows: DataFrame, least: float = 70.0) -> DataFrame:
    """Add published, data_status and gate_reason from candidate, vintage, confidence and age_days, in that order."""
    case = lambda ok, status, reason: F.struct(F.lit(ok).alias("p"), F.lit(status).alias("s"), F.lit(reason).alias("r"))
    age = F.col("age_days")
    gate = (
        F.when(F.col("candidate").isNull(), case(False, "INSUFFICIENT_HISTORY", "EXISTING_CANDIDATE_COVERAGE_OR_HISTORY_HOLD"))
        .when(~F.col("vintage").eqNullSafe("PASS_KNOWABLE_AT_MODEL_DATE"), case(False, "REVIEW_REQUIRED", "FILING_VINTAGE_VALIDATION_FAILED"))
        .when(F.col("confidence").isNull() | (F.col("confidence") < least), case(False, "REVIEW_REQUIRED", "CONFIDENCE_BELOW_RESEARCH_FLOOR"))
        .when(age.isNull() | (age > 180), case(False, "STALE", "PRIMARY_EVIDENCE_TOO_OLD_OR_AGE_UNKNOWN"))
        .when(age > 120, case(True, "STALE", "OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING"))
        .otherwise(case(True, "PARTIAL", "OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING"))
    )
    return rows.withColumn("_g", gate).withColumn("published", F.col("_g.p")).withColumn("data_status", F.col("_g.s")).withColumn("gate_reason", F.col("_g.r")).drop("_g")


def override_gate(gated: DataFrame, exclusions: DataFrame, exceptions: DataFrame, key: str = "issuer") -> DataFrame:
    """The publication gate under its overrides: exclusions from the peers (key, reason), then dated exceptions (key, model_date, reason).

    Either one withholds publication, whatever the gate says; an exception of the row's model_date
    wins over an exclusion. Of several reasons for a key the least is given.
    """
    out = gated.join(exclusions.groupBy(key).agg(F.lit(True).alias("_x"), F.min("reason").alias("_xr")), key, "left")
    out = out.join(exceptions.groupBy(key, "model_date").agg(F.lit(True).alias("_e"), F.min("reason").alias("_er")), [key, "model_date"], "left")
    hit = F.col("_x").isNotNull() | F.col("_e").isNotNull()
    status = F.when(F.col("_e"), "REVIEW_REQUIRED").when(F.col("_x"), "EXCLUDED_PEER_GROUP").otherwise(F.col("data_status"))
    reason = F.when(F.col("_e"), F.col("_er")).when(F.col("_x"), F.col("_xr")).otherwise(F.col("gate_reason"))
    return out.withColumns({"published": F.when(hit, False).otherwise(F.col("published")), "data_status": status, "gate_reason": reason}).select(*gated.columns)


def vintage_status(buffer_day: Column, expected_buffer: Column, available: Column, accepted_day: Column, model_date: Column) -> Column:
    """What is wrong with a filing's knowledge date, if anything."""
    return F.coalesce(
        first_reason(
            (buffer_day.isNull() | available.isNull(), "MISSING_VINTAGE"),
            (buffer_day != expected_buffer, "BUFFER_MISMATCH"),
            (available > model_date, "FUTURE_FILING"),
            (buffer_day < accepted_day, "SOURCE_BEFORE_BUFFER"),
        ),
        F.lit("PASS_KNOWABLE_AT_MODEL_DATE"),
    )


def score_band(score: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    """Band with the greatest lower bound not above the score; null for null."""
    out = F.lit(None).cast("string")
    for low, name in sorted(bands):
        out = F.when(score >= low, name).otherwise(out)
    return out


def most_restrictive(statuses: Column, order: tuple[str, ...]) -> Column:
    """Of an array of statuses the one that comes first in ``order``."""
    return F.element_at(F.filter(F.array(*[F.lit(s) for s in order]), lambda s: F.array_contains(statuses, s)), 1)
