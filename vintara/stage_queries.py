"""Registered queries of the composed stages, over all quarters as model dates; see ``stage_oracle`` for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.functions import scalars as S
from vintara.operators import peers, scoring
from vintara.plans import bridge, normalization, policy, stages
from vintara.plans.bridge import table
from vintara.plans.settle import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def dec(column, name: str | None = None, kind: str = "decimal(18,9)"):
    c = F.col(column) if isinstance(column, str) else column
    return c.cast(kind).alias(name or column)


def big(column, name: str | None = None):
    return dec(column, name, "long")


def evidence_age() -> Column:
    """Days since a supplier's evidence of a quarter."""
    return (80 + (F.col("issuer") * 13 + F.month("q_end") * 7) % 120).cast("int")


class Method:
    """The tables of one run, each built when first asked for and settled once a session (see ``settle.once``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return once(self.spark, (name, self.sf_dir), build)

    @property
    def cells(self) -> DataFrame:
        return self._once("cells", lambda: bridge.quarter_cells(self.spark, self.sf_dir))

    @property
    def signals(self) -> DataFrame:
        """All inputs of a supplier and quarter in one row; ``inputs``, ``classes``, gates and holds follow from it row by row and are not kept."""
        return self._once("signals", lambda: stages.quarter_signals(bridge.quarter_rows(self.spark, self.sf_dir)))

    @property
    def inputs(self) -> DataFrame:
        """Factor inputs; a supplier's filing lag stands for the age of its evidence."""
        return stages.factor_inputs(self.signals).withColumn("age_days", evidence_age())

    @property
    def usable(self) -> DataFrame:
        """Those of ``inputs`` that have their required transformation."""
        return stages.usable_inputs(self.signals).withColumn("age_days", evidence_age())

    def small(self) -> bool | None:
        """True where no date has more companies than one task sorts, so that no group of peers has; else it is not known."""
        return peers.fits(self.signals, ("q_end",)) or None

    @property
    def judged(self) -> DataFrame:
        """``usable`` with whether the company is approved, from the same row."""
        return stages.judged_inputs(self.classes, evidence_age())

    def whole(self) -> bool:
        """Whether one task may hold any date's companies."""
        return peers.fits(self.signals, ("q_end",), normalization.ONE_TASK)

    @property
    def classes(self) -> DataFrame:
        return stages.family_classes(self.signals)

    def gates(self) -> DataFrame:
        return stages.company_gates(self.classes, evidence_age())

    def approved(self) -> DataFrame:
        return stages.approved(self.classes, evidence_age())

    def normalized(self, scenarios: str = "true", keep: bool = False) -> DataFrame:
        """``stages.normalize``; settled with ``keep``, for what reads it more than once."""
        chosen = policy.normalization_scenarios(self.spark).where(scenarios)
        build = lambda: stages.normalize(self.judged, chosen, self.whole())
        return self._once(f"normalized where {scenarios}", build) if keep else build()

    def percentiles(self) -> DataFrame:
        """The baseline of ``normalized`` for what needs no robust scores."""
        chosen = policy.normalization_scenarios(self.spark).where("scenario = 'BASELINE'")
        return stages.baseline_percentiles(self.usable, chosen, self.approved(), self.small())

    def factors(self, scenarios: str = "true") -> DataFrame:
        chosen = policy.score_scenarios(self.spark).where(scenarios)
        normalized = self.normalized("scenario = 'BASELINE'") if any(field == "robust" for _, field, _ in chosen.collect()) else self.percentiles()
        return stages.factor_scores(normalized, self.classes, self.approved(), chosen)

    def persistence(self) -> DataFrame:
        bands = {"revenue": 0.01, "operating_income": 0.02, "cash_from_operations": 0.03, "free_cash_flow": 0.03}
        return self.signals.select(*stages.KEYS, *[S.persistence_score(F.col(f"history_{c}"), band, policy.RECENCY_WEIGHTS).alias(c) for c, band in bands.items()])

    def composites(self) -> DataFrame:
        return self._once("composites", lambda: stages.composites(self.factors("scenario = 'BASELINE'"), self.persistence(), policy.persistence_scenarios(self.spark)))

    def pilot(self) -> DataFrame:
        return self._once("pilot", self._pilot)

    def _pilot(self) -> DataFrame:
        one = self.composites().where("scenario = 'EQUAL_FAMILIES_40_60'")
        vintage = F.when(F.col("issuer") % 17 == 0, "FUTURE_FILING").otherwise("PASS_KNOWABLE_AT_MODEL_DATE")
        evidence = self.classes.select(*stages.KEYS, evidence_age().alias("age_days"), vintage.alias("vintage"), ((F.month("q_end") == 12) & (F.col("issuer") % 3 == 0)).alias("derived_q4"), (evidence_age() > policy.STALE_DAYS).alias("stale"))
        evidence = evidence.join(one.select(*stages.KEYS, F.col("total_coverage").alias("coverage")), list(stages.KEYS), "left")
        excluded = table(self.spark, self.sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("issuer"), F.lit("NEGATIVE_BALANCE").alias("reason"))
        line = table(self.spark, self.sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50")
        dated = line.select(F.col("l_suppkey").alias("issuer"), F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("model_date"), F.lit("LARGE_RETURN").alias("reason"))
        return stages.pilot(self.classes, one, evidence, policy.pilot_scenarios(self.spark), excluded, dated)


@query
def family_classes(spark, sf_dir):
    """Class of each of the six families of each supplier and quarter."""
    return Method(spark, sf_dir).classes.select(*stages.KEYS, *stages.FAMILIES)


@query
def company_gates(spark, sf_dir):
    """What each company can fill of each factor, and whether that meets the factor's floor."""
    return Method(spark, sf_dir).gates().select(*stages.KEYS, "factor", dec("coverage"), "gate")


@query
def factor_coverage_counts(spark, sf_dir):
    """Companies that pass each factor's gate against the minimum, by model date; factors that nobody passes have a row."""
    rows = Method(spark, sf_dir).gates().groupBy("q_end", "factor").agg(big(F.count_if(F.col("gate") == "PASS"), "companies"))
    return rows.withColumn("coverage", F.when(F.col("companies") >= 50, "PASS").otherwise("PEER_GROUP_INSUFFICIENT"))


@query
def metric_normalization(spark, sf_dir):
    """All inputs under all seven scenarios: ranks over all peers, scores masked for held companies and small groups."""
    rows = Method(spark, sf_dir).normalized()
    return rows.select("scenario", *stages.KEYS, "input_id", dec("value"), dec("sensitivity_value"), big("ties"), big("peer_count"), "min_peers", dec("midrank"), dec("percentile"), dec("robust", None, "decimal(18,6)"), "peer_extreme", "age_class", "normalization_status")


@query
def normalization_distributions(spark, sf_dir):
    """Peers, distinct values, ties, stale peers and sufficiency of each distribution."""
    m = Method(spark, sf_dir)
    if m.whole():
        out = normalization.distributions(m.judged, policy.normalization_scenarios(spark))
        return out.select("scenario", "q_end", "input_id", *[big(c) for c in ("peers", "distinct_values", "tied", "stale_peers")], F.when(F.col("peers") >= F.col("least"), "PASS").otherwise("PEER_GROUP_INSUFFICIENT").alias("coverage"))
    rows = m.normalized().groupBy("scenario", "q_end", "input_id")
    out = rows.agg(big(F.count(F.lit(1)), "peers"), big(F.count_distinct("sensitivity_value"), "distinct_values"), big(F.count_if(F.col("ties") > 1), "tied"), big(F.count_if(F.col("age_class") == "STALE"), "stale_peers"), F.min("min_peers").alias("least"))
    return out.withColumn("coverage", F.when(F.col("peers") >= F.col("least"), "PASS").otherwise("PEER_GROUP_INSUFFICIENT")).drop("least")


@query
def normalization_sensitivity(spark, sf_dir):
    """How each scenario and method ranks companies against the baseline's percentiles."""
    m = Method(spark, sf_dir)
    out = normalization.sensitivity(m.judged, policy.normalization_scenarios(spark)) if m.whole() else stages.sensitivity(m.normalized(keep=True))
    return out.select("q_end", "scenario", "input_id", "method", big("n"), dec("rho", None, "decimal(18,6)"), dec(F.col("mean_change") + 1e-9, "mean_change", "decimal(18,4)"), dec("max_change", None, "decimal(18,6)"), big("over_10"))


@query
def method_difference_review(spark, sf_dir):
    """The twenty largest differences between the two score methods of each model date (a top-k report), ties by issuer and input."""
    rows = Method(spark, sf_dir).normalized("scenario = 'BASELINE'").where("normalization_status = 'PASS' and robust is not null")
    rows = rows.select(*stages.KEYS, "input_id", F.round(F.abs(F.col("percentile") - F.col("robust")), 6).cast("decimal(18,6)").alias("difference"))
    place = F.row_number().over(Window.partitionBy("q_end").orderBy(F.desc("difference"), "issuer", "input_id"))
    return rows.withColumn("place", big(place, "place")).where("place <= 20")


@query
def factor_scores_scenarios(spark, sf_dir):
    """The five factors of each company and quarter under the four score scenarios, with floors and holds."""
    rows = Method(spark, sf_dir).factors()
    return rows.select("scenario", *stages.KEYS, "factor", dec("factor_score"), "floor", "score_status", dec("original_coverage"), dec("applied_coverage"))


@query
def composite_scores(spark, sf_dir):
    """Acceleration with its persistence sleeve, total coverage and composite under the four persistence scenarios."""
    rows = Method(spark, sf_dir).composites()
    return rows.select("scenario", *stages.KEYS, dec("f4_score"), dec("f4_coverage"), dec("total_coverage"), dec("composite"), "hold_reason", dec("level"), dec("momentum"))


@query
def research_pilot(spark, sf_dir):
    """Score, confidence, gate with its overrides and status of each company and quarter under the five pilot scenarios."""
    rows = Method(spark, sf_dir).pilot()
    return rows.select("scenario", *stages.KEYS, dec("score"), dec("confidence"), "published", "data_status", "gate_reason", "status", "status_reason")


@query
def composite_status(spark, sf_dir):
    """Level, momentum and status of each company and quarter under the five pilot scenarios."""
    rows = Method(spark, sf_dir).pilot()
    return rows.select("scenario", *stages.KEYS, dec("level", None, "decimal(18,6)"), dec("momentum", None, "decimal(18,6)"), "status", "status_reason")


@query
def persistence_candidates(spark, sf_dir):
    """Persistence sleeve of each supplier and quarter under each scenario."""
    out = scoring.persistence_candidates(Method(spark, sf_dir).persistence(), policy.persistence_scenarios(spark), stages.KEYS)
    return out.select("scenario", *stages.KEYS, "passed", dec("persistence_score"), dec("persistence_coverage"))


@query
def pilot_sensitivity(spark, sf_dir):
    """Published companies, status changes and the largest change of confidence of each pilot scenario."""
    rows = stages.pilot_summary(Method(spark, sf_dir).pilot())
    return rows.select("q_end", "scenario", big("published"), big("status_changes"), dec("max_confidence_change"))
