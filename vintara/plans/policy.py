"""Policy as data: weights, bands and scenarios are small relations, so a scenario is a join and not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the scoring method.
CONCEPTS = ("revenue", "operating_income", "cash_from_operations", "capital_expenditures")
NEUTRAL_BANDS = {"growth": 0.01, "profit": 0.02, "cash": 0.03, "margin": 0.0025, "fcf_margin": 0.005, "acceleration": 0.01}
FACTOR_WEIGHTS = {"F1_TTM": 0.35, "F2_QUARTER": 0.25, "F3_QUALITY": 0.20, "F4_ACCELERATION": 0.15, "F5_BREADTH": 0.05}
FACTOR_FLOORS = {"F1_TTM": 0.60, "F2_QUARTER": 0.90, "F3_QUALITY": 0.50, "F4_ACCELERATION": 0.40}
TOTAL_FLOOR = 0.70
WEIGHT_CAP = 1.25
STALE_DAYS, EXCLUDED_DAYS = 120, 180
RECENCY_WEIGHTS = (0.1, 0.2, 0.3, 0.4)
CONFIDENCE_WEIGHTS = {
    "source_authority": 0.20,
    "period_integrity": 0.25,
    "point_in_time": 0.20,
    "comparability_timeliness": 0.15,
    "metric_factor_coverage": 0.15,
    "denominator_definition": 0.05,
}
#: (factor, input, weight, family)
COMPONENTS = (
    ("F1_TTM", "revenue_ttm_yoy", 0.20, "GROWTH"),
    ("F1_TTM", "operating_income_ttm_yoy", 0.25, "PROFIT"),
    ("F1_TTM", "cfo_ttm_yoy", 0.15, "CASH"),
    ("F1_TTM", "fcf_ttm_yoy", 0.20, "CASH"),
    ("F1_TTM", "workforce_productivity", 0.20, "PRODUCTIVITY"),
    ("F2_QUARTER", "revenue_q_yoy", 0.45, "GROWTH"),
    ("F2_QUARTER", "operating_income_q_yoy", 0.45, "PROFIT"),
    ("F2_QUARTER", "gross_profit_q_yoy", 0.10, "PROFIT"),
    ("F3_QUALITY", "operating_margin_yoy_pp", 0.30, "MARGIN"),
    ("F3_QUALITY", "fcf_margin_yoy_pp", 0.20, "CASH"),
    ("F3_QUALITY", "operating_leverage_spread", 0.20, "MARGIN"),
    ("F3_QUALITY", "workforce_confirmation", 0.15, "PRODUCTIVITY"),
    ("F3_QUALITY", "capital_interpretation", 0.15, "CAPITAL"),
    ("F4_ACCELERATION", "revenue_q_yoy_acceleration", 0.15, "GROWTH"),
    ("F4_ACCELERATION", "revenue_ttm_yoy_acceleration", 0.10, "GROWTH"),
    ("F4_ACCELERATION", "operating_income_q_yoy_acceleration", 0.18, "PROFIT"),
    ("F4_ACCELERATION", "operating_income_ttm_yoy_acceleration", 0.12, "PROFIT"),
    ("F4_ACCELERATION", "cfo_ttm_yoy_acceleration", 0.06, "CASH"),
    ("F4_ACCELERATION", "fcf_ttm_yoy_acceleration", 0.09, "CASH"),
    ("F4_ACCELERATION", "operating_margin_acceleration_pp", 0.15, "MARGIN"),
    ("F4_ACCELERATION", "persistence_composite", 0.15, "CROSS_FAMILY"),
)
#: (factor, sleeve, input, weight of the sleeve, inputs needed) of the raw coverage of the first inputs stage.
SLEEVES = (
    ("F1_TTM", "revenue", "revenue_ttm_yoy", 0.20, 1),
    ("F1_TTM", "profit", "operating_income_ttm_yoy", 0.25, 1),
    ("F1_TTM", "operating cash", "cfo_ttm_yoy", 0.15, 1),
    ("F1_TTM", "free cash", "fcf_ttm_yoy", 0.20, 1),
    ("F2_QUARTER", "revenue", "revenue_q_yoy", 0.45, 1),
    ("F2_QUARTER", "profit", "operating_income_q_yoy", 0.45, 1),
    ("F2_QUARTER", "both", "revenue_q_yoy", 0.10, 2),
    ("F2_QUARTER", "both", "operating_income_q_yoy", 0.10, 2),
    ("F3_QUALITY", "operating margin", "operating_margin_yoy_pp", 0.30, 1),
    ("F3_QUALITY", "cash margin", "fcf_margin_yoy_pp", 0.20, 1),
    ("F3_QUALITY", "leverage", "operating_leverage_spread", 0.20, 1),
    ("F4_ACCELERATION", "revenue", "revenue_q_yoy_acceleration", 0.25, 1),
    ("F4_ACCELERATION", "revenue", "revenue_ttm_yoy_acceleration", 0.25, 1),
    ("F4_ACCELERATION", "profit", "operating_income_q_yoy_acceleration", 0.30, 1),
    ("F4_ACCELERATION", "profit", "operating_income_ttm_yoy_acceleration", 0.30, 1),
    ("F4_ACCELERATION", "cash", "cfo_ttm_yoy_acceleration", 0.15, 1),
    ("F4_ACCELERATION", "cash", "fcf_ttm_yoy_acceleration", 0.15, 1),
    ("F4_ACCELERATION", "margin", "operating_margin_acceleration_pp", 0.15, 1),
    ("F4_ACCELERATION", "two families", "acceleration_family_growth", 0.15, 2),
    ("F4_ACCELERATION", "two families", "acceleration_family_profit", 0.15, 2),
    ("F4_ACCELERATION", "two families", "acceleration_family_cash", 0.15, 2),
    ("F4_ACCELERATION", "two families", "acceleration_family_margin", 0.15, 2),
)
#: (dimension, alternative, cut, a value passes at or above it, primary) of the sensitivity matrix.
SENSITIVITY_CUTS = (
    *(("STALENESS", a, float(n), False, p) for a, n, p in (("AGE_180", 180, True), ("AGE_150", 150, False), ("AGE_210", 210, False))),
    *(("OUTLIER", a, c, True, p) for a, c, p in (("TAILS_2_5", 47.5, True), ("TAILS_5", 45.0, False))),
    *(("REWEIGHT_CAP", a, c, False, p) for a, c, p in (("CAP_125", 1.25, True), ("CAP_100", 1.0, False), ("CAP_150", 1.5, False))),
    *(("TOTAL_COVERAGE_FLOOR", a, c, True, p) for a, c, p in (("FLOOR_70", 0.70, True), ("FLOOR_65", 0.65, False), ("FLOOR_80", 0.80, False))),
    *(("NEUTRAL_BAND", a, c, False, p) for a, c, p in (("BAND_47_5_52_5", 2.5, True), ("BAND_45_55", 5.0, False))),
    *(("ACCELERATION_CUTOFF", a, c, True, p) for a, c, p in (("CUTOFF_60", 60.0, True), ("CUTOFF_55", 55.0, False), ("CUTOFF_65", 65.0, False))),
    *(("CONFLICT_VALUE", a, c, False, p) for a, c, p in (("CONFLICT_0_25", 0.25, True), ("CONFLICT_0", 0.0, False), ("CONFLICT_0_5", 0.5, False))),
    *(("EMPLOYEE_AGE", a, float(n), False, p) for a, n, p in (("AGE_365", 365, True), ("AGE_270", 270, False), ("AGE_450", 450, False))),
    *(("MINIMUM_PEERS", a, c, True, p) for a, c, p in (("HIERARCHY", 1.0, True), ("LOWER", 0.75, False), ("HIGHER", 1.25, False))),
)
#: (input, required transformation): a value of another transformation never enters its peer distribution.
TRANSFORMATIONS = (
    ("revenue_q_yoy", "PERCENT_CHANGE"),
    ("revenue_ttm_yoy", "PERCENT_CHANGE"),
    ("operating_income_q_yoy", "PERCENT_CHANGE"),
    ("operating_income_ttm_yoy", "PERCENT_CHANGE"),
    ("cfo_ttm_yoy", "PERCENT_CHANGE"),
    ("fcf_ttm_yoy", "PERCENT_CHANGE"),
    ("revenue_q_yoy_acceleration", "YOY_RATE_DELTA"),
    ("revenue_ttm_yoy_acceleration", "YOY_RATE_DELTA"),
    ("operating_income_q_yoy_acceleration", "YOY_RATE_DELTA"),
    ("operating_income_ttm_yoy_acceleration", "YOY_RATE_DELTA"),
    ("cfo_ttm_yoy_acceleration", "YOY_RATE_DELTA"),
    ("fcf_ttm_yoy_acceleration", "YOY_RATE_DELTA"),
    ("operating_margin_yoy_pp", "MARGIN_YOY_PP"),
    ("fcf_margin_yoy_pp", "MARGIN_YOY_PP"),
    ("operating_margin_acceleration_pp", "MARGIN_YOY_PP_DELTA"),
    ("operating_leverage_spread", "YOY_RATE_SPREAD"),
)
#: (scenario, minimum peers, stale after days, excluded after days, winsor probability)
NORMALIZATION_SCENARIOS = (
    ("BASELINE", 50, 120, 180, None),
    ("PEER_MIN_40", 40, 120, 180, None),
    ("PEER_MIN_60", 60, 120, 180, None),
    ("AGE_90_150", 50, 90, 150, None),
    ("AGE_150_210", 50, 150, 210, None),
    ("WINSOR_2_5_97_5", 50, 120, 180, 0.025),
    ("WINSOR_5_95", 50, 120, 180, 0.05),
)
#: (scenario, score column, value of a conflicted family)
SCORE_SCENARIOS = (("BASELINE", "percentile", 0.25), ("ROBUST_Z", "robust", 0.25), ("BREADTH_CONFLICT_0", "percentile", 0.0), ("BREADTH_CONFLICT_0_5", "percentile", 0.5))
#: (scenario, family weights for revenue, profit and cash, share of operating cash in cash, all four needed)
PERSISTENCE_SCENARIOS = (
    ("EQUAL_FAMILIES_40_60", 1.0, 1.0, 1.0, 0.4, False),
    ("MAPPED_FAMILIES_40_60", 25.0, 30.0, 15.0, 0.4, False),
    ("EQUAL_FAMILIES_50_50", 1.0, 1.0, 1.0, 0.5, False),
    ("STRICT_COMPLETE_HISTORY", 1.0, 1.0, 1.0, 0.4, True),
)
#: (scenario, threshold of the direction index, conflicted families alone make a mixed status, point-in-time credit, denominator credit)
PILOT_SCENARIOS = (
    ("BASELINE", 0.25, True, 85.0, 50.0),
    ("CONSERVATIVE_CONFIDENCE", 0.25, True, 0.0, 0.0),
    ("UPPER_CONFIDENCE", 0.25, True, 95.0, 100.0),
    ("STRICT_CONFLICT_COUNTS", 0.25, False, 85.0, 50.0),
    ("ABSOLUTE_DIRECTION_0_50", 0.50, True, 85.0, 50.0),
)
#: (lower bound, band of a metric or composite score)
SCORE_BANDS = ((80.0, "VERY_HIGH"), (60.0, "HIGH"), (40.0, "MIDDLE"), (20.0, "LOW"), (0.0, "VERY_LOW"))


def normalization_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NORMALIZATION_SCENARIOS, "scenario string, min_peers int, stale_days int, excluded_days int, winsor double")


def factor_components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "factor string, input_id string, weight double, family string")


def metric_transformations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFORMATIONS, "input_id string, required string")


def score_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCORE_SCENARIOS, "scenario string, score_field string, conflict double")


def persistence_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSISTENCE_SCENARIOS, "scenario string, w_revenue double, w_profit double, w_cash double, cfo_share double, strict boolean")


def pilot_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PILOT_SCENARIOS, "scenario string, threshold double, conflict_is_mixed boolean, pit_credit double, denominator_credit double")


def score_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCORE_BANDS, "lower double, band string")
