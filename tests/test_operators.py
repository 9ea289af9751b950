"""Single rules with known numbers."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintara.functions import scalars as S
from vintara.functions import trading_days
from vintara.operators import classify, contexts, diagnostics, gates, peers, periods, pit, scoring, timeseries
from vintara.plans import policy
from vintara.sources import landing, tables
from vintara.streaming import arrivals

D = dt.date


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_percentiles_with_ties(spark):
    data = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, 2.0, 4.0])], "id long, v double")
    assert [x[1] for x in sorted(rows(peers.midrank_percentiles(data, (), "v"), "id", "percentile"))] == [12.5, 50, 50, 87.5]
    five = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert rows(peers.midrank_percentiles(five, (), "v"), "percentile") == [(50.0,)] * 5


def test_quantile_mad_and_capped_z(spark):
    two = peers.distribution(spark.createDataFrame([(0.0,), (10.0,)], "v double"), (), "v")
    got = peers.quantiles(two, (), "v", {"a": 0.025, "b": 0.95}).first()
    assert (got["a"], got["b"]) == (0.25, 9.5)
    data = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "v double").withColumn("g", F.lit(1))
    z = peers.robust_z(data, ("g",), "v")
    assert {r["mad"] for r in z.collect()} == {1.0}
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double").withColumn("g", F.lit(1))
    assert {r["z"] for r in peers.robust_z(flat, ("g",), "v").collect()} == {None}
    cdf = spark.createDataFrame([(-3.0,), (3.0,)], "z double").select((100 * S.normal_cdf("z")).alias("s"))
    assert [r["s"] for r in cdf.collect()] == pytest.approx([0.134989803, 99.865010197])


@pytest.mark.parametrize("right, rho", [([1.0, 2.0, 2.0, 4.0], 1.0), ([4.0, 2.0, 2.0, 1.0], -1.0), ([7.0] * 4, None)])
def test_spearman(spark, right, rho):
    data = spark.createDataFrame(list(zip([1.0, 2.0, 2.0, 4.0], right)), "a double, b double").withColumn("g", F.lit(1))
    got = peers.spearman(data, ("g",), "a", "b").first()["rho"]
    assert got is None if rho is None else math.isclose(got, rho)


def test_ranges_give_the_same_ranks_as_one_window(spark):
    data = spark.range(2000).select("id", ((F.col("id") * 7919) % 301).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    one = {(r["g"], r["v"]): r["before"] for r in peers.distribution(data, ("g",), "v", buckets=2).collect()}
    assert one == {(r["g"], r["v"]): r["before"] for r in peers.distribution(data, ("g",), "v", buckets=16).collect()}


def cells(spark, values, skip=()):
    out = []
    for k, v in enumerate(values):
        if k in skip:
            continue
        y, q = 2020 + k // 4, k % 4
        end = D(y + (q == 3), (3 * q + 3) % 12 + 1, 1) - dt.timedelta(days=1)
        out.append((1, "revenue", D(y, 3 * q + 1, 1), end, q + 1, Decimal(v)))
    return spark.createDataFrame(out, "issuer long, concept string, q_start date, q_end date, fiscal_quarter int, value decimal(20,2)")


def test_trailing_sums_need_unbroken_runs(spark):
    whole = timeseries.trailing(timeseries.mark_runs(cells(spark, range(1, 13))))
    last = whole.orderBy(F.desc("q_end")).first()
    assert (last["ttm"], last["prior_ttm"]) == (42, 26)
    holed = timeseries.trailing(timeseries.mark_runs(cells(spark, range(1, 13), skip={6})))
    assert [r["prior_ttm"] for r in holed.collect() if r["prior_ttm"] is not None] == []
    late = cells(spark, [1, 2]).withColumn("q_start", F.when(F.col("fiscal_quarter") == 2, F.date_add("q_start", 1)).otherwise(F.col("q_start")))
    assert [r["run"] for r in timeseries.mark_runs(late).orderBy("q_end").collect()] == [1, 2]


def test_change_methods(spark):
    data = spark.createDataFrame([(20, -10), (120, 100), (5, 0), (None, 3)], "a int, b int")
    rate, change, method = S.safe_change(F.col("a"), F.col("b"))
    got = [tuple(r) for r in data.select(rate, change, method).collect()]
    assert got[0] == (None, 30, "ABSOLUTE_CHANGE_NONPOSITIVE_BASE")
    assert got[1][0] == pytest.approx(0.2) and got[1][1:] == (20, "PERCENT_CHANGE")
    assert got[2][0] is None and got[3] == (None, None, None)


def test_history_starts_anew_after_a_change_without_a_rate(spark):
    data = timeseries.growth_history(timeseries.year_over_year(timeseries.trailing(timeseries.mark_runs(cells(spark, [1, 1, -1, 1, 2, 2, 2, 2, 3, 3])))))
    assert [r["history"] and len(r["history"]) for r in data.orderBy("q_end").collect()] == [None] * 4 + [1, 2, None, 1, 2, 3]


@pytest.mark.parametrize(
    "values, label",
    [([0.1], "INSUFFICIENT_HISTORY"), ([0.1, 0.2], "CONSISTENTLY_POSITIVE_IMPROVING"), ([0.3, 0.2], "POSITIVE_BUT_SLOWING"), ([-0.3, -0.2], "NEGATIVE_BUT_RECOVERING"), ([-0.1, -0.2], "CONSISTENTLY_NEGATIVE_DETERIORATING"), ([0.1, -0.2], "NEUTRAL_OR_ALTERNATING")],
)
def test_patterns(spark, values, label):
    assert column(spark, S.persistence_pattern(F.array(*[F.lit(v) for v in values]))) == label


@pytest.mark.parametrize("values, score", [([0.1, 0.1, 0.1, -0.1], 60), ([0.01, -0.01, 0.0, 0.0], 50), ([-0.1] * 4, 0), ([0.1] * 3, None), ([0.1, 0.0, -0.1, 0.1], 60)])
def test_persistence_score(spark, values, score):
    got = column(spark, S.persistence_score(F.array(*[F.lit(v) for v in values]), 0.01, policy.RECENCY_WEIGHTS))
    assert got is None if score is None else got == pytest.approx(score)


def test_bands_are_strict_and_missing_is_never_adverse(spark):
    data = spark.createDataFrame([(0.01,), (0.011,), (-0.011,), (None,)], "v double")
    assert [r[0] for r in data.select(S.direction(F.col("v"), 0.01)).collect()] == ["NEUTRAL", "SUPPORTIVE", "ADVERSE", "INELIGIBLE"]
    assert column(spark, S.reconcile_directions([F.lit("SUPPORTIVE"), F.lit("ADVERSE")])) == "CONFLICTED"
    assert column(spark, S.reconcile_directions([F.lit("INELIGIBLE"), F.lit("NEUTRAL")])) == "NEUTRAL"
    assert column(spark, S.reconcile_directions([F.lit("INELIGIBLE")])) == "INELIGIBLE"


def test_tolerance(spark):
    assert column(spark, periods.tolerance(F.lit(0.0), F.lit(100), F.lit(101))) == 1
    assert column(spark, periods.tolerance(F.lit(0.0), F.lit(1e10))) == 10
    assert column(spark, periods.tolerance(F.lit(1_500_000.0), F.lit(1))) == 1_500_000


def test_direct_quarter_is_confirmed_by_the_half_year(spark):
    facts = spark.createDataFrame(
        [(1, "revenue", D(2026, 1, 1), D(2026, 3, 31), Decimal(110)), (1, "revenue", D(2026, 4, 1), D(2026, 6, 30), Decimal(120)), (1, "revenue", D(2026, 1, 1), D(2026, 6, 30), Decimal(230))],
        "issuer long, concept string, start date, end date, value decimal(28,4)",
    ).withColumn("mapping_rule", F.lit("S")).withColumn("unit", F.lit("USD")).withColumn("bound", F.lit(0.0)).withColumn("available", F.date_add("end", 30))
    assert rows(periods.standalone_quarters(facts), "fiscal_quarter", "value", "status") == [(1, 110, "PASS_DIRECT"), (2, 120, "PASS_DIRECT_DERIVED_RECONCILED")]
    wrong = facts.withColumn("value", F.when(F.col("value") == 120, 150).otherwise(F.col("value")).cast("decimal(28,4)"))
    assert rows(periods.standalone_quarters(wrong), "fiscal_quarter", "value", "status")[1] == (2, None, "REVIEW_DIRECT_DERIVED_MISMATCH")
    plain = facts.where("datediff(end, start) < 100")
    assert periods.standalone_quarters(plain).count() == 0


@pytest.mark.parametrize(
    "accepted, buffer, available",
    [("2026-07-29 20:08:01", D(2026, 7, 30), D(2026, 7, 31)), ("2026-04-30 15:40:35", D(2026, 5, 1), D(2026, 5, 4)), ("2026-07-29 12:00:00", D(2026, 7, 29), D(2026, 7, 30))],
)
def test_availability(spark, accepted, buffer, available):
    one = spark.createDataFrame([(accepted,)], "t string").select(F.col("t").cast("timestamp").alias("accepted"))
    got = trading_days.availability(one, trading_days.trading_calendar(spark), "accepted").first()
    assert (got["buffer_day"], got["available_date"]) == (buffer, available)


def test_holidays(spark):
    closed = {r["day"] for r in trading_days.trading_calendar(spark).where("not is_session and dayofweek(day) not in (1, 7)").collect()}
    assert {D(2026, 4, 3), D(2026, 6, 19), D(2026, 7, 3), D(2024, 3, 29), D(2025, 11, 27), D(2027, 12, 24)} <= closed
    assert D(2025, 1, 9) not in closed and D(2027, 12, 31) not in closed
    assert len([d for d in closed if d.year == 2026]) == 10


@pytest.mark.parametrize(
    "requested, now, effective, reason",
    [
        (D(2026, 9, 26), "2026-09-28 12:00:00", D(2026, 9, 25), "WEEKEND"),
        (D(2026, 7, 3), "2026-07-06 12:00:00", D(2026, 7, 2), "MARKET_HOLIDAY"),
        (D(2025, 1, 9), "2025-01-12 12:00:00", D(2025, 1, 8), "MARKET_HOLIDAY"),
        (None, "2026-09-24 19:59:00", D(2026, 9, 23), "SESSION_NOT_CLOSED"),
        (None, "2026-09-24 20:00:00", D(2026, 9, 24), "NONE"),
        (None, "2025-11-28 17:59:00", D(2025, 11, 26), "SESSION_NOT_CLOSED"),
        (None, "2025-11-28 18:00:00", D(2025, 11, 28), "NONE"),
        (D(2026, 9, 30), "2026-09-24 20:00:00", None, "FUTURE_DATE"),
    ],
)
def test_last_session(spark, requested, now, effective, reason):
    one = spark.createDataFrame([(requested, now)], "requested date, t string").select("requested", F.col("t").cast("timestamp").alias("now"))
    got = trading_days.resolve_requests(one, trading_days.trading_calendar(spark, True), "requested", "now").first()
    assert (got["effective_date"], got["reason"]) == (effective, reason)


def filing(spark, data):
    return spark.createDataFrame(data, "issuer string, report_period date, form string, available date, accepted string, accession string, value int").withColumn("accepted", F.col("accepted").cast("timestamp"))


def test_amendment_supersedes_and_short_history_is_flagged(spark):
    data = [("A", D(2023, 3, 31) + dt.timedelta(days=91 * k), "10-Q" if k % 4 else "10-K", D(2023, 5, 1) + dt.timedelta(days=91 * k), "2023-05-01 12:00:00", f"A{k:02}", k) for k in range(14)]
    data.append((*data[8][:2], "10-K/A", data[9][3], "2025-06-01 12:00:00", "Z", 99))
    latest = pit.latest_vintage(filing(spark, data))
    kept = pit.last_periods(latest, 12)
    assert kept.count() == 12 and kept.where("accession = 'Z'").first()["sequence"] == 7
    assert pit.history_audit(kept).first()["history"] == "PASS_TARGET_HISTORY"
    assert pit.history_audit(pit.last_periods(latest, 2)).first()["history"] == "REVIEW_HISTORY_GAP"


def test_conflicting_values_select_nothing(spark):
    data = [("A", D(2023, 3, 31), "10-Q", D(2023, 5, 1), "2023-05-01 12:00:00", "1", 5), ("A", D(2023, 3, 31), "10-Q", D(2023, 5, 1), "2023-05-01 13:00:00", "2", 6), ("B", D(2023, 3, 31), "10-Q", D(2023, 5, 1), "2023-05-01 12:00:00", "3", 5)]
    chosen, conflicts = pit.select_parent(filing(spark, data), ("issuer", "report_period"))
    assert rows(chosen, "issuer", "accession") == [("B", "3")] and rows(conflicts, "issuer", "values") == [("A", 2)]


def test_weighted_scores_and_cap(spark):
    comp = spark.createDataFrame([("F", "a", 0.5, "X"), ("F", "b", 0.5, "Y")], "factor string, input_id string, weight double, family string")
    scores = spark.createDataFrame([("i", "a", 80.0)], "issuer string, input_id string, score double")
    got = scoring.factor_scores(scoring.check_cap(scoring.component_table(scores, comp))).first()
    assert (got["factor_score"], got["applied_coverage"]) == (80.0, 0.5)
    over = scoring.component_table(scores, comp).withColumn("applied", F.when(F.col("input_id") == "a", 0.7).otherwise(F.col("applied")))
    with pytest.raises(Exception, match="cap"):
        scoring.check_cap(over).collect()


def test_breadth(spark):
    def score(classes, conflict):
        data = spark.createDataFrame([("i", c) for c in classes], "issuer string, class string")
        got = scoring.breadth(data, conflict).first()
        return got["breadth_score"], got["families"]

    assert score(["SUPPORTIVE", "CONFLICTED", "ADVERSE", "INELIGIBLE"], 0.5) == (50.0, 3)
    assert score(["SUPPORTIVE", "ADVERSE", "INELIGIBLE"], 0.5) == (None, 2)


def test_persistence_candidates(spark):
    data = spark.createDataFrame([("a", 0.0, 0.0, 100.0, 100.0), ("b", 80.0, 80.0, None, None), ("c", 80.0, None, 50.0, 50.0)], "issuer string, revenue double, operating_income double, cash_from_operations double, free_cash_flow double")
    got = {(r["issuer"], r["scenario"]): r for r in scoring.persistence_candidates(data, policy.persistence_scenarios(spark)).collect()}
    assert got["a", "EQUAL_FAMILIES_40_60"]["persistence_score"] == pytest.approx(100 / 3)
    assert got["b", "EQUAL_FAMILIES_40_60"]["persistence_coverage"] == pytest.approx(2 / 3) and got["b", "EQUAL_FAMILIES_40_60"]["persistence_score"] == pytest.approx(80)
    assert not got["c", "EQUAL_FAMILIES_40_60"]["passed"] and not got["b", "STRICT_COMPLETE_HISTORY"]["passed"]


def test_composite(spark):
    base = [("a", 80.0, 80.0, 80.0, 80.0, 80.0, 0.85, 0.8, True), ("b", 80.0, 80.0, 80.0, 80.0, 80.0, 0.2, 0.3, True)]
    factors = spark.createDataFrame(base, "issuer string, F1_TTM double, F2_QUARTER double, F3_QUALITY double, F4_ACCELERATION double, F5_BREADTH double, f4_applied double, base_coverage double, allowed boolean")
    cand = spark.createDataFrame([("a", "S", True, 80.0, 1.0), ("b", "S", True, 80.0, 1.0)], "issuer string, scenario string, passed boolean, persistence_score double, persistence_coverage double")
    got = {r["issuer"]: r for r in scoring.merge_persistence(factors, cand).collect()}
    assert got["a"]["composite"] == pytest.approx(80.0) and got["a"]["hold_reason"] is None
    assert got["b"]["composite"] is None and got["b"]["hold_reason"] == "TOTAL_COVERAGE_BELOW_70_PERCENT"


def test_confidence_bounds(spark):
    got = scoring.confidence(spark.createDataFrame([(0.85, True, False)], "coverage double, derived_q4 boolean, stale boolean")).first()
    assert (round(got["confidence_low"], 6), round(got["confidence_high"], 6)) == (74.5, 98.5)


def status(spark, level, momentum, fam, acc=None, recovered=0, opposing=False):
    names = ["growth", "profit", "cash", "margin", "productivity", "capital"]
    data = spark.createDataFrame([(level, momentum, dict(zip(names, fam)), acc or {"growth": "NEUTRAL"}, recovered, opposing, True, 0.25, True)], "level double, momentum double, families map<string,string>, accelerations map<string,string>, recovered int, opposing boolean, eligible boolean, threshold double, conflict_is_mixed boolean")
    return classify.classify_status(data).first()["status"]


def test_status_precedence(spark):
    up, down, flat, none = "SUPPORTIVE", "ADVERSE", "NEUTRAL", "INELIGIBLE"
    assert status(spark, 60.0, 65.0, [up, up, up, flat, none, none]) == "ACCELERATING"
    assert status(spark, 30.0, 30.0, [down, down, down, flat, none, none]) == "DETERIORATING"
    assert status(spark, 60.0, 30.0, [up, flat, flat, flat, none, none]) == "DECELERATING"
    assert status(spark, 50.0, 50.0, [flat] * 4 + [none, none]) == "STABLE"
    assert status(spark, 55.0, 50.0, [up, up, flat, flat, none, none]) == "IMPROVING"
    assert status(spark, 60.0, 65.0, [up, up, down, down, none, none]) == "MIXED"
    assert status(spark, 60.0, 65.0, ["CONFLICTED", up, up, up, none, none]) == "MIXED"
    assert status(spark, None, 50.0, [flat] * 6) == "UNSCORED"


@pytest.mark.parametrize("age, published, state", [(120, True, "PARTIAL"), (121, True, "STALE"), (180, True, "STALE"), (181, False, "STALE"), (None, False, "STALE")])
def test_publication_ages(spark, age, published, state):
    one = spark.createDataFrame([(50.0, "PASS_KNOWABLE_AT_MODEL_DATE", 80.0, age)], "candidate double, vintage string, confidence double, age_days int")
    got = classify.publication_gate(one).first()
    assert (got["published"], got["data_status"]) == (published, state)


def test_peer_minimum(spark):
    data = spark.range(99).select(F.col("id").alias("issuer"), F.when(F.col("id") < 49, "RATE").otherwise("DELTA").alias("transformation"), F.lit("x").alias("input_id"), F.lit(True).alias("eligible"))
    assert rows(scoring.peer_coverage(data, 50), "transformation", "peers", "coverage") == [("DELTA", 50, "PASS"), ("RATE", 49, "PEER_GROUP_INSUFFICIENT")]


def test_scores_are_withheld_after_ranking(spark):
    data = [("a", k, float(k)) for k in range(50)] + [("b", k, float(k)) for k in range(45)] + [("a", 99, None)]
    ranked = peers.midrank_percentiles(spark.createDataFrame(data, "g string, issuer int, v double"), ("g",), "v")
    approved = spark.range(1, 100).select(F.col("id").cast("int").alias("issuer"))
    out = peers.withhold(ranked, ("g",), "v", ("midrank", "percentile"), policy.normalization_scenarios(spark), approved).collect()
    got = {(r["scenario"], r["g"], r["issuer"]): (r["percentile"], r["normalization_status"]) for r in out}
    assert len(out) == len(got) == len(data) * len(policy.NORMALIZATION_SCENARIOS)
    assert got["BASELINE", "a", 0] == (None, "COMPANY_COVERAGE_HOLD") and got["BASELINE", "a", 1] == (3.0, "PASS")
    assert got["BASELINE", "b", 1] == (None, "PEER_GROUP_INSUFFICIENT") and got["BASELINE", "a", 99] == (None, None)
    assert got["PEER_MIN_40", "b", 1] == (pytest.approx(100 * 1.5 / 45), "PASS") and got["PEER_MIN_60", "a", 1][0] is None


def test_robust_score_needs_enough_peers(spark, monkeypatch):
    from vintara import queries

    assert {r["score"] for r in queries.robust_cdf_score(spark, "/root/testdata/sf0.001").collect()} == {None}  # ten suppliers
    monkeypatch.setattr(policy, "NORMALIZATION_SCENARIOS", (("BASELINE", 99, 120, 180, None),))
    n = {}
    for r in (out := queries.robust_cdf_score(spark, "/root/testdata/sf0.01").collect()):
        n[r["q_end"], r["input_id"]] = n.get((r["q_end"], r["input_id"]), 0) + 1
    assert min(n.values()) < 99 <= max(n.values())
    assert all(r["score"] is None for r in out if n[r["q_end"], r["input_id"]] < 99) and any(r["score"] is not None for r in out)


def test_gate_overrides(spark):
    rows_in = [(k, D(2026, 7, 1), 50.0, "PASS_KNOWABLE_AT_MODEL_DATE", 80.0, 10) for k in range(5)]
    gated = classify.publication_gate(spark.createDataFrame(rows_in, "issuer int, model_date date, candidate double, vintage string, confidence double, age_days int"))
    exclusions = spark.createDataFrame([(1, "ETF"), (2, "ETF"), (2, "FUND")], "issuer int, reason string")
    exceptions = spark.createDataFrame([(2, D(2026, 7, 1), "LATE"), (3, D(2026, 7, 1), "LATE"), (4, D(2026, 6, 1), "LATE")], "issuer int, model_date date, reason string")
    got = {r["issuer"]: (r["published"], r["data_status"], r["gate_reason"]) for r in classify.override_gate(gated, exclusions, exceptions).collect()}
    assert got[1] == (False, "EXCLUDED_PEER_GROUP", "ETF") and got[2] == got[3] == (False, "REVIEW_REQUIRED", "LATE")
    assert got[0] == got[4] and got[0][:2] == (True, "PARTIAL") and len(got) == 5


def test_coverage_keeps_zero_rows(spark):
    facts = spark.createDataFrame([(1, "x", "A", D(2026, 1, 1), D(2026, 3, 31)), (1, "x", "B", D(2026, 1, 1), D(2026, 3, 31)), (1, "x", "B", None, D(2026, 3, 31))], "issuer int, concept string, accession string, start date, end date")
    issuers, concepts = spark.createDataFrame([(1,), (2,)], "issuer int"), spark.createDataFrame([("x",), ("y",)], "concept string")
    out = scoring.acquisition_coverage(facts, issuers, concepts, issuers.where("issuer = 2"))
    missing = "MISSING_STANDARD_TAG_CANDIDATE"
    assert rows(out, *out.columns) == [(1, "x", 3, 2, 2, "ACQUIRED_REQUIRES_INLINE_CONTEXT_REVIEW"), (1, "y", 0, 0, 0, missing), (2, "x", 0, 0, 0, "DOWNLOAD_FAILED"), (2, "y", 0, 0, 0, "DOWNLOAD_FAILED")]
    met = spark.createDataFrame([(1, "F1", True), (2, "F1", True), (1, "F2", True), (2, "F2", False)], "issuer int, factor string, floor_met boolean")
    factors = spark.createDataFrame([("F1",), ("F2",), ("F3",)], "factor string")
    assert rows(scoring.factor_coverage(met, factors, 2), "factor", "companies", "coverage") == [("F1", 2, "PASS"), ("F2", 1, "PEER_GROUP_INSUFFICIENT"), ("F3", 0, "PEER_GROUP_INSUFFICIENT")]
    sleeves = spark.createDataFrame([("F4", "cash", "cfo", 0.15), ("F4", "cash", "fcf", 0.15), ("F4", "growth", "q", 0.25), ("F5", "only", "z", 1.0)], "factor string, sleeve string, input_id string, weight double")
    present = spark.createDataFrame([(1, "cfo", True), (1, "fcf", True), (1, "q", True), (2, "fcf", True), (2, "q", False)], "issuer int, input_id string, present boolean")
    assert rows(scoring.sleeve_coverage(present, sleeves), "issuer", "factor", "coverage") == [(1, "F4", 0.4), (1, "F5", 0.0), (2, "F4", 0.15), (2, "F5", 0.0)]


def test_contexts(spark):
    key = ("A1", "Revenues", D(2026, 4, 1), D(2026, 6, 30))
    cand = spark.createDataFrame([(*key, Decimal(v)) for v in (1, 2, 3, 4)], "accession string, local_concept string, start date, end date, value decimal(20,2)")
    inline = spark.createDataFrame(
        [(*key, Decimal(1), "c1", 0), (*key, Decimal(1), "c1", 0), (*key, Decimal(2), "c1", 1), (*key, Decimal(3), "c1", 0), (*key, Decimal(3), "c2", 0)],
        "accession string, local_concept string, start date, end date, value decimal(20,2), context_id string, dimensions int",
    )
    assert [x[1] for x in rows(contexts.match_contexts(cand, inline), "value", "match")] == ["EXACT", "ONLY_DIMENSIONED", "MULTIPLE_DEFAULT_CONTEXTS", "NO_MATCH"]


def test_numbers_from_text(spark):
    data = spark.createDataFrame([("(1,234.5)", -1234.5), ("−7", -7.0), ("$ 12", 12.0), ("—", None), ("", None), ("x1", None)], "t string, want double")
    for r in data.select(S.accounting_number(F.col("t")).cast("double").alias("got"), "want").collect():
        assert r["got"] == r["want"]
    assert column(spark, S.accounting_number(F.lit("2"), 3, F.lit("-"))) == -2000
    assert [column(spark, S.rounding_bound(F.lit(d))) for d in ("-3", "2", "INF")] == [500.0, 0.005, 0.0]


@pytest.mark.parametrize("days, name", [(70, "QUARTER"), (110, "QUARTER"), (111, "OTHER_DURATION"), (150, "HALF_YEAR_YTD"), (300, "NINE_MONTH_YTD"), (380, "FISCAL_YEAR"), (381, "OTHER_DURATION")])
def test_duration_classes(spark, days, name):
    assert column(spark, S.duration_class(F.lit(D(2020, 1, 1)), F.lit(D(2020, 1, 1) + dt.timedelta(days=days - 1)))) == name


def test_gates(spark):
    data = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        gates.require_unique(data, ("k",)).collect()
    assert gates.require_unique(data.distinct(), ("k",)).count() == 2
    assert rows(gates.missing_cells(data.distinct(), "k", "v"), "k", "v") == [(1, "b"), (2, "a")]
    refs = spark.createDataFrame([(["x", "y"],)], "refs array<string>")
    assert rows(gates.unresolved(refs, "refs", spark.createDataFrame([("x",)], "id string"), "id"), "id") == [("y",)]
    members = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(gates.with_missing_members(data.distinct(), members, "k", {"v": F.lit("none")}), "k", "v") == [(1, "a"), (2, "b"), (3, "none")]


def test_preamble_and_holdings(spark):
    good = 'Fund\nFund Holdings as of,"Sep 17, 2026"\n\nTicker,Name,Sector,Asset Class\nMSFT,"M, Inc",Tech,Equity\nMSFT,M,Tech,Equity\nUSD,Cash,,Cash\n\nfooter,a,b,c\n'
    files = spark.createDataFrame([("g", good), ("none", "a\nb\n"), ("ragged", good.replace("USD,Cash,,Cash", "USD,Cash"))], "file string, content string")
    got = landing.preamble_table(files, ("Ticker", "Name", "Sector", "Asset Class"))
    assert got.where("file = 'g'").count() == 3 and got.where("file = 'none'").first()["problem"] == "NO_HEADER"
    assert got.where("file = 'ragged' and problem = 'RAGGED_ROW'").count() == 1
    c = F.col("cells")
    held = got.where("file = 'g'").select(c["Ticker"].alias("symbol"), c["Name"].alias("name"), c["Sector"].alias("sector"), c["Asset Class"].alias("asset_class"))
    assert rows(landing.holding_classes(held, ("Tech",)), "symbol", "class") == [("MSFT", "DUPLICATE_SYMBOL"), ("MSFT", "DUPLICATE_SYMBOL"), ("USD", "NON_EQUITY")]


def test_typed_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_bytes("﻿id,v\n1,2.50\n2,x\n3,\n".encode())
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.DecimalType(10, 2))])
    good, bad = landing.typed_csv(spark, str(tmp_path / "a.csv"), schema)
    assert rows(good, "id", "v") == [(1, Decimal("2.50")), (3, None)] and rows(bad, "id", "rejected_columns") == [("2", "v")]


def test_snapshots(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert tables.fingerprint(a).first() == tables.fingerprint(a.orderBy(F.desc("k"))).first()
    tables.freeze_snapshot({"a": a}, "2026-07-31", str(tmp_path))
    assert tables.verify_snapshot(spark, "2026-07-31", str(tmp_path)).count() == 0
    with pytest.raises(Exception):
        tables.freeze_snapshot({"a": a}, "2026-07-31", str(tmp_path))
    with pytest.raises(ValueError, match="no rows"):
        tables.write_table(a.where("k > 9"), str(tmp_path / "empty"))


def test_late_amendment_in_a_stream(spark, tmp_path):
    """Amendments that come late, and a batch without news: only changed keys are written, the latest vintage wins."""
    schema = "issuer string, report_period date, available date, accepted string, accession string, value int"
    data = [("A", D(2023, 3, 31), D(2023, 5, 1), "1", "a", 1), ("A", D(2023, 3, 31), D(2023, 6, 1), "2", "b", 2), ("A", D(2023, 3, 31), D(2023, 5, 2), "3", "c", 3), ("B", D(2023, 3, 31), D(2023, 5, 2), "3", "d", 4)]
    got = None
    for n, one in enumerate(data):
        spark.createDataFrame([one], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        arrivals.maintain_latest(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        got = arrivals.latest(spark, str(tmp_path / "state"))
        want = [("a", 1)] if n == 0 else [("b", 2)] if n < 3 else [("b", 2), ("d", 4)]
        assert sorted(rows(got, "accession", "value")) == want


def test_normal_distribution_function(spark):
    z = [-4.0, -3.0, -1.234, -1e-9, 0.0, 0.5, 2.71, 3.0, 4.0, None]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.normal_cdf("z").alias("p")).collect()
    assert all((r["p"] is None) if r["z"] is None else abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 1e-14 for r in got)


def test_second_route_finds_what_windows_give(spark):
    """Trailing sums by calendar arithmetic equal the windows in a series with holes."""
    quarters = [q for q in range(30) if q not in (7, 8, 19)]
    data = [("A", "revenue", D(2015 + q // 4, 3 * (q % 4) + 1, 1), q * q % 17) for q in quarters]
    cells = spark.createDataFrame(data, "issuer string, concept string, q_start date, value int").select("issuer", "concept", "q_start", F.last_day(F.add_months("q_start", 2)).alias("q_end"), F.quarter("q_start").alias("fiscal_quarter"), F.col("value").cast("decimal(28,4)").alias("value"))
    stored = timeseries.year_over_year(timeseries.trailing(timeseries.mark_runs(cells)))
    out = diagnostics.compare_routes(stored, diagnostics.derive_again(cells), ("ttm", "prior_ttm", "prior_q"))
    assert rows(out.groupBy("rederivation").count(), "rederivation", "count") == [("MATCH", 27)]
    assert out.where("ttm is not null").count() == 18 and out.where("prior_ttm is not null").count() == 6
    spoilt = stored.withColumn("prior_q", F.lit(None).cast("decimal(28,4)"))
    assert diagnostics.compare_routes(spoilt, diagnostics.derive_again(cells), ("ttm", "prior_q")).where("rederivation = 'MISMATCH_PRIOR_Q'").count() == 15


def test_nine_quarters_must_be_consecutive_and_current(spark):
    day = lambda q: D(2020 + q // 4, 3 * (q % 4) + 1, 1)
    held = {"whole": range(3, 12), "old": range(1, 10), "hole": [1, 2, 3, 5, 6, 7, 8, 9, 10, 11], "short": range(5, 12)}
    q = spark.createDataFrame([(k, day(x)) for k, v in held.items() for x in v], "issuer string, q_start date").withColumn("q_end", F.last_day(F.add_months("q_start", 2)))
    t = spark.createDataFrame([(k, D(2022, 12, 31)) for k in (*held, "none")], "issuer string, report_period date")
    got = dict(rows(diagnostics.nine_current(q, t), "issuer", "current"))
    assert got == {"whole": "PASS", "old": "NOT_CURRENT", "hole": "NOT_NINE_CONSECUTIVE", "short": "NOT_NINE_CONSECUTIVE", "none": "NO_VALIDATED_QUARTERS"}


def test_extra_week_example(spark):
    """140 over 14 weeks against 126 over 13: reported 11.1 per cent, at equal length some 3.2."""
    r = spark.createDataFrame([(D(2024, 9, 29), D(2025, 1, 4), 140, D(2023, 10, 1), D(2023, 12, 30), 126)], "s date, e date, v int, s0 date, e0 date, v0 int")
    now, before, more = diagnostics.extra_week(F.col("s"), F.col("e"), F.col("s0"), F.col("e0"))
    rate = diagnostics.per_day(F.col("v"), F.col("s"), F.col("e"), 91) / diagnostics.per_day(F.col("v0"), F.col("s0"), F.col("e0"), 91) - 1
    got = r.select(now, before, more, F.round(rate, 4)).first()
    assert tuple(got) == (True, False, 7, 0.0317)


def test_diagnostic_classes(spark):
    pairs = [(2.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -2.0), (5.0, 0.0), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").select(diagnostics.transformation_choice(F.col("a"), F.col("b"), 0.1)).collect()]
    assert got == ["PERCENT_CHANGE", "SIGN_CHANGE_TO_POSITIVE", "SIGN_CHANGE_TO_NEGATIVE", "LEVEL_CHANGE_BOTH_NEGATIVE", "STABLE_DENOMINATOR_SCALED", "UNAVAILABLE"]
    ages = [(100, False), (200, False), (300, True), (400, False), (None, False)]
    got = [r[0] for r in spark.createDataFrame(ages, "age int, near boolean").select(diagnostics.employee_weight(F.col("age"), F.col("near"))).collect()]
    assert got == [1.0, 0.75, 0.4, 0.0, None]
    bands = [r[0] for r in spark.createDataFrame([(85.0,), (70.0,), (55.0,), (54.9,), (None,)], "v double").select(diagnostics.confidence_band(F.col("v"))).collect()]
    assert bands == ["HIGH", "USABLE_WITH_LIMITATIONS", "REVIEW_REQUIRED", "INSUFFICIENT", None]
    lost = spark.range(1).select(diagnostics.deducted(F.lit(30.0), (F.lit(True), 20.0), (F.lit(True), 15.0)), diagnostics.deducted(F.lit(30.0), (F.lit(False), 20.0))).first()
    assert tuple(lost) == (0.0, 30.0)
    U, A, N, I = "SUPPORTIVE", "ADVERSE", "NEUTRAL", "INELIGIBLE"
    data = [(-0.1, U, U, U, U), (0.1, U, U, U, N), (0.1, N, N, A, N), (0.1, U, U, A, U), (None, U, U, U, U), (0.1, I, U, U, U)]
    name, points = diagnostics.capex_class(*[F.col(c) for c in ("d", "growth", "profit", "cash", "margin")])
    got = rows(spark.createDataFrame(data, "d double, growth string, profit string, cash string, margin string").select(name.alias("n"), points.alias("p")), "n", "p")
    assert got == [("AMBIGUOUS", 50.0), ("CASH_BURDEN", 25.0), ("EFFICIENCY_SUPPORT", 65.0), ("INELIGIBLE", None), ("INELIGIBLE", None), ("INVESTMENT_SUPPORT", 60.0)]
    back = diagnostics.transitions(spark.createDataFrame([("A", k, x) for k, x in enumerate("UDUUD")], "issuer string, t int, s string"), "s", "t")
    assert sorted(rows(back, "previous", "current", "n", "reversals")) == [("D", "U", 1, 1), ("U", "D", 2, 0), ("U", "U", 1, 0)]


def test_register_keeps_what_the_summary_lacks(spark):
    register = spark.createDataFrame([("A", "old", 1), ("B", "old", 2)], "issuer string, state string, n int")
    summary = spark.createDataFrame([("A", "new", None), ("C", "new", 9)], "issuer string, state string, n int")
    got = sorted(rows(diagnostics.update_register(register, summary, "issuer", ("state", "n")), "issuer", "state", "n"))
    assert got == [("A", "new", 1), ("B", "old", 2)]


def test_too_many_dates_for_one_as_of_join(spark, monkeypatch):
    monkeypatch.setattr(pit, "MAX_DATES", 3)
    dates = spark.range(4).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("model_date"))
    facts = spark.createDataFrame([("A", D(2019, 1, 1), "1", "a", 1)], "issuer string, available date, accepted string, accession string, value int")
    assert pit.as_known_on(facts, dates.limit(3), ("issuer",)).count() == 3
    with pytest.raises(ValueError, match="more than 3 dates"):
        pit.as_known_on(facts, dates, ("issuer",))
