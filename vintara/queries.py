"""Registered panel queries. Each takes (spark, sf_dir), reads the driver tables and returns a DataFrame; see ``oracle`` for their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara import history_queries, matrix_queries, oracle, record_queries, stage_oracle, stage_queries
from vintara.functions import scalars as S
from vintara.functions import trading_days
from vintara.operators import classify, contexts, gates, lineage, peers, periods, pit, scoring, timeseries
from vintara.plans import bridge, policy, stages
from vintara.plans.bridge import MODEL_DATE, table
from vintara.plans.settle import once, settle, shared_folder
from vintara.sources import landing, tables
from vintara.streaming import arrivals

FLAGSHIP = "ttm_yoy_percentile"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def dec(column: str | Column, name: str | None = None) -> Column:
    """A rate or score as DECIMAL(18,9), for exact comparison."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(18,9)").alias(name or column)


def big(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("long").alias(name or column)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing sums and yearly changes of the panel, built once a session."""
    return once(spark, ("changes", sf_dir), lambda: timeseries.year_over_year(timeseries.trailing(timeseries.mark_runs(bridge.quarter_cells(spark, sf_dir)))))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_end, issuer, input_id, value) of trailing growth rates: the peer groups are (q_end, input_id)."""
    rows = changes(spark, sf_dir).where("ttm_yoy is not null")
    return once(spark, ("metrics", sf_dir), lambda: rows.select("q_end", "issuer", F.concat("concept", F.lit("_ttm_yoy")).alias("input_id"), F.round("ttm_yoy", 3).alias("value")))


@query
def ttm_yoy_percentile(spark, sf_dir):
    """Trailing-year revenue growth of each supplier and quarter, ranked among peers."""
    rows = settle(changes(spark, sf_dir).where("concept = 'revenue' and ttm_yoy is not null").select("issuer", "q_end", "ttm", "ttm_yoy"))
    ranked = peers.midrank_percentiles(rows, ("q_end",), "ttm_yoy")
    return ranked.select("issuer", "q_end", "ttm", dec("ttm_yoy"), dec("midrank"), dec("percentile"), big("peers"))


@query
def gap_run_islands(spark, sf_dir):
    """Runs of consecutive quarters in the sparse customer panel, and which rows end an unbroken window of four."""
    rows = timeseries.mark_runs(bridge.customer_cells(spark, sf_dir))
    return rows.select("issuer", "q_end", big("run"), timeseries.whole(4).alias("whole4"))


@query
def yoy_safe_change(spark, sf_dir):
    rows = changes(spark, sf_dir)
    return rows.select("issuer", "concept", "q_end", dec("q_yoy"), "q_yoy_change", "q_yoy_method", dec("ttm_yoy"), "ttm_yoy_change", "ttm_yoy_method")


@query
def acceleration(spark, sf_dir):
    rows = timeseries.acceleration(timeseries.acceleration(changes(spark, sf_dir), "q_yoy"), "ttm_yoy")
    return rows.select("issuer", "concept", "q_end", dec("q_yoy_acceleration"), "q_yoy_acceleration_change", "q_yoy_acceleration_method", dec("ttm_yoy_acceleration"), "ttm_yoy_acceleration_method")


@query
def qoq_and_rollforward(spark, sf_dir):
    rows = timeseries.roll_forward(timeseries.quarter_on_quarter(changes(spark, sf_dir)))
    return rows.select("issuer", "concept", "q_end", dec("qoq"), "qoq_change", "rollforward")


@query
def fcf_self_join(spark, sf_dir):
    rows = timeseries.free_cash_flow(bridge.quarter_cells(spark, sf_dir)).where("concept = 'free_cash_flow'")
    return rows.select("issuer", "q_start", "q_end", "value")


@query
def ttm_margins(spark, sf_dir):
    rows = timeseries.margins(bridge.quarter_cells(spark, sf_dir), "operating_income")
    return rows.select("issuer", "q_end", dec("margin"), dec("prior_margin"), dec("yoy_pp"), dec("acceleration_pp"))


@query
def leverage_spread(spark, sf_dir):
    return timeseries.leverage_spread(changes(spark, sf_dir)).select("issuer", "q_end", dec("spread"))


@query
def observation_audit(spark, sf_dir):
    rows = timeseries.audit(timeseries.roll_forward(changes(spark, sf_dir)))
    return rows.select("issuer", "concept", big("quarters"), big("q_yoy_count"), big("ttm_yoy_count"), big("rollforward_failures"), "latest_method")


@query
def persistence_pattern(spark, sf_dir):
    rows = timeseries.growth_history(changes(spark, sf_dir).where("concept = 'revenue'")).where("history is not null")
    return rows.select("issuer", "q_end", big(F.size("history"), "values"), S.persistence_pattern(F.col("history")).alias("pattern"))


@query
def persistence_score(spark, sf_dir):
    rows = timeseries.growth_history(changes(spark, sf_dir)).where("history is not null and concept in ('revenue', 'operating_income')")
    band = F.when(F.col("concept") == "revenue", policy.NEUTRAL_BANDS["growth"]).otherwise(policy.NEUTRAL_BANDS["profit"])
    return rows.select("issuer", "concept", "q_end", dec(S.persistence_score(F.col("history"), band, policy.RECENCY_WEIGHTS), "score"))


@query
def quarters_from_ytd(spark, sf_dir):
    rows = periods.standalone_quarters(bridge.ytd_facts(spark, sf_dir))
    return rows.select("issuer", "fy_start", big("fiscal_quarter"), "q_start", "q_end", "value", "method", "status", "reason", F.col("delta").cast("decimal(28,4)").alias("delta"), "available")


@query
def quarter_audit(spark, sf_dir):
    rows = periods.quarter_audit(periods.standalone_quarters(bridge.ytd_facts(spark, sf_dir)))
    return rows.select("issuer", big("direct"), big("reconciled"), big("derived"), big("conflicts"), big("missing"), "first_end", "last_end", "governance")


@query
def ytd_identities(spark, sf_dir):
    return periods.ytd_identities(bridge.ytd_facts(spark, sf_dir)).select("issuer", "fy_start", "class", "identity_ok")


@query
def vintage_latest(spark, sf_dir):
    rows = pit.latest_vintage(pit.eligible(bridge.filings(spark, sf_dir), "2000-12-31"))
    return rows.select("issuer", "report_period", "accession", "form", "available", "value")


@query
def vintage_conflict(spark, sf_dir):
    """Customer and month keys whose latest filing date carries several values."""
    rows = bridge.filings(spark, sf_dir).withColumn("available", F.last_day("available"))
    kinds = pit.latest_values(rows, ("issuer", "report_period")).where("values > 0")
    return kinds.select("issuer", "report_period", F.when(F.col("values") == 1, "SELECTED").otherwise("CONFLICT").alias("outcome"), "values")


@query
def restatements(spark, sf_dir):
    rows = pit.restatements(bridge.filings(spark, sf_dir), ("issuer", "report_period"))
    return rows.select("issuer", "report_period", "first_value", "last_value", big("vintages"), F.col("restated_by").cast("decimal(18,2)").alias("restated_by"), dec("restated_share"), "differs")


@query
def last_n_periods(spark, sf_dir):
    rows = pit.last_periods(pit.latest_vintage(pit.eligible(bridge.filings(spark, sf_dir), "2001-12-31")), 12)
    return rows.select("issuer", "report_period", "accession", big("sequence"))


@query
def filing_history_audit(spark, sf_dir):
    rows = pit.last_periods(pit.latest_vintage(pit.eligible(bridge.filings(spark, sf_dir), "2001-12-31")), 12)
    return pit.history_audit(rows).select("issuer", big("quarterly"), big("yearly"), big("span_days"), "history")


@query
def filing_rows(spark, sf_dir):
    rows = gates.filing_row(bridge.filings(spark, sf_dir), F.lit("2000-06-30").cast("date"))
    return rows.select("accession", "form", "is_amendment", "eligible", "exclusion", "consistent")


@query
def as_known_on(spark, sf_dir):
    """What was known of each customer and period on three dates at once."""
    dates = spark.createDataFrame([("1999-12-31",), ("2000-12-31",), ("2001-06-30",)], "d string").select(F.col("d").cast("date").alias("model_date"))
    rows = pit.as_known_on(bridge.filings(spark, sf_dir), dates, ("issuer", "report_period"))
    return rows.select("model_date", "issuer", "report_period", "accession", "value")


@query
def scd2_asof(spark, sf_dir):
    """Customers' market segments as slowly changing rows (a change at each order), in force on a day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderdate").cast("date").alias("valid_from"), "o_orderpriority", "o_orderkey")
    daily = o.groupBy("issuer", "valid_from").agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    history = daily.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("issuer").orderBy("valid_from")))
    return pit.valid_on(history, "2000-01-01").select("issuer", "priority", "valid_from", "valid_to")


@query
def priority_choice(spark, sf_dir):
    """Line prices by part and quarter: the brand class decides the priority, the same priority with several values is a conflict."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.trunc("l_shipdate", "month").alias("month"), F.col("l_quantity").cast("decimal(12,2)").alias("value"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).cast("int").alias("priority"))
    rows = pit.choose_by_priority(line.join(part, "l_partkey"), ("l_suppkey", "month"))
    return rows.groupBy("l_suppkey", "month").agg(*[big(F.count_if(F.col("choice") == c), c.lower()) for c in ("SELECTED", "CONFLICT", "SUPERSEDED")])


@query
def availability_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    rows = trading_days.availability(events, trading_days.trading_calendar(spark), "ts")
    return rows.select("event_id", F.to_date("local_time").alias("local_date"), "buffer_day", "available_date")


@query
def last_session_asof(spark, sf_dir):
    """The last session that had closed when each event happened, asked for the latest and for the day three days before."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("now"))
    asked = events.withColumn("requested", F.when(F.col("event_id") % 2 == 0, F.lit(None).cast("date")).otherwise(F.date_sub(F.to_date(F.from_utc_timestamp("now", trading_days.ZONE)), 3)))
    rows = trading_days.resolve_requests(asked, trading_days.trading_calendar(spark, extra_closures=True), "requested", "now")
    return rows.select("event_id", "effective_date", "adjusted", "reason")


@query
def context_match_cardinality(spark, sf_dir):
    """Order lines as candidate facts, matched on order, part and exact quantity; a line's number is its context, odd suppliers are dimensions."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accession"), (F.col("l_partkey") % 5).cast("string").alias("local_concept"), F.trunc("l_shipdate", "year").alias("start"), F.last_day("l_shipdate").alias("end"),
        F.col("l_quantity").cast("decimal(20,2)").alias("value"), F.concat_ws("-", "l_suppkey", "l_linenumber").alias("context_id"), (F.col("l_suppkey") % 2).alias("dimensions"),
    )
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("accession"))
    candidates = line.join(orders, "accession", "left_semi").select(*contexts.MATCH).distinct()
    rows = contexts.match_contexts(candidates, line.where("dimensions = 0 or accession % 4 > 0"))
    return rows.groupBy("match").agg(big(F.count(F.lit(1)), "candidates"), big(F.sum("contexts"), "contexts"), F.max("context_id").alias("last_context"))


@query
def identity_0_1_many(spark, sf_dir):
    """Requested names against customers: nation and segment stand for a symbol, so many are ambiguous and invented ones unknown."""
    c = table(spark, sf_dir, "customer")
    symbols = c.select(F.concat_ws("-", "c_nationkey", "c_mktsegment", F.col("c_custkey") % 7).alias("symbol"), F.col("c_custkey").alias("entity"))
    asked = c.select(F.concat_ws("-", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit(99)).otherwise(F.col("c_custkey") % 7)).alias("symbol")).distinct()
    return contexts.resolve_identity(asked, symbols).select("symbol", "entity", big("candidates"), "resolution")


@query
def requested_selection(spark, sf_dir):
    """Requested suppliers in their order, with results where there are any."""
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("issuer")).agg(F.count(F.lit(1)).alias("lines")).withColumn("status", F.lit("SCORED"))
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("issuer"), F.col("s_suppkey").alias("pos"))
    return contexts.select_requested(asked, results, "issuer").select("issuer", "pos", big("lines"), "status")


@query
def batch_slice(spark, sf_dir):
    rows = contexts.batch_slices(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 4)
    return rows.select(big("s_nationkey"), "s_suppkey", big("position"), big("batch"))


@query
def set_and_key_gates(spark, sf_dir):
    """Suppliers without a line, lines without a supplier, repeated order keys, and missing cells of the supplier by quarter rectangle, as counts."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    sides = gates.set_difference(line.select((F.col("l_suppkey") + 1).alias("k")), supplier.select(F.col("s_suppkey").alias("k")), ("k",))
    copies = gates.duplicates(line, ("l_orderkey", "l_linenumber"))
    cells = bridge.quarter_cells(spark, sf_dir).where("concept = 'revenue'").select("issuer", "q_end")
    holes = gates.missing_cells(cells, "issuer", "q_end")
    count = lambda rows, name: rows.agg(F.lit(name).alias("gate"), big(F.count(F.lit(1)), "broken"))
    return count(sides.where("side = 'LEFT_ONLY'"), "left_only").unionByName(count(sides.where("side = 'RIGHT_ONLY'"), "right_only")).unionByName(count(copies, "duplicate_key")).unionByName(count(holes, "missing_cell"))


@query
def fallback_union(spark, sf_dir):
    """Revenue from odd-month orders, and from any order for customers that have none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("decimal(12,2)").alias("value"))
    first = o.where("month in (1, 7)").groupBy("issuer").agg(F.sum("value").alias("value")).withColumn("source", F.lit("FIRST"))
    second = o.groupBy("issuer").agg(F.sum("value").alias("value")).withColumn("source", F.lit("SECOND"))
    return gates.fallback_union(first, second, ("issuer",)).select("issuer", F.col("value").cast("decimal(28,2)").alias("value"), "source")


@query
def cell_diff(spark, sf_dir):
    """Orders against an edited copy: changed totals, changed status, dropped rows; equal numbers written differently are no change."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("total"), F.col("o_orderstatus").alias("status"))
    new = o.where("k % 97 <> 0").select("k", F.when(F.col("k") % 50 == 0, F.lit("0.00")).when(F.col("k") % 3 == 0, F.concat("total", F.lit("0"))).otherwise(F.col("total")).alias("total"), F.when(F.col("k") % 41 == 0, "X").otherwise(F.col("status")).alias("status"))
    return gates.cell_differences(o, new, ("k",))


@query
def row_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    new = o.where("k % 97 <> 0").select("k", F.when(F.col("k") % 50 == 0, F.lit(0.0)).otherwise(F.col("total")).alias("total"), F.when(F.col("k") % 41 == 0, "X").otherwise(F.col("status")).alias("status"))
    return gates.row_differences(o, new, ("k",), 10)


def observed(spark, sf_dir) -> DataFrame:
    """Observations with knowledge dates and lineage; some are made to break a rule, by their keys."""
    rows = timeseries.roll_forward(changes(spark, sf_dir))
    day = F.lit(MODEL_DATE).cast("date")
    code = F.pmod(F.col("issuer") * 7 + F.year("q_end") * 4 + F.quarter("q_end"), F.lit(13))
    return rows.select(
        "issuer", "concept", "q_end", "value", "rollforward", F.when(code == 1, F.date_sub(day, 1)).otherwise(day).alias("model_date"), F.date_add("q_end", F.when(code == 2, -5).otherwise(20)).alias("available"),
        F.when(code == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("row"))).alias("lineage"), F.when(code == 4, "REVIEW").otherwise("PASS_DIRECT").alias("status"),
    )


@query
def first_failing_reason(spark, sf_dir):
    rows = observed(spark, sf_dir)
    return rows.select("issuer", "concept", "q_end", gates.observation_reason(F.lit(MODEL_DATE).cast("date")).alias("reason"))


@query
def metric_eligibility(spark, sf_dir):
    """Why each trailing growth of the latest periods may not enter its peer distribution, under each age scenario."""
    rows = changes(spark, sf_dir).where("ttm_yoy_method is not null").select(
        "issuer", F.concat("concept", F.lit("_ttm_yoy")).alias("input_id"), "q_end", F.coalesce("ttm_yoy", F.col("ttm_yoy_change").cast("double")).alias("value"), F.col("ttm_yoy_method").alias("transformation"),
        F.date_add("q_end", 20).alias("available"), F.lit(MODEL_DATE).cast("date").alias("model_date"), F.lit(True).alias("eligible"), F.date_diff(F.lit(MODEL_DATE).cast("date"), F.date_add("q_end", 20)).alias("age_days"),
    )
    rows = rows.join(F.broadcast(policy.metric_transformations(spark)), "input_id", "left").crossJoin(F.broadcast(policy.normalization_scenarios(spark).select("scenario", "excluded_days").where("scenario in ('BASELINE', 'AGE_90_150', 'AGE_150_210')")))
    reason = gates.metric_reason(F.lit(MODEL_DATE).cast("date"), F.col("excluded_days"))
    return rows.groupBy("scenario", "input_id", F.coalesce(reason, F.lit("ELIGIBLE")).alias("reason")).agg(big(F.count(F.lit(1)), "n"))


def families(spark, sf_dir) -> DataFrame:
    """Per issuer and quarter: class of each family from the directions of its members."""
    band = policy.NEUTRAL_BANDS
    wide = changes(spark, sf_dir).groupBy("issuer", "q_end").agg(*[F.max(F.when(F.col("concept") == c, F.col(m))).alias(f"{a}_{m}") for c, a in (("revenue", "rev"), ("operating_income", "op"), ("cash_from_operations", "cfo")) for m in ("q_yoy", "ttm_yoy")])
    m = timeseries.margins(bridge.quarter_cells(spark, sf_dir), "operating_income").select("issuer", "q_end", "yoy_pp", "acceleration_pp")
    rows = wide.join(m, ["issuer", "q_end"], "left")
    growth = S.reconcile_directions([S.direction(F.col("rev_ttm_yoy"), band["growth"]), S.direction(F.col("rev_q_yoy"), band["growth"])])
    profit = F.when(F.col("op_ttm_yoy").isNull(), S.INELIGIBLE).otherwise(S.reconcile_directions([S.direction(F.col("op_ttm_yoy"), band["profit"]), S.direction(F.col("yoy_pp"), band["margin"])]))
    return rows.withColumn("growth", growth).withColumn("profit", profit).withColumn("cash", S.direction(F.col("cfo_ttm_yoy"), band["cash"])).withColumn("margin", S.direction(F.col("yoy_pp"), band["margin"]))


@query
def direction_families(spark, sf_dir):
    rows = families(spark, sf_dir)
    index, _, n = classify.direction_index(F.array("growth", "profit", "cash", "margin"))
    return rows.select("issuer", "q_end", "growth", "profit", "cash", "margin", dec(index, "direction_index"), big(n, "eligible"))


@query
def breadth_conflict_scenarios(spark, sf_dir):
    long = families(spark, sf_dir).select("issuer", "q_end", "growth", "profit", "cash", "margin").unpivot(["issuer", "q_end"], ["growth", "profit", "cash", "margin"], "family", "class")
    rows = long.crossJoin(F.broadcast(policy.score_scenarios(spark).select("scenario", "conflict")))
    out = scoring.breadth(rows, "conflict", ("scenario", "issuer", "q_end"))
    return out.select("scenario", "issuer", "q_end", big("families"), dec("breadth_score"))


@query
def coverage_by_transformation(spark, sf_dir):
    rows = changes(spark, sf_dir).where("ttm_yoy_method is not null").select("issuer", F.concat("concept", F.lit("_ttm_yoy")).alias("input_id"), F.col("ttm_yoy_method").alias("transformation"), F.lit(True).alias("eligible"))
    return scoring.peer_coverage(rows, 50).select("input_id", "transformation", big("peers"), "coverage")


@query
def company_coverage(spark, sf_dir):
    """Weight of the components that each issuer has in its latest quarter, by factor."""
    last = changes(spark, sf_dir).groupBy("issuer", "concept").agg(F.max_by("q_yoy", "q_end").alias("q"), F.max_by("ttm_yoy", "q_end").alias("t"))
    alias = F.when(F.col("concept") == "cash_from_operations", "cfo").when(F.col("concept") == "capital_expenditures", "capex").otherwise(F.col("concept"))
    long = last.withColumn("a", alias).unpivot(["issuer", "a"], ["q", "t"], "basis", "value")
    inputs = long.select("issuer", F.concat_ws("_", "a", F.when(F.col("basis") == "q", "q_yoy").otherwise("ttm_yoy")).alias("input_id"), F.col("value").isNotNull().alias("eligible"))
    return scoring.company_coverage(inputs, policy.factor_components(spark)).select("issuer", "factor", dec("coverage"))


@query
def midrank_percentile(spark, sf_dir):
    ranked = peers.midrank_percentiles(metrics(spark, sf_dir), ("q_end", "input_id"), "value")
    return ranked.select("q_end", "issuer", "input_id", dec("value"), big("ties"), big("peers"), dec("midrank"), dec("percentile"))


@query
def mad_robust_z(spark, sf_dir):
    rows = peers.robust_z(metrics(spark, sf_dir), ("q_end", "input_id"), "value")
    return rows.select("q_end", "issuer", "input_id", dec("center"), dec("mad"), dec("z"))


@query
def robust_cdf_score(spark, sf_dir):
    """The capped z as a score of 0 to 100 through the normal distribution function, null below the baseline's minimum of peers."""
    group = ("q_end", "input_id")
    rows = peers.robust_z(metrics(spark, sf_dir), group, "value")
    rows = peers.withhold(rows, group, "value", ("z",), policy.normalization_scenarios(spark).where("scenario = 'BASELINE'"))
    return rows.select("q_end", "issuer", "input_id", (100 * S.normal_cdf("z")).cast("decimal(18,6)").alias("score"))


@query
def winsor_scenarios(spark, sf_dir):
    """Clipped values and peer-extreme flags under each winsor scenario, from one ranking of the peers."""
    rows = metrics(spark, sf_dir)
    group = ("q_end", "input_id")
    cuts = peers.quantiles(peers.distribution(rows, group, "value"), group, "value", {"p025": 0.025, "p975": 0.975, "p05": 0.05, "p95": 0.95})
    limits = cuts.select(*group, F.inline(F.array(F.struct(F.lit("WINSOR_2_5_97_5").alias("scenario"), F.col("p025").alias("low"), F.col("p975").alias("high")), F.struct(F.lit("WINSOR_5_95").alias("scenario"), F.col("p05").alias("low"), F.col("p95").alias("high")))))
    long = rows.crossJoin(F.broadcast(spark.createDataFrame([("WINSOR_2_5_97_5",), ("WINSOR_5_95",)], "scenario string")))
    out = peers.winsorize(long, ("q_end", "input_id", "scenario"), "value", limits).join(cuts.select(*group, "p025", "p975"), list(group))
    return out.select("scenario", "q_end", "issuer", "input_id", dec("clipped"), ((F.col("value") < F.col("p025")) | (F.col("value") > F.col("p975"))).alias("extreme"))


@query
def spearman_sensitivity(spark, sf_dir):
    """Rank correlation of quarterly and trailing growth, and how far percentiles move between them, by period."""
    rows = settle(changes(spark, sf_dir).where("concept = 'revenue' and q_yoy is not null and ttm_yoy is not null").select("q_end", "issuer", F.round("q_yoy", 2).alias("a"), F.round("ttm_yoy", 2).alias("b")))
    rho = peers.spearman(rows, ("q_end",), "a", "b")
    both = peers.midrank_percentiles(rows, ("q_end",), "a").select("q_end", "issuer", "b", F.col("percentile").alias("pa"))
    both = peers.midrank_percentiles(both, ("q_end",), "b").select("q_end", "pa", F.col("percentile").alias("pb"))
    move = F.abs(F.col("pa") - F.col("pb"))
    moved = both.groupBy("q_end").agg(F.avg(move).alias("mean_move"), F.max(move).alias("max_move"), F.count_if(move > 10).alias("over_10"))
    return rho.join(moved, "q_end").select("q_end", big("n"), F.col("rho").cast("decimal(18,6)").alias("rho"), F.col("mean_move").cast("decimal(18,6)").alias("mean_move"), F.col("max_move").cast("decimal(18,6)").alias("max_move"), big("over_10"))


@query
def peer_fallback(spark, sf_dir):
    """The narrowest of nation, region and all with enough suppliers, for each metric and quarter."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    home = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("issuer"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.lit("all").alias("everyone"))
    rows = metrics(spark, sf_dir).join(home, "issuer")
    out = peers.narrowest_peer_group(rows, "value", (("NATION", "nation", 4), ("REGION", "region", 10), ("ALL", "everyone", 20)), ("q_end", "input_id"))
    return out.select("q_end", "issuer", "input_id", "level", "level_key", big("level_peers"))


@query
def score_bands(spark, sf_dir):
    ranked = peers.midrank_percentiles(metrics(spark, sf_dir), ("q_end", "input_id"), "value")
    return ranked.groupBy("input_id", classify.score_band(F.col("percentile"), policy.SCORE_BANDS).alias("band")).agg(big(F.count(F.lit(1)), "n"))


def scored(spark, sf_dir) -> DataFrame:
    """(q_end, issuer, input_id, score): percentiles of each quarter for the inputs that the panel has."""
    m = stage_queries.Method(spark, sf_dir)
    place = F.col("before") + (F.col("ties") + 1) / 2.0
    return peers.rank_rows(m.usable, ("q_end", "input_id"), "value", m.small()).select("q_end", "issuer", "input_id", (100.0 * (place - 0.5) / F.col("peers")).alias("score"))


@query
def weighted_factor_scores(spark, sf_dir):
    """Factor scores of each supplier and quarter with their coverage, before any floor or hold."""
    names = [n for n, _ in policy.TRANSFORMATIONS]
    wide = scored(spark, sf_dir).repartition(*stages.KEYS).groupBy(*stages.KEYS).agg(*[F.max(F.when(F.col("input_id") == n, F.col("score"))).alias(n) for n in names])
    each = [F.struct(F.lit(factor).alias("factor"), *[told[c].alias(c) for c in ("factor_score", "original_coverage", "applied_coverage", "families")]) for factor, told in scoring.scores_of_row({n: F.col(n) for n in names}).items()]
    out = wide.select(*stages.KEYS, F.inline(F.array(*each)))
    return out.select("q_end", "issuer", "factor", dec("factor_score"), dec("original_coverage"), dec("applied_coverage"), F.array_join("families", "|").alias("families"))


@query
def confidence_bounds(spark, sf_dir):
    audit = timeseries.audit(timeseries.roll_forward(changes(spark, sf_dir))).where("concept = 'revenue'")
    evidence = audit.select("issuer", F.try_divide(F.col("ttm_yoy_count").cast("double"), F.col("quarters").cast("double")).alias("coverage"), (F.col("issuer") % 2 == 0).alias("derived_q4"), (F.col("quarters") < 25).alias("stale"))
    return scoring.confidence(evidence).select("issuer", dec("coverage"), dec("confidence_low"), dec("confidence_high"))


@query
def publication_gate(spark, sf_dir):
    """Which orders' scores may be published: the total stands for a candidate, the line count for confidence, ship dates for age."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last"), F.count(F.lit(1)).alias("lines"))
    o = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")).alias("candidate"), F.when(F.col("o_orderstatus") == "P", "FUTURE_FILING").otherwise("PASS_KNOWABLE_AT_MODEL_DATE").alias("vintage"),
        (F.col("lines") * 20).cast("double").alias("confidence"), F.date_diff(F.lit("2001-12-31").cast("date"), F.col("last")).alias("age_days"),
    )
    return classify.publication_gate(rows).groupBy("published", "data_status", "gate_reason").agg(big(F.count(F.lit(1)), "n"))


@query
def component_completeness(spark, sf_dir):
    """Quantity by order over part types, only where three types are all there."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).cast("string").alias("component"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("decimal(12,2)").alias("value"))
    out = scoring.complete_sum(line.join(part, "l_partkey"), ("l_orderkey",), ("0", "1", "2"))
    return out.select("l_orderkey", F.col("total").cast("decimal(28,2)").alias("total"), "missing")


def cited(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.trunc("l_shipdate", "quarter").alias("q_start"), F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("decimal(12,2)").alias("value"), F.col("l_shipdate").cast("date").alias("available"))
    return lineage.collect_parents(line, ("issuer", "q_start"), ("accession", "line", "value"), "value")


@query
def lineage_collect(spark, sf_dir):
    rows = cited(spark, sf_dir)
    return rows.select("issuer", "q_start", F.col("value").cast("decimal(28,2)").alias("value"), big("parent_count"), F.array_join(F.transform("parent_ids", lambda x: x.cast("string")), "|").alias("parent_ids"), "signal_available")


@query
def vintage_audit(spark, sf_dir):
    filings = bridge.filings(spark, sf_dir).select("accession", "available")
    parents = lineage.audit_parents(cited(spark, sf_dir), filings, "2000-06-30")
    return lineage.company_summary(parents).select("issuer", big("parents"), big("failures"))


@query
def cited_once(spark, sf_dir):
    """Each order's total against the orders of its customer and day: exactly one of equal value passes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"))
    out = lineage.cite_once(o, o.withColumnRenamed("total", "source_total").drop("o_orderkey"), ("o_custkey", "day"), "total", "source_total")
    return out.groupBy("lineage").agg(big(F.count(F.lit(1)), "n"))


@query
def accounting_text_to_number(spark, sf_dir):
    """Prices written as accounting text (parentheses, separators, unicode minus, scale) and read back."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    text = (
        F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("("), F.format_number("p", 2), F.lit(")")))
        .when(F.col("l_orderkey") % 5 == 1, F.concat(F.lit("$ "), F.format_number("p", 2)))
        .when(F.col("l_orderkey") % 5 == 2, F.concat(F.lit("−"), F.col("p").cast("string")))
        .when(F.col("l_orderkey") % 5 == 3, F.lit("—"))
        .otherwise(F.col("p").cast("string"))
    )
    value = S.accounting_number(text, F.when(F.col("l_linenumber") == 1, 3).otherwise(0))
    bound = S.rounding_bound(F.when(F.col("l_linenumber") % 2 == 0, F.lit("-3")).otherwise("INF"))
    return line.select("l_orderkey", "l_linenumber", value.cast("decimal(28,4)").alias("value"), dec(bound, "bound"))


@query
def json_flatten(spark, sf_dir):
    """Events as nested facts (taxonomy, concept, unit, observations) built as JSON per user, then flattened."""
    e = table(spark, sf_dir, "events")
    one = F.struct(F.col("event_id").cast("string").alias("accn"), F.to_date("ts").alias("start"), F.to_date("ts").alias("end"), F.get_json_object("props", "$.k").cast("decimal(20,2)").alias("val"), F.lit("10-Q").alias("form"), F.to_date("ts").alias("filed"))
    by_unit = e.groupBy("user_id", "event_type", F.when(F.col("event_id") % 5 == 0, "EUR").otherwise("USD").alias("unit")).agg(F.collect_list(one).alias("o"))
    by_concept = by_unit.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("unit", "o"))).alias("units"))
    docs = by_concept.groupBy("user_id").agg(F.to_json(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(F.lit("l").alias("label"), "units").alias("f")))))).alias("json"))
    parsed = docs.select("user_id", F.from_json("json", landing.FACTS_TYPE).alias("facts"))
    rows = landing.flatten_facts(parsed, "facts", "us-gaap", "USD", "user_id")
    return rows.select("user_id", "taxonomy_concept", F.col("accession").cast("long").alias("event_id"), F.col("start").alias("day"), "value")


@query
def parallel_arrays(spark, sf_dir):
    """Each customer's orders as a struct of arrays, one of them short, turned back into rows."""
    o = table(spark, sf_dir, "orders")
    packed = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("s"))
    packed = packed.select("o_custkey", F.transform("s", lambda x: x["o_orderkey"]).alias("accessions"), F.slice(F.transform("s", lambda x: x["o_orderstatus"]), 1, 5).alias("forms"))
    return landing.explode_parallel(packed, {"accession": "accessions", "form": "forms"}, "o_custkey")


@query
def tagged_html_facts(spark, sf_dir):
    """Revenue of each supplier written as tagged HTML documents, parsed, joined with contexts and read as numbers."""
    cells = bridge.quarter_cells(spark, sf_dir).where("concept = 'revenue'")
    cid = F.concat(F.lit("c"), F.date_format("q_end", "yyyyMMdd"))
    context = F.concat(F.lit('<xbrli:context id="'), cid, F.lit('"><xbrli:identifier>'), F.col("issuer").cast("string"), F.lit("</xbrli:identifier><xbrli:startDate>"), F.col("q_start").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"), F.col("q_end").cast("string"), F.lit("</xbrli:endDate></xbrli:context>"))
    fact = F.concat(F.lit('<ix:nonFraction name="us-gaap:Revenues" contextRef="'), F.when(F.month("q_end") == 12, "lost").otherwise(cid), F.lit('" unitRef="USD" decimals="-3">'), F.format_number("value", 4), F.lit("</ix:nonFraction>"))
    docs = cells.groupBy("issuer").agg(F.concat_ws("\n", F.lit("<html><body>"), F.concat_ws("\n", F.sort_array(F.collect_list(context))), F.concat_ws("\n", F.sort_array(F.collect_list(fact))), F.lit("</body></html>")).alias("html"))
    rows = landing.tagged_facts(landing.html_elements(docs, "issuer", "html"), "issuer")
    return rows.select("issuer", S.local_name(F.col("name")).alias("concept"), F.col("start").alias("q_start"), F.col("end").alias("q_end"), S.accounting_number(F.col("text")).cast("decimal(28,4)").alias("value"), "match")


@query
def html_elements(spark, sf_dir):
    """How many links and paragraphs each page has, and its title, from its parsed elements."""
    rows = landing.html_elements(table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.groupBy("page_id").agg(big(F.count_if(F.col("tag") == "a"), "links"), big(F.count_if(F.col("tag") == "p"), "paragraphs"), F.max(F.when(F.col("tag") == "title", F.col("text"))).alias("title"))


@query
def preamble_table(spark, sf_dir):
    """Supplier lists written as files with a preamble, a header and a footer, one per nation, read back and classed."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat_ws(",", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.concat(F.lit('"'), F.col("s_name"), F.lit(', Inc"')), F.when(F.col("s_suppkey") % 6 == 0, "").when(F.col("s_suppkey") % 6 == 1, "Space").otherwise("Tech"), F.when(F.col("s_suppkey") % 9 == 0, "Cash").otherwise("Equity")).alias("line"))
    files = s.groupBy(F.col("s_nationkey").alias("file")).agg(F.concat(F.lit('A fund\nFund Holdings as of,"Sep 17, 2026"\n\nTicker,Name,Sector,Asset Class\n'), F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n\nThe end, of it\n")).alias("content"))
    rows = landing.preamble_table(files, ("Ticker", "Name", "Sector", "Asset Class")).where("problem is null")
    c = F.col("cells")
    holdings = rows.select("file", "as_of", c["Ticker"].alias("symbol"), c["Name"].alias("name"), c["Sector"].alias("sector"), c["Asset Class"].alias("asset_class"))
    return landing.holding_classes(holdings, ("Tech", "Energy")).select(big("file"), "as_of", "symbol", "name", "class")


@query
def symbol_map(spark, sf_dir):
    """Symbol and issuer pairs from a map per nation of customers, in standard form."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.concat(F.lit(" s"), F.col("c_nationkey").cast("string"), F.lit("x"), (F.col("c_custkey") % 11).cast("string")).alias("ticker"), (F.col("c_custkey") % 11).alias("cik")).alias("s"), F.col("c_custkey").cast("string").alias("k"))
    maps = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("symbols"))
    return landing.symbol_pairs(maps)


@query
def request_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 7 == 1, "bad name").otherwise(F.concat(F.lit(" ab"), (F.col("c_custkey") % 500).cast("string"))).alias("ticker"))
    return landing.request_list(c)


@query
def archive_union(spark, sf_dir):
    """Order pages that overlap a window, exact copies once, differing copies held back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderdate").cast("date").alias("filing_from"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("filing_to"), "o_orderstatus")
    second = o.where("accession % 3 = 0").withColumn("o_orderstatus", F.when(F.col("accession") % 30 == 0, "Z").otherwise(F.col("o_orderstatus")))
    rows, conflicts = landing.archive_union([o, second], "1999-01-01", "1999-12-31", "accession")
    return rows.select("accession", "o_orderstatus", F.lit(1).cast("long").alias("versions")).unionByName(conflicts.select("accession", F.lit(None).cast("string").alias("o_orderstatus"), big("versions")))


@query
def table_fingerprint(spark, sf_dir):
    """Rows and order-free fingerprint of two tables and of a reordered copy."""
    def one(name, rows):
        return tables.fingerprint(rows).select(F.lit(name).alias("name"), "rows", "fingerprint")

    orders = table(spark, sf_dir, "orders")
    return one("orders", orders).unionByName(one("orders_reordered", orders.repartition(7, "o_custkey"))).unionByName(one("lineitem", table(spark, sf_dir, "lineitem")))


@query
def distinct_payloads(spark, sf_dir):
    """Documents' contents stored once under their SHA-256, and how often each is referred to."""
    payloads, references = tables.distinct_payloads(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    n = references.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return payloads.join(n, "sha256").select("sha256", big(F.length("text"), "chars"), big("n"), "first_doc")


@query
def incremental_new(spark, sf_dir):
    """Index rows whose document is not fetched yet, the latest row of an address once."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("url"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("accession"), (F.col("o_orderstatus") != "P").alias("eligible"))
    index = o.select("url", F.struct("day", "accession").alias("available"), "accession", "eligible")
    fetched = o.where("accession % 4 = 0").select("url").distinct()
    return tables.not_yet_fetched(index, fetched).select("url", "accession")


@query
def stream_latest(spark, sf_dir):
    """Filings arriving as a stream: the latest vintage per customer and period after the last micro-batch."""
    root = _scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    static = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    stream = bridge.filings_of(static)
    arrivals.maintain_latest(stream, f"{root}/state", f"{root}/checkpoint")
    return arrivals.latest(spark, f"{root}/state").select("issuer", "report_period", "accession", "value")


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


QUERIES |= stage_queries.QUERIES | record_queries.QUERIES | matrix_queries.REGISTER
ORACLE_SQL = oracle.ORACLE_SQL | stage_oracle.ORACLE_SQL | record_queries.ORACLE_SQL | history_queries.ORACLE_SQL
