"""Registered queries of peer levels, sensitivity, unlisted facts and the remaining preparation steps; they join the register of ``history_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.history_queries import _HEADS, _flows, _per_head, query
from vintara.history_queries import QUERIES as REGISTER
from vintara.operators import contexts, peers, scoring, sensitivity
from vintara.oracle import _FILINGS, _YTD, _accelerated, _d, _digits, _obs
from vintara.plans import bridge, governance, policy, stages
from vintara.plans.bridge import table
from vintara.sources import landing, variant_facts
from vintara.stage_oracle import _ELIGIBLE, _INPUTS, _NORMAL, _values
from vintara.stage_queries import Method, big, dec

LEVELS = (("NATION", "nation", 4), ("REGION", "region", 10), ("ALL", "everyone", 20))


def _by_level(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    m = Method(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    home = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("issuer"), F.col("s_nationkey").alias("nation"), "region", F.lit("all").alias("everyone"))
    build = lambda: peers.ranks_by_level(m.usable.drop("age_days").join(home, "issuer"), "value", LEVELS, stages.KEYS, ("q_end", "input_id"), m.small())
    return m._once("levels", build) if keep else build()


_PLACED = """lv AS (SELECT f.q_end, f.issuer, f.input_id, f.value, place, level, key, least FROM fit f JOIN supplier ON s_suppkey = f.issuer JOIN nation ON n_nationkey = s_nationkey,
        LATERAL (SELECT 0 AS place, 'NATION' AS level, CAST(s_nationkey AS VARCHAR) AS key, 4 AS least UNION ALL SELECT 1, 'REGION', CAST(n_regionkey AS VARCHAR), 10 UNION ALL SELECT 2, 'ALL', 'all', 20)),
    lr AS (SELECT *, count(*) OVER g AS peers, 100.0 * (CAST(rank() OVER (PARTITION BY q_end, input_id, level, key ORDER BY value) + (count(*) OVER (PARTITION BY q_end, input_id, level, key, value) - 1) / 2.0 AS DOUBLE) - 0.5) / count(*) OVER g AS pct FROM lv WINDOW g AS (PARTITION BY q_end, input_id, level, key)),
    lf AS (SELECT q_end, issuer, input_id, min(place) FILTER (peers >= least) AS first, max(peers / least) AS room FROM lr GROUP BY ALL)"""


@query(f"""{_INPUTS}, {_PLACED} SELECT lf.q_end, lf.issuer, lf.input_id, level, key AS level_key, peers AS level_peers, {_d('pct', 'percentile')} FROM lf LEFT JOIN lr ON lr.q_end = lf.q_end AND lr.issuer = lf.issuer AND lr.input_id = lf.input_id AND lr.place = lf.first""")
def peer_level_ranks(spark, sf_dir):
    """Each input's percentile inside the narrowest of nation, region and all that has enough peers; all levels are ranked in one pass."""
    out = peers.narrowest_ranks(_by_level(spark, sf_dir), (*stages.KEYS, "input_id"))
    return out.select(*stages.KEYS, "input_id", "level", "level_key", "level_peers", dec("percentile"))


_CUTS = _values([(d, a, float(c), g, p) for d, a, c, g, p in policy.SENSITIVITY_CUTS], "dimension, alternative, cut, at_least, is_primary")
_SCORED = "count(*) FILTER (coalesce({x} >= 60, false)) AS passing, count(*) FILTER (coalesce({x} >= 60, false) AND NOT coalesce({p} >= 60, false)) AS entered, count(*) FILTER (NOT coalesce({x} >= 60, false) AND coalesce({p} >= 60, false)) AS dropped, count(*) FILTER (coalesce({p} >= 60, false)) AS base"
_other = lambda dimension, alternative, source, x, p: f"SELECT '{dimension}' AS dimension, '{alternative}' AS alternative, q_end, {_SCORED.format(x=x, p=p)} FROM {source} GROUP BY q_end"


@query(f"""{_NORMAL}, {_PLACED}, {_HEADS}, cuts AS ({_CUTS}), shown AS (SELECT * FROM n WHERE scenario = 'BASELINE' AND st = 'PASS'),
    tot AS (SELECT q_end, issuer, round(CAST(sum(CASE factor WHEN 'F1_TTM' THEN 0.35 WHEN 'F2_QUARTER' THEN 0.25 WHEN 'F3_QUALITY' THEN 0.2 WHEN 'F4_ACCELERATION' THEN 0.15 ELSE 0.05 END * coverage) AS DOUBLE), 9) AS total FROM gates GROUP BY ALL),
    fam AS (SELECT q_end, issuer, unnest([growth, profit, cash, margin]) AS k FROM classes), br AS (SELECT q_end, issuer, count(*) FILTER (k <> 'INELIGIBLE') AS n, count(*) FILTER (k = 'SUPPORTIVE') + 0.5 * count(*) FILTER (k = 'NEUTRAL') AS s, count(*) FILTER (k = 'CONFLICTED') AS c FROM fam GROUP BY ALL HAVING n >= 3),
    vals AS (SELECT 'STALENESS' AS dimension, q_end, CAST(age_days AS DOUBLE) AS value FROM fit UNION ALL SELECT 'OUTLIER', q_end, abs(pct - 50) FROM shown UNION ALL SELECT 'REWEIGHT_CAP', q_end, CAST(0.5 AS DOUBLE) / CAST(0.45 AS DOUBLE) FROM kh WHERE half
        UNION ALL SELECT 'TOTAL_COVERAGE_FLOOR', q_end, total FROM tot UNION ALL SELECT 'NEUTRAL_BAND', q_end, abs(pct - 50) FROM shown UNION ALL SELECT 'ACCELERATION_CUTOFF', q_end, pct FROM shown WHERE input_id LIKE '%acceleration%'
        UNION ALL SELECT 'CONFLICT_VALUE', q_end, CASE WHEN c > 0 THEN CAST((0.5 * n - s) AS DOUBLE) / c WHEN s >= 0.5 * n THEN -1 ELSE 99 END FROM br UNION ALL SELECT 'EMPLOYEE_AGE', q_end, CAST(head_age AS DOUBLE) FROM perhead WHERE head_age IS NOT NULL UNION ALL SELECT 'MINIMUM_PEERS', q_end, CAST(room AS DOUBLE) FROM lf),
    hit AS (SELECT v.dimension, c.alternative, v.q_end, CASE WHEN c.at_least THEN v.value >= c.cut ELSE v.value <= c.cut END AS here, CASE WHEN p.at_least THEN v.value >= p.cut ELSE v.value <= p.cut END AS there FROM vals v JOIN cuts c USING (dimension) JOIN cuts p ON p.dimension = v.dimension AND p.is_primary),
    wide AS (SELECT f.q_end, a.pct AS narrow, b.pct AS broad FROM lf f LEFT JOIN lr a ON a.q_end = f.q_end AND a.issuer = f.issuer AND a.input_id = f.input_id AND a.place = f.first LEFT JOIN lr b ON b.q_end = f.q_end AND b.issuer = f.issuer AND b.input_id = f.input_id AND b.place = CASE WHEN f.first IS NOT NULL THEN least(f.first + 1, 2) END),
    every AS (SELECT dimension, alternative, q_end, count(*) FILTER (here) AS passing, count(*) FILTER (here AND NOT there) AS entered, count(*) FILTER (NOT here AND there) AS dropped, count(*) FILTER (there) AS base FROM hit GROUP BY ALL
        UNION ALL {_other('NORMALIZATION', 'PERCENTILE', 'shown', 'pct', 'pct')} UNION ALL {_other('NORMALIZATION', 'ROBUST_Z_CDF', 'shown', 'round(rob, 6)', 'pct')} UNION ALL {_other('PEER_LEVEL', 'NARROWEST', 'wide', 'narrow', 'narrow')} UNION ALL {_other('PEER_LEVEL', 'ONE_BROADER', 'wide', 'broad', 'narrow')})
    SELECT dimension, alternative, q_end, passing, entered, dropped, {_d('CAST(entered + dropped AS DOUBLE) / nullif(base, 0)', 'turnover')} FROM every""".replace("every AS (\n    SELECT q_end, issuer, short", "every0 AS (\n    SELECT q_end, issuer, short").replace("AS age_days FROM every WHERE v IS NOT NULL", "AS age_days FROM every0 WHERE v IS NOT NULL").replace("wide AS (SELECT q_end, issuer, max(", "wide0 AS (SELECT q_end, issuer, max(").replace("AS margin FROM wide)", "AS margin FROM wide0)"))
def sensitivity_all(spark, sf_dir):
    """Eleven dimensions of the sensitivity matrix, a row for each alternative and quarter: who passes, enters and drops out against the primary rule."""
    m = Method(spark, sf_dir)
    shown = m.normalized("scenario = 'BASELINE'", keep=True).where("normalization_status = 'PASS'").select("q_end", "input_id", "percentile", F.round("robust", 6).alias("robust"))
    usable = m.usable
    weight = F.create_map(*[F.lit(x) for pair in policy.FACTOR_WEIGHTS.items() for x in pair])[F.col("factor")]
    total = m.gates().groupBy(*stages.KEYS).agg(F.round(F.sum(weight * F.col("coverage")), 9).alias("value"))
    both = usable.where("age_days <= 180 and input_id in ('revenue_q_yoy', 'operating_income_q_yoy')").groupBy(*stages.KEYS).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    four = F.array("growth", "profit", "cash", "margin")
    count = lambda name: F.size(F.filter(four, lambda c: c == name))
    broad = m.classes.select("q_end", (4 - count("INELIGIBLE")).alias("n"), (count("SUPPORTIVE") + 0.5 * count("NEUTRAL")).alias("s"), count("CONFLICTED").alias("c")).where("n >= 3")
    needed = F.when(F.col("c") > 0, (0.5 * F.col("n") - F.col("s")) / F.col("c")).when(F.col("s") >= 0.5 * F.col("n"), -1.0).otherwise(99.0)
    levels = _by_level(spark, sf_dir, keep=True)
    room = levels.groupBy(*stages.KEYS, "input_id").agg(F.max(F.col("level_peers") / F.col("least")).alias("value"))
    off = F.abs(F.col("percentile") - 50)
    parts = {
        "STALENESS": usable.select("q_end", F.col("age_days").cast("double").alias("value")), "OUTLIER": shown.select("q_end", off.alias("value")), "REWEIGHT_CAP": both.select("q_end", F.lit(0.5 / 0.45).alias("value")), "TOTAL_COVERAGE_FLOOR": total.select("q_end", "value"),
        "NEUTRAL_BAND": shown.select("q_end", off.alias("value")), "ACCELERATION_CUTOFF": shown.where("input_id like '%acceleration%'").select("q_end", F.col("percentile").alias("value")), "CONFLICT_VALUE": broad.select("q_end", needed.alias("value")),
        "EMPLOYEE_AGE": _per_head(spark, sf_dir, _flows(m.signals)).where("head_age is not null").select("q_end", F.col("head_age").cast("double").alias("value")), "MINIMUM_PEERS": room.select("q_end", "value"),
    }
    values = None
    for name, part in parts.items():
        # equal values of a dimension and date count as one row with its number from here on
        counted = part.groupBy("q_end", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit(name))
        values = counted if values is None else values.unionByName(counted)
    cuts = spark.createDataFrame(policy.SENSITIVITY_CUTS, "dimension string, alternative string, cut double, at_least boolean, is_primary boolean")
    swept = sensitivity.sweep(values, cuts)
    normal = sensitivity.compare(shown, "NORMALIZATION", ("PERCENTILE", "percentile"), {"ROBUST_Z_CDF": "robust"}, 60.0)
    names = (*stages.KEYS, "input_id")
    two = peers.narrowest_ranks(levels, names).join(peers.narrowest_ranks(levels, names, broader=1).select(*names, F.col("percentile").alias("broad")), list(names))
    level = sensitivity.compare(two, "PEER_LEVEL", ("NARROWEST", "percentile"), {"ONE_BROADER": "broad"}, 60.0)
    out = swept.unionByName(normal).unionByName(level)
    return out.select("dimension", "alternative", "q_end", big("passing"), big("entered"), big("dropped"), dec("turnover"))


@query(f"""{_INPUTS}, has AS (SELECT q_end, issuer, list(DISTINCT input_id) AS ids FROM inputs GROUP BY ALL), flags AS (SELECT *, (list_contains(ids, 'revenue_q_yoy_acceleration') OR list_contains(ids, 'revenue_ttm_yoy_acceleration')) AS g, (list_contains(ids, 'operating_income_q_yoy_acceleration') OR list_contains(ids, 'operating_income_ttm_yoy_acceleration')) AS p,
        (list_contains(ids, 'cfo_ttm_yoy_acceleration') OR list_contains(ids, 'fcf_ttm_yoy_acceleration')) AS k, list_contains(ids, 'operating_margin_acceleration_pp') AS m, list_contains(ids, 'revenue_q_yoy') AS rq, list_contains(ids, 'operating_income_q_yoy') AS pq FROM has),
    cov AS (SELECT q_end, issuer, 'F1_TTM' AS factor, 0.20 * list_contains(ids, 'revenue_ttm_yoy')::INT + 0.25 * list_contains(ids, 'operating_income_ttm_yoy')::INT + 0.15 * list_contains(ids, 'cfo_ttm_yoy')::INT + 0.20 * list_contains(ids, 'fcf_ttm_yoy')::INT AS c FROM flags
        UNION ALL SELECT q_end, issuer, 'F2_QUARTER', CASE WHEN rq AND pq THEN 1.0 ELSE 0.45 * rq::INT + 0.45 * pq::INT END FROM flags
        UNION ALL SELECT q_end, issuer, 'F3_QUALITY', 0.30 * list_contains(ids, 'operating_margin_yoy_pp')::INT + 0.20 * list_contains(ids, 'fcf_margin_yoy_pp')::INT + 0.20 * list_contains(ids, 'operating_leverage_spread')::INT FROM flags
        UNION ALL SELECT q_end, issuer, 'F4_ACCELERATION', 0.25 * g::INT + 0.30 * p::INT + 0.15 * k::INT + 0.15 * m::INT + 0.15 * (g::INT + p::INT + k::INT + m::INT >= 2)::INT FROM flags
        UNION ALL SELECT q_end, issuer, 'F5_BREADTH', {_ELIGIBLE} / 6.0 FROM classes)
    SELECT q_end, issuer, factor, {_d('c', 'coverage')} FROM cov""")
def raw_sleeve_coverage(spark, sf_dir):
    """What each supplier could fill of each factor before any requirement on transformations or ages: the weights of sleeves with enough inputs."""
    m = Method(spark, sf_dir)
    there = m.inputs.select(*stages.KEYS, "input_id").distinct()
    family = F.when(F.col("input_id").isin("revenue_q_yoy_acceleration", "revenue_ttm_yoy_acceleration"), "growth").when(F.col("input_id").isin("operating_income_q_yoy_acceleration", "operating_income_ttm_yoy_acceleration"), "profit").when(F.col("input_id").isin("cfo_ttm_yoy_acceleration", "fcf_ttm_yoy_acceleration"), "cash").when(F.col("input_id") == "operating_margin_acceleration_pp", "margin")
    families = there.select(*stages.KEYS, F.concat(F.lit("acceleration_family_"), family).alias("input_id")).where("input_id is not null").distinct()
    sleeves = spark.createDataFrame(policy.SLEEVES, "factor string, sleeve string, input_id string, weight double, needed int")
    four = scoring.sleeve_coverage(there.unionByName(families).withColumn("present", F.lit(True)), sleeves, stages.KEYS)
    breadth = m.classes.select(*stages.KEYS, F.lit("F5_BREADTH").alias("factor"), (F.size(F.filter(F.array(*stages.FAMILIES), lambda c: c != "INELIGIBLE")) / 6.0).alias("coverage"))
    return four.unionByName(breadth).select(*stages.KEYS, "factor", dec("coverage"))


_PERIOD_FACTS = """pf AS (SELECT l_suppkey AS issuer, l_returnflag || l_linestatus AS concept, CASE WHEN l_linenumber = 7 THEN 'shares' ELSE 'USD' END AS unit, l_orderkey AS accession, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS stop, CAST(l_quantity AS DECIMAL(12,2)) AS value FROM lineitem),
    rules AS (SELECT s_suppkey AS issuer, 'RETURNS' AS rule_id, unnest(CASE WHEN s_nationkey % 2 = 0 THEN ['RF'] ELSE ['AF', 'RF'] END) AS component FROM supplier UNION ALL SELECT s_suppkey, 'OPEN', 'NO' FROM supplier)"""
_CONTINUITY = f"""{_FILINGS}, {_PERIOD_FACTS}, one AS (SELECT p.issuer, rule_id, accession, start, stop, component, max(p.value) AS value FROM pf p JOIN rules r ON r.issuer = p.issuer AND r.component = p.concept JOIN filings f USING (accession) WHERE unit = 'USD' AND available <= DATE '2000-06-30' GROUP BY ALL),
    need AS (SELECT issuer, rule_id, count(*) AS k, string_agg(component, '+' ORDER BY component) AS components FROM rules GROUP BY ALL), ev AS (SELECT o.issuer, o.rule_id, accession, start, stop, count(*) AS present, sum(value) AS total, any_value(k) AS k FROM one o JOIN need n ON n.issuer = o.issuer AND n.rule_id = o.rule_id GROUP BY ALL)"""


@query(f"""WITH {_CONTINUITY} SELECT n.issuer, n.rule_id, components, count(present) AS rows, count(*) FILTER (present = n.k) AS complete_rows, count(DISTINCT stop) FILTER (present = n.k) AS complete_periods, min(stop) FILTER (present = n.k) AS earliest_end, max(stop) FILTER (present = n.k) AS latest_end,
    CASE WHEN count(present) > 0 AND count(present) = count(*) FILTER (present = n.k) THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS mapping_status FROM need n LEFT JOIN ev USING (issuer, rule_id) GROUP BY ALL""")
def mapping_continuity(spark, sf_dir):
    """Rules that add components of one filing and period up to a concept, held against the facts that were known: which rules can be approved."""
    line = table(spark, sf_dir, "lineitem")
    start = F.trunc("l_shipdate", "quarter")
    facts = line.select(F.col("l_suppkey").alias("issuer"), F.concat("l_returnflag", "l_linestatus").alias("taxonomy_concept"), F.when(F.col("l_linenumber") == 7, "shares").otherwise("USD").alias("unit"), F.col("l_orderkey").alias("accession"), start.alias("start"), F.last_day(F.add_months(start, 2)).alias("end"), F.col("l_quantity").cast("decimal(12,2)").alias("value"))
    s = table(spark, sf_dir, "supplier")
    parts = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("RF"))).otherwise(F.array(F.lit("AF"), F.lit("RF")))
    rules = s.select(F.col("s_suppkey").alias("issuer"), F.lit("RETURNS").alias("rule_id"), F.lit("returned").alias("canonical_concept"), F.explode(parts).alias("component")).unionByName(s.select(F.col("s_suppkey").alias("issuer"), F.lit("OPEN").alias("rule_id"), F.lit("open").alias("canonical_concept"), F.lit("NO").alias("component")))
    known = bridge.filings(spark, sf_dir).where("available <= date'2000-06-30'").select("accession")
    eligible = line.select(F.col("l_suppkey").alias("issuer"), F.col("l_orderkey").alias("accession")).distinct().join(known, "accession")
    _, summary = governance.mapping_continuity(facts, rules, eligible)
    return summary.drop("canonical_concept")


@query("""WITH h AS (SELECT CASE WHEN s_acctbal < -900 THEN '-' ELSE 'S' || (s_suppkey % 90) END AS symbol, CASE WHEN s_acctbal < 0 THEN 'Cash' ELSE 'Equity' END AS asset, CASE WHEN s_nationkey = 3 THEN '' WHEN s_nationkey = 4 THEN 'Other' ELSE 'N' || s_nationkey END AS sector FROM supplier),
    k AS (SELECT *, count(*) FILTER (asset = 'Equity') OVER (PARTITION BY symbol) AS n FROM h),
    c AS (SELECT symbol, CASE WHEN asset <> 'Equity' THEN 'NON_EQUITY' WHEN NOT regexp_full_match(symbol, '[A-Z][A-Z0-9.\\-]*') THEN 'INVALID_SYMBOL' WHEN sector = '' THEN 'MISSING_SECTOR' WHEN sector = 'Other' THEN 'UNKNOWN_SECTOR' WHEN n > 1 THEN 'DUPLICATE_SYMBOL' ELSE 'PEER_CANDIDATE' END AS status FROM k),
    r AS (SELECT DISTINCT 'S' || (c_custkey % 120) AS symbol FROM customer)
    SELECT c.symbol, status, r.symbol IS NOT NULL AS requested FROM c LEFT JOIN r USING (symbol) UNION ALL SELECT symbol, 'REQUESTED_NOT_IN_PROXY', true FROM r WHERE symbol NOT IN (SELECT symbol FROM c WHERE status = 'PEER_CANDIDATE')""")
def membership_audit(spark, sf_dir):
    """Suppliers as holdings of a dated fund, classed and held against the symbols that customers ask for."""
    s = table(spark, sf_dir, "supplier")
    sector = F.when(F.col("s_nationkey") == 3, "").when(F.col("s_nationkey") == 4, "Other").otherwise(F.concat(F.lit("N"), "s_nationkey"))
    holdings = s.select(F.when(F.col("s_acctbal") < -900, "-").otherwise(F.concat(F.lit("S"), F.col("s_suppkey") % 90)).alias("symbol"), F.when(F.col("s_acctbal") < 0, "Cash").otherwise("Equity").alias("asset_class"), sector.alias("sector"))
    classed = landing.holding_classes(holdings, tuple(f"N{k}" for k in range(25)))
    requests = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey") % 120).alias("symbol"))
    return contexts.membership_audit(classed, requests, "2001-06-25", "2001-06-30")


def _unlisted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' lines as JSON documents of facts with concepts and units that no list names; some values are words, some dates are none, some numbers text."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("concept"))
    line = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    unit = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("pieces/"), "l_linestatus")).otherwise(F.col("l_returnflag"))
    tax, off = F.round("l_tax", 2), F.round("l_discount", 2)
    value = F.when(tax == 0.08, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("decimal(12,2)").cast("string")))
    observation = F.struct(F.when(off != 0.0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("accn"), F.when(tax == 0.07, F.lit("2001-02-30")).otherwise(F.to_date("l_shipdate").cast("string")).alias("end"), value.alias("val"), F.when(F.col("l_linenumber") == 1, F.col("l_linenumber")).alias("frame"))
    moved = line.select(F.col("l_suppkey").alias("supplier"), "concept", unit.alias("unit"), observation.alias("o")).repartition("supplier")  # once for all three levels
    by_unit = moved.groupBy("supplier", "concept", "unit").agg(F.collect_list("o").alias("o"))
    by_concept = by_unit.groupBy("supplier", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "o"))).alias("units"))
    facts = F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("f"))))
    docs = by_concept.groupBy("supplier").agg(F.to_json(F.struct(F.create_map(F.lit("own"), facts).alias("facts"))).alias("json"))
    cut = docs.select("supplier", F.when(F.col("supplier") % 25 == 7, F.substring("json", 1, 1000)).otherwise(F.col("json")).alias("json"))
    return variant_facts.variant_facts(cut, "supplier")


@query("""WITH ev AS (SELECT l_suppkey AS supplier, p_type AS concept, CASE WHEN l_returnflag = 'N' THEN 'pieces/' || l_linestatus ELSE l_returnflag END AS unit, l_orderkey || '-' || l_linenumber AS accession, CAST(l_quantity AS DECIMAL(28,4)) AS value, round(l_tax, 2) AS t, round(l_discount, 2) AS d, CAST(l_shipdate AS DATE) AS stop, CASE WHEN l_linenumber = 1 THEN 'frame' ELSE '' END AS extra
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 25 <> 7) SELECT supplier, concept, unit, accession, stop AS day, value, extra FROM ev WHERE d <> 0 AND t <> 0.07 AND t <> 0.08""")
def unlisted_facts(spark, sf_dir):
    """Facts of concepts, units and fields that no schema names, from JSON text."""
    facts, _ = _unlisted(spark, sf_dir)
    return facts.select("supplier", "concept", "unit", "accession", F.col("end").alias("day"), "value", F.array_join("extra", "|").alias("extra"))


@query("""WITH ev AS (SELECT l_suppkey AS supplier, round(l_tax, 2) AS t, round(l_discount, 2) AS d FROM lineitem), j AS (SELECT supplier, CASE WHEN d = 0 THEN 'NO_ACCESSION' WHEN t = 0.07 THEN 'BAD_END' WHEN t = 0.08 THEN 'BAD_VALUE' END AS problem FROM ev WHERE supplier % 25 <> 7)
    SELECT supplier, problem, count(*) AS rejected FROM j WHERE problem IS NOT NULL GROUP BY ALL UNION ALL SELECT DISTINCT supplier, 'NOT_JSON', 1 FROM ev WHERE supplier % 25 = 7""")
def unlisted_fact_rejects(spark, sf_dir):
    """What those documents hold that is no fact, and why; every twenty-fifth document is cut off on its way."""
    _, rejects = _unlisted(spark, sf_dir)
    return rejects.groupBy("supplier", "problem").agg(big(F.count(F.lit(1)), "rejected"))


_PROVED = _YTD.replace("WHERE fq = 1 OR issuer % 3 <> 0", "WHERE (fq = 1 OR issuer % 3 <> 0) AND NOT (fq = 2 AND year(q_start) % 3 = 0)")


@query(f"""{_PROVED}, vq AS (SELECT issuer, 'revenue' AS concept, q_start, q_end, quarter(q_start) AS fiscal_quarter, value FROM out WHERE status LIKE 'PASS%' AND value IS NOT NULL), {_obs('vq').replace('runs', 'vruns').replace('sums', 'vsums').replace('obs AS', 'vobs AS')}, va AS (SELECT *, {_accelerated('q_yoy')}, {_accelerated('ttm_yoy')} FROM vobs WINDOW w AS (PARTITION BY issuer, concept ORDER BY q_end))
    SELECT issuer, q_end, value, ttm, {_digits('q_yoy')} AS q_yoy, {_digits('ttm_yoy')} AS ttm_yoy, {_digits('q_yoy_acceleration')} AS q_yoy_acceleration, {_digits('ttm_yoy_acceleration')} AS ttm_yoy_acceleration FROM va""")
def verified_signals(spark, sf_dir):
    """From tagged filings to signals: yearly documents are parsed, reported facts held against their contexts, and only proved ones counted; second quarters of some years have lost their context."""
    accession = (F.col("issuer") * 10_000 + F.year("end")).cast("long")
    facts = bridge.ytd_facts(spark, sf_dir).withColumns({"accession": accession, "local_concept": F.lit("Revenues"), "form": F.lit("10-K"), "report_period": F.make_date(F.year("end"), F.lit(12), F.lit(31)), "accepted": F.col("end").cast("timestamp")}).withColumn("url", F.format_string("filings/%d.htm", "accession"))
    name = F.concat(F.lit("c"), F.date_format("start", "yyyyMMdd"), F.lit("_"), F.date_format("end", "yyyyMMdd"))
    lost = (F.month("start") == 4) & (F.month("end") == 6) & (F.year("start") % 3 == 0)
    context = F.concat(F.lit('<xbrli:context id="'), name, F.lit('"><xbrli:identifier>'), F.col("issuer").cast("string"), F.lit("</xbrli:identifier><xbrli:startDate>"), F.col("start").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"), F.col("end").cast("string"), F.lit("</xbrli:endDate></xbrli:context>"))
    tag = F.concat(F.lit('<ix:nonFraction name="own:Revenues" contextRef="'), F.when(lost, "lost").otherwise(name), F.lit('" unitRef="USD" decimals="4">'), F.format_number("value", 4), F.lit("</ix:nonFraction>"))
    documents = facts.groupBy("accession").agg(F.concat_ws("\n", F.lit("<html><body>"), F.concat_ws("\n", F.sort_array(F.collect_list(context))), F.concat_ws("\n", F.sort_array(F.collect_list(tag))), F.lit("</body></html>")).alias("html"))
    targets = facts.select("accession", "issuer", "form", "report_period").distinct()
    mapping = spark.createDataFrame([("Revenues", "revenue", 1)], "taxonomy_concept string, canonical_concept string, priority int")
    _, out = governance.verified_signals(documents, facts, targets, mapping, "filings/%d.htm")
    return out.select("issuer", "q_end", "value", "ttm", dec("q_yoy"), dec("ttm_yoy"), dec("q_yoy_acceleration"), dec("ttm_yoy_acceleration"))
