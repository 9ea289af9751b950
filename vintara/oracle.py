"""DuckDB SQL for the panel queries, on the driver tables."""

from __future__ import annotations

from vintara.plans.policy import COMPONENTS

# The panel in SQL: amounts as exact decimals, and runs of consecutive quarters.
_CELLS = """
li AS (
    SELECT l_suppkey AS issuer, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q_start, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
        CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_quantity AS DECIMAL(12,2)) AS quantity
    FROM lineitem
), wide AS (
    SELECT issuer, q_start, CAST(sum(price * (CAST(1 AS DECIMAL(4,2)) - discount)) AS DECIMAL(28,4)) AS revenue, CAST(sum(price * (CAST(0.06 AS DECIMAL(4,2)) - discount)) AS DECIMAL(28,4)) AS operating_income,
        CAST(sum(price * tax) AS DECIMAL(28,4)) AS cash_from_operations, CAST(sum(quantity * 10) AS DECIMAL(28,4)) AS capital_expenditures
    FROM li GROUP BY issuer, q_start
), gappy AS (
    SELECT * FROM wide
), cells AS (
    SELECT issuer, concept, q_start, last_day(q_start + INTERVAL 2 MONTH) AS q_end, quarter(q_start) AS fiscal_quarter, value
    FROM gappy UNPIVOT (value FOR concept IN (revenue, operating_income, cash_from_operations, capital_expenditures))
)
"""


def _runs(source: str, keys: str = "issuer, concept", name: str = "runs") -> str:
    return f"""
{name} AS (
    SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY q_end) AS run FROM (
        SELECT *, CASE WHEN q_start = lag(q_end) OVER w + 1 AND fiscal_quarter = lag(fiscal_quarter) OVER w % 4 + 1 THEN 0 ELSE 1 END AS brk
        FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY q_end)
    )
)"""


def _obs(source: str = "cells") -> str:
    change = lambda n, a, b: f"""
        CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) - 1 END AS {n}, {a} - {b} AS {n}_change,
        CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} > 0 THEN 'PERCENT_CHANGE' ELSE 'ABSOLUTE_CHANGE_NONPOSITIVE_BASE' END AS {n}_method"""  # noqa: E731
    return f"""
{_runs(source)}, sums AS (
    SELECT *, CASE WHEN lag(run, 3) OVER w = run THEN sum(value) OVER (PARTITION BY issuer, concept ORDER BY q_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS ttm,
        CASE WHEN lag(run, 7) OVER w = run THEN sum(value) OVER (PARTITION BY issuer, concept ORDER BY q_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) END AS prior_ttm,
        CASE WHEN lag(run, 4) OVER w = run THEN lag(value, 4) OVER w END AS prior_q
    FROM runs WINDOW w AS (PARTITION BY issuer, concept ORDER BY q_end)
), obs AS (
    SELECT *, {change('q_yoy', 'value', 'prior_q')}, {change('ttm_yoy', 'ttm', 'prior_ttm')} FROM sums
)"""


_PANEL = f"WITH {_CELLS}, {_obs()}"
_METRICS = f"{_PANEL}, metrics AS (SELECT q_end, issuer, concept || '_ttm_yoy' AS input_id, round(ttm_yoy, 3) AS value FROM obs WHERE ttm_yoy IS NOT NULL)"
_FCF = """
fcf AS (
    SELECT * FROM cells UNION ALL
    SELECT a.issuer, 'free_cash_flow', a.q_start, a.q_end, a.fiscal_quarter, CAST(a.value - b.value AS DECIMAL(28,4)) FROM cells a JOIN cells b USING (issuer, q_start)
    WHERE a.concept = 'cash_from_operations' AND b.concept = 'capital_expenditures'
)"""


def _d(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS DECIMAL(18,9)) AS {name or expression}"


def _digits(expression: str, places: int = 9) -> str:
    """A double as decimal, its shortest digits rounded half up as Spark does; a product with a power of ten may fall on the other side of a half."""
    return f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(18,{places}))"


_METRICS_BY_DIGITS = _METRICS.replace("round(ttm_yoy, 3)", f"CAST({_digits('ttm_yoy', 3)} AS DOUBLE)")


def _accelerated(m: str) -> str:
    near = "lag(run) OVER w = run"
    rate, change = f"CASE WHEN {near} THEN {m} - lag({m}) OVER w END", f"CASE WHEN {near} THEN {m}_change - lag({m}_change) OVER w END"
    return f"{rate} AS {m}_acceleration, CASE WHEN ({rate}) IS NULL THEN {change} END AS {m}_acceleration_change, CASE WHEN ({rate}) IS NOT NULL THEN 'YOY_RATE_DELTA' WHEN ({change}) IS NOT NULL THEN 'ABSOLUTE_CHANGE_DELTA' END AS {m}_acceleration_method"


_W = "WINDOW w AS (PARTITION BY issuer, concept ORDER BY q_end)"
_MARGIN = f"""
joint AS (
    SELECT a.issuer, a.q_start, a.q_end, a.fiscal_quarter, a.value, b.value AS base FROM cells a JOIN cells b USING (issuer, q_start) WHERE a.concept = 'operating_income' AND b.concept = 'revenue'
), {_runs('joint', 'issuer', 'jruns')}, msums AS (
    SELECT *, CASE WHEN lag(run, 3) OVER w = run THEN sum(value) OVER (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS n0,
        CASE WHEN lag(run, 3) OVER w = run THEN sum(base) OVER (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS d0,
        CASE WHEN lag(run, 7) OVER w = run THEN sum(value) OVER (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) END AS n1,
        CASE WHEN lag(run, 7) OVER w = run THEN sum(base) OVER (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) END AS d1
    FROM jruns WINDOW w AS (PARTITION BY issuer ORDER BY q_end)
), mrates AS (
    SELECT *, CASE WHEN d0 > 0 THEN CAST(n0 AS DOUBLE) / CAST(d0 AS DOUBLE) END AS margin, CASE WHEN d1 > 0 THEN CAST(n1 AS DOUBLE) / CAST(d1 AS DOUBLE) END AS prior_margin FROM msums
), mpp AS (SELECT *, margin - prior_margin AS yoy_pp FROM mrates),
margins AS (SELECT *, CASE WHEN lag(run) OVER w = run THEN yoy_pp - lag(yoy_pp) OVER w END AS acceleration_pp FROM mpp WINDOW w AS (PARTITION BY issuer ORDER BY q_end))
"""


def _dir(v: str, band: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'INELIGIBLE' WHEN {v} > {band} THEN 'SUPPORTIVE' WHEN {v} < -{band} THEN 'ADVERSE' ELSE 'NEUTRAL' END"


def _rec(a: str, b: str) -> str:
    return f"""CASE WHEN 'SUPPORTIVE' IN ({a}, {b}) AND 'ADVERSE' IN ({a}, {b}) THEN 'CONFLICTED' WHEN 'SUPPORTIVE' IN ({a}, {b}) THEN 'SUPPORTIVE'
        WHEN 'ADVERSE' IN ({a}, {b}) THEN 'ADVERSE' WHEN ({a}) = 'INELIGIBLE' AND ({b}) = 'INELIGIBLE' THEN 'INELIGIBLE' ELSE 'NEUTRAL' END"""


_FAMILY_PARTS = f"""wide2 AS (
    SELECT issuer, q_end, max(q_yoy) FILTER (concept = 'revenue') AS rev_q, max(ttm_yoy) FILTER (concept = 'revenue') AS rev_t, max(ttm_yoy) FILTER (concept = 'operating_income') AS op_t,
        max(ttm_yoy) FILTER (concept = 'cash_from_operations') AS cfo_t FROM obs WHERE concept <> 'free_cash_flow' GROUP BY issuer, q_end
), families AS (
    SELECT w.*, m.yoy_pp, m.acceleration_pp, {_rec(_dir('rev_t', 0.01), _dir('rev_q', 0.01))} AS growth,
        CASE WHEN op_t IS NULL THEN 'INELIGIBLE' ELSE {_rec(_dir('op_t', 0.02), _dir('m.yoy_pp', 0.0025))} END AS profit,
        {_dir('cfo_t', 0.03)} AS cash, {_dir('m.yoy_pp', 0.0025)} AS margin
    FROM wide2 w LEFT JOIN margins m USING (issuer, q_end)
)"""
_FAMILIES = f"{_PANEL}, {_MARGIN}, {_FAMILY_PARTS}"

_HISTORY = f"""
fresh AS (
    SELECT *, CASE WHEN q_yoy IS NOT NULL AND lag(q_yoy) OVER w IS NOT NULL AND lag(run) OVER w = run THEN 0 ELSE 1 END AS f FROM obs {_W}
), streaks AS (SELECT *, sum(f) OVER w AS streak FROM fresh {_W}),
history AS (
    SELECT *, list_transform(list_filter(list({{'s': streak, 'v': q_yoy}}) OVER (PARTITION BY issuer, concept ORDER BY q_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), lambda x: x.s = streak), lambda x: x.v) AS h
    FROM streaks
)"""


def _score(band: str) -> str:
    state = lambda k: f"(CASE WHEN h[{k}] > {band} THEN 1.0 WHEN h[{k}] < -({band}) THEN -1.0 ELSE 0.0 END)"
    return f"CASE WHEN len(h) = 4 THEN CAST(50 AS DOUBLE) * (1 + {' + '.join(f'{state(k)} * CAST({w} AS DOUBLE)' for k, w in enumerate((0.1, 0.2, 0.3, 0.4), 1))}) END"


_FILINGS = """
filings AS (
    SELECT o_custkey AS issuer, o_orderkey AS accession, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' WHEN o_orderpriority LIKE '2%' THEN '10-K/A' ELSE '10-Q' END AS form,
        last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) - INTERVAL 1 MONTH) AS report_period, o_orderdate + to_hours(o_orderkey % 24) AS accepted,
        CAST(o_orderdate + to_hours(o_orderkey % 24) + to_days(CAST(1 + o_orderkey % 3 AS INTEGER)) AS DATE) AS available, CAST(o_totalprice AS DECIMAL(12,2)) AS value
    FROM orders
)"""

_LATEST = f"""
{_FILINGS}, eligible AS (SELECT * FROM filings WHERE form IN ('10-Q', '10-K', '10-Q/A', '10-K/A') AND available <= DATE '@DAY@'),
latest AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY issuer, report_period ORDER BY available DESC, accepted DESC, accession DESC) = 1)
"""



def _latest(day: str) -> str:
    return _LATEST.replace("@DAY@", day)


_YTD = f"""
WITH {_CELLS}, full_cells AS (
    SELECT issuer, q_start, last_day(q_start + INTERVAL 2 MONTH) AS q_end, quarter(q_start) AS fq, revenue AS value FROM wide
), direct AS (
    SELECT issuer, q_start, q_end, CAST(CASE WHEN issuer % 7 = 0 AND fq = 3 THEN value + 1000 ELSE value END AS DECIMAL(28,4)) AS value FROM full_cells WHERE fq = 1 OR issuer % 3 <> 0
), sums AS (
    SELECT issuer, CAST(date_trunc('year', q_start) AS DATE) AS fy_start, count(*) FILTER (fq <= 2) AS n2, count(*) FILTER (fq <= 3) AS n3, count(*) AS n4,
        sum(value) FILTER (fq = 1) AS v1, sum(value) FILTER (fq <= 2) AS v2, sum(value) FILTER (fq <= 3) AS v3, sum(value) AS v4 FROM full_cells GROUP BY ALL
), long AS (
    SELECT issuer, fy_start, CAST(CASE WHEN n2 = 2 THEN v2 END AS DECIMAL(28,4)) AS h1, CAST(CASE WHEN n3 = 3 THEN v3 END AS DECIMAL(28,4)) AS m9, CAST(CASE WHEN n4 = 4 THEN v4 END AS DECIMAL(28,4)) AS fy, CAST(v1 AS DECIMAL(28,4)) AS q1 FROM sums
), spec AS (
    SELECT issuer, fy_start, 1 AS fiscal_quarter, q1 AS long_value, NULL AS short_value, last_day(fy_start + INTERVAL 2 MONTH) AS q_end FROM long WHERE q1 IS NOT NULL AND coalesce(h1, m9, fy) IS NOT NULL
    UNION ALL SELECT issuer, fy_start, 2, h1, q1, last_day(fy_start + INTERVAL 5 MONTH) FROM long WHERE h1 IS NOT NULL
    UNION ALL SELECT issuer, fy_start, 3, m9, h1, last_day(fy_start + INTERVAL 8 MONTH) FROM long WHERE m9 IS NOT NULL
    UNION ALL SELECT issuer, fy_start, 4, fy, m9, last_day(fy_start + INTERVAL 11 MONTH) FROM long WHERE fy IS NOT NULL
), joined AS (
    SELECT s.*, CASE WHEN s.fiscal_quarter = 1 THEN s.long_value ELSE d.value END AS direct, d.q_start AS direct_start, s.long_value - s.short_value AS derived FROM spec s LEFT JOIN direct d ON d.issuer = s.issuer AND d.q_end = s.q_end
), judged AS (
    SELECT *, CASE WHEN direct IS NOT NULL AND derived IS NOT NULL AND fiscal_quarter > 1 THEN direct - derived END AS delta FROM joined
), quarters AS (
    SELECT *, CASE WHEN delta IS NOT NULL AND abs(delta) <= greatest(1.0, abs(CAST(direct AS DOUBLE)) * 1e-9, abs(CAST(derived AS DOUBLE)) * 1e-9, 1.5) THEN 'DIRECT_CONFIRMED_BY_DERIVATION' WHEN delta IS NOT NULL THEN 'DIRECT_DERIVED_CONFLICT'
        WHEN direct IS NOT NULL THEN 'DIRECT' WHEN derived IS NOT NULL THEN 'DERIVED_Q' || fiscal_quarter ELSE 'UNCONSTRUCTED' END AS method FROM judged
), out AS (
    SELECT issuer, fy_start, CAST(fiscal_quarter AS BIGINT) AS fiscal_quarter, coalesce(direct_start, CAST(fy_start + to_months(3 * (fiscal_quarter - 1)) AS DATE)) AS q_start, q_end,
        CASE WHEN method IN ('DIRECT', 'DIRECT_CONFIRMED_BY_DERIVATION') THEN direct WHEN method LIKE 'DERIVED%%' THEN derived END AS value, method,
        CASE WHEN method = 'DIRECT' THEN 'PASS_DIRECT' WHEN method = 'DIRECT_CONFIRMED_BY_DERIVATION' THEN 'PASS_DIRECT_DERIVED_RECONCILED' WHEN method LIKE 'DERIVED%%' THEN 'PASS_DERIVED'
            WHEN method = 'DIRECT_DERIVED_CONFLICT' THEN 'REVIEW_DIRECT_DERIVED_MISMATCH' ELSE 'MISSING_COMPATIBLE_PARENTS' END AS status,
        CASE WHEN method = 'DIRECT_DERIVED_CONFLICT' THEN 'DIRECT_DERIVED_OUTSIDE_TOLERANCE' WHEN method = 'UNCONSTRUCTED' THEN ['MISSING_Q1_PARENT', 'MISSING_HALF_YEAR_PARENT', 'MISSING_NINE_MONTH_PARENT'][fiscal_quarter - 1] END AS reason,
        CAST(delta AS DECIMAL(28,4)) AS delta, q_end + 30 AS available
    FROM quarters
)
""".replace("%%", "%")

_RANKS = "rank() OVER (PARTITION BY q_end, input_id ORDER BY value) + (count(*) OVER (PARTITION BY q_end, input_id, value) - 1) / 2.0"

_CALENDAR = """
days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-01-01', DATE '2028-12-31', INTERVAL 1 DAY) t(d)),
marks AS (SELECT day, month(day) AS m, day(day) AS d, dayofweek(day) AS w FROM days),
calendar AS (
    SELECT day, w IN (0, 6) OR (m = 1 AND ((d = 1 AND w NOT IN (0, 6)) OR (d = 2 AND w = 1))) OR (m = 1 AND w = 1 AND (d - 1) // 7 = 2) OR (m = 2 AND w = 1 AND (d - 1) // 7 = 2)
        OR day + 2 IN (DATE '2023-04-09', DATE '2024-03-31', DATE '2025-04-20', DATE '2026-04-05', DATE '2027-03-28', DATE '2028-04-16')
        OR (m = 5 AND w = 1 AND d > 24) OR (m = 6 AND ((d = 19 AND w NOT IN (0, 6)) OR (d = 20 AND w = 1) OR (d = 18 AND w = 5)))
        OR (m = 7 AND ((d = 4 AND w NOT IN (0, 6)) OR (d = 5 AND w = 1) OR (d = 3 AND w = 5))) OR (m = 9 AND w = 1 AND (d - 1) // 7 = 0) OR (m = 11 AND w = 4 AND (d - 1) // 7 = 3)
        OR (m = 12 AND ((d = 25 AND w NOT IN (0, 6)) OR (d = 26 AND w = 1) OR (d = 24 AND w = 5))) AS closed FROM marks
), sessions AS (SELECT day FROM calendar WHERE NOT closed),
local AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)
"""

_COMPONENTS = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{i}', CAST({w} AS DOUBLE), '{g}')" for f, i, w, g in COMPONENTS) + ") t(factor, input_id, weight, family)"
ORACLE_SQL: dict[str, str] = {
    "ttm_yoy_percentile": f"""{_PANEL}, r AS (SELECT *, rank() OVER (PARTITION BY q_end ORDER BY ttm_yoy) + (count(*) OVER (PARTITION BY q_end, ttm_yoy) - 1) / 2.0 AS midrank, count(*) OVER (PARTITION BY q_end) AS peers
        FROM obs WHERE concept = 'revenue' AND ttm_yoy IS NOT NULL)
        SELECT issuer, q_end, ttm, {_d('ttm_yoy')}, {_d('midrank')}, {_d('100.0 * (CAST(midrank AS DOUBLE) - 0.5) / peers', 'percentile')}, peers FROM r""",
    "gap_run_islands": f"""WITH cust AS (SELECT o_custkey AS issuer, 'order_total' AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q_start, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS value FROM orders GROUP BY ALL),
        ccells AS (SELECT *, last_day(q_start + INTERVAL 2 MONTH) AS q_end, quarter(q_start) AS fiscal_quarter FROM cust), {_runs('ccells')}
        SELECT issuer, q_end, CAST(run AS BIGINT) AS run, coalesce(lag(run, 3) OVER w = run, false) AS whole4 FROM runs {_W}""",
    "yoy_safe_change": f"{_PANEL} SELECT issuer, concept, q_end, {_d('q_yoy')}, q_yoy_change, q_yoy_method, {_d('ttm_yoy')}, ttm_yoy_change, ttm_yoy_method FROM obs",
    "acceleration": f"""{_PANEL}, acc AS (SELECT *, {_accelerated('q_yoy')}, {_accelerated('ttm_yoy')} FROM obs {_W})
        SELECT issuer, concept, q_end, {_d('q_yoy_acceleration')}, q_yoy_acceleration_change, q_yoy_acceleration_method, {_d('ttm_yoy_acceleration')}, ttm_yoy_acceleration_method FROM acc""",
    "qoq_and_rollforward": f"""{_PANEL}, q AS (SELECT *, CASE WHEN lag(run) OVER w = run THEN lag(value) OVER w END AS last, CASE WHEN lag(run, 4) OVER w = run THEN lag(ttm) OVER w + value - lag(value, 4) OVER w END AS expected FROM obs {_W})
        SELECT issuer, concept, q_end, {_d('CASE WHEN last > 0 THEN CAST(value AS DOUBLE) / CAST(last AS DOUBLE) - 1 END', 'qoq')}, value - last AS qoq_change,
            CASE WHEN expected = ttm THEN 'PASS' WHEN expected IS NOT NULL AND ttm IS NOT NULL THEN 'FAIL' END AS rollforward FROM q""",
    "fcf_self_join": f"WITH {_CELLS}, {_FCF} SELECT issuer, q_start, q_end, value FROM fcf WHERE concept = 'free_cash_flow'",
    "ttm_margins": f"WITH {_CELLS}, {_MARGIN} SELECT issuer, q_end, {_d('margin')}, {_d('prior_margin')}, {_d('yoy_pp')}, {_d('acceleration_pp')} FROM margins",
    "leverage_spread": f"{_PANEL} SELECT a.issuer, a.q_end, {_d('a.ttm_yoy - b.ttm_yoy', 'spread')} FROM obs a JOIN obs b USING (issuer, q_end) WHERE a.concept = 'operating_income' AND b.concept = 'revenue' AND a.ttm_yoy IS NOT NULL AND b.ttm_yoy IS NOT NULL",
    "observation_audit": f"""{_PANEL}, q AS (SELECT *, CASE WHEN lag(run, 4) OVER w = run THEN lag(ttm) OVER w + value - lag(value, 4) OVER w END AS expected FROM obs {_W})
        SELECT issuer, concept, count(*) AS quarters, count(q_yoy_change) AS q_yoy_count, count(ttm_yoy_change) AS ttm_yoy_count, count(*) FILTER (expected <> ttm) AS rollforward_failures,
            arg_max_null(ttm_yoy_method, q_end) AS latest_method FROM q GROUP BY issuer, concept""",
    "persistence_pattern": f"""{_PANEL}, {_HISTORY}
        SELECT issuer, q_end, len(h) AS values, CASE WHEN len(h) < 2 THEN 'INSUFFICIENT_HISTORY' WHEN list_min(h) > 0 AND h = list_sort(h) THEN 'CONSISTENTLY_POSITIVE_IMPROVING' WHEN list_min(h) > 0 AND h = list_reverse_sort(h) THEN 'POSITIVE_BUT_SLOWING'
            WHEN list_max(h) < 0 AND h = list_sort(h) THEN 'NEGATIVE_BUT_RECOVERING' WHEN list_max(h) < 0 AND h = list_reverse_sort(h) THEN 'CONSISTENTLY_NEGATIVE_DETERIORATING' ELSE 'NEUTRAL_OR_ALTERNATING' END AS pattern
        FROM history WHERE concept = 'revenue' AND q_yoy IS NOT NULL""",
    "persistence_score": f"""{_PANEL}, {_HISTORY} SELECT issuer, concept, q_end, {_d(_score("CASE WHEN concept = 'revenue' THEN 0.01 ELSE 0.02 END"), 'score')} FROM history WHERE q_yoy IS NOT NULL AND concept IN ('revenue', 'operating_income')""",
    "quarters_from_ytd": f"{_YTD} SELECT * FROM out",
    "quarter_audit": f"""{_YTD} SELECT issuer, count(*) FILTER (status = 'PASS_DIRECT') AS direct, count(*) FILTER (status = 'PASS_DIRECT_DERIVED_RECONCILED') AS reconciled, count(*) FILTER (status = 'PASS_DERIVED') AS derived,
        count(*) FILTER (status = 'REVIEW_DIRECT_DERIVED_MISMATCH') AS conflicts, count(*) FILTER (status = 'MISSING_COMPATIBLE_PARENTS') AS missing, min(q_end) FILTER (status LIKE 'PASS%' AND value IS NOT NULL) AS first_end,
        max(q_end) FILTER (status LIKE 'PASS%' AND value IS NOT NULL) AS last_end, CASE WHEN count(*) FILTER (status LIKE 'PASS%' AND value IS NOT NULL) >= 9 THEN 'PASS_NINE_QUARTERS' ELSE 'REVIEW_SHORT_HISTORY' END AS governance FROM out GROUP BY issuer""",
    "ytd_identities": f"""{_YTD}, parts AS (SELECT issuer, CAST(date_trunc('year', q_start) AS DATE) AS fy_start, quarter(q_start) AS fq, value FROM direct),
        totals AS (SELECT issuer, fy_start, h1 AS total, 'HALF_YEAR_YTD' AS class, 2 AS k FROM long UNION ALL SELECT issuer, fy_start, m9, 'NINE_MONTH_YTD', 3 FROM long UNION ALL SELECT issuer, fy_start, fy, 'FISCAL_YEAR', 4 FROM long)
        SELECT t.issuer, t.fy_start, t.class, abs(t.total - sum(p.value)) <= 1 AS identity_ok FROM totals t JOIN parts p ON p.issuer = t.issuer AND p.fy_start = t.fy_start AND p.fq <= t.k WHERE t.total IS NOT NULL GROUP BY t.issuer, t.fy_start, t.class, t.total, t.k HAVING count(*) = t.k""",
    "vintage_latest": f"WITH {_latest('2000-12-31')} SELECT issuer, report_period, accession, form, available, value FROM latest",
    "vintage_conflict": f"""WITH {_FILINGS}, m AS (SELECT * REPLACE (last_day(available) AS available) FROM filings), l AS (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY issuer, report_period ORDER BY available DESC) = 1)
        SELECT issuer, report_period, CASE WHEN count(DISTINCT value) = 1 THEN 'SELECTED' ELSE 'CONFLICT' END AS outcome, count(DISTINCT value) AS values FROM l GROUP BY issuer, report_period""",
    "restatements": f"""WITH {_FILINGS}, r AS (SELECT issuer, report_period, arg_min(value, (available, accepted, accession)) AS first_value, arg_max(value, (available, accepted, accession)) AS last_value, count(*) AS vintages FROM filings GROUP BY ALL)
        SELECT issuer, report_period, first_value, last_value, vintages, CAST(last_value - first_value AS DECIMAL(18,2)) AS restated_by, {_d('CAST(last_value - first_value AS DOUBLE) / nullif(abs(CAST(first_value AS DOUBLE)), 0)', 'restated_share')}, first_value <> last_value AS differs FROM r""",
    "last_n_periods": f"""WITH {_latest('2001-12-31')}, k AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY report_period DESC) <= 12)
        SELECT issuer, report_period, accession, row_number() OVER (PARTITION BY issuer ORDER BY report_period) AS sequence FROM k""",
    "filing_history_audit": f"""WITH {_latest('2001-12-31')}, k AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY report_period DESC) <= 12),
        a AS (SELECT issuer, count(*) FILTER (form LIKE '10-Q%') AS quarterly, count(*) FILTER (form LIKE '10-K%') AS yearly, CAST(max(report_period) - min(report_period) AS BIGINT) AS span_days FROM k GROUP BY issuer)
        SELECT *, CASE WHEN quarterly >= 8 AND yearly >= 2 AND span_days >= 900 THEN 'PASS_TARGET_HISTORY' ELSE 'REVIEW_HISTORY_GAP' END AS history FROM a""",
    "filing_rows": f"""WITH {_FILINGS}, x AS (SELECT *, CASE WHEN available > DATE '2000-06-30' THEN 'EXCLUDED_LOOKAHEAD' END AS exclusion FROM filings)
        SELECT accession, form, form LIKE '%/A' AS is_amendment, exclusion IS NULL AS eligible, exclusion, report_period <= CAST(accepted AS DATE) AND CAST(accepted AS DATE) <= available AS consistent FROM x""",
    "as_known_on": f"""WITH {_FILINGS}, d AS (SELECT unnest([DATE '1999-12-31', DATE '2000-12-31', DATE '2001-06-30']) AS model_date)
        SELECT model_date, issuer, report_period, accession, value FROM d JOIN filings ON available <= model_date QUALIFY row_number() OVER (PARTITION BY model_date, issuer, report_period ORDER BY available DESC, accepted DESC, accession DESC) = 1""",
    "scd2_asof": """WITH o AS (SELECT o_custkey AS issuer, CAST(o_orderdate AS DATE) AS valid_from, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL),
        h AS (SELECT *, lead(valid_from) OVER (PARTITION BY issuer ORDER BY valid_from) AS valid_to FROM o)
        SELECT issuer, priority, valid_from, valid_to FROM h WHERE valid_from <= DATE '2000-01-01' AND (valid_to IS NULL OR DATE '2000-01-01' < valid_to)""",
    "priority_choice": """WITH r AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(l_quantity AS DECIMAL(12,2)) AS value, p_size % 3 AS priority FROM lineitem JOIN part ON p_partkey = l_partkey),
        b AS (SELECT *, min(priority) OVER (PARTITION BY l_suppkey, month) AS best FROM r), k AS (SELECT l_suppkey, month, priority, count(DISTINCT value) AS kinds FROM r GROUP BY ALL)
        SELECT b.l_suppkey, b.month, count(*) FILTER (b.priority = best AND kinds = 1) AS selected, count(*) FILTER (b.priority = best AND kinds > 1) AS conflict, count(*) FILTER (b.priority > best) AS superseded
        FROM b JOIN k USING (l_suppkey, month, priority) GROUP BY ALL""",
    "availability_dates": f"""WITH {_CALENDAR}, n AS (SELECT c.day, c.closed, (SELECT min(s.day) FROM sessions s WHERE s.day > c.day) AS nxt FROM calendar c WHERE c.day < DATE '2024-03-01'),
        j AS (SELECT event_id, CAST(t AS DATE) AS local_date, NOT n.closed AND CAST(t AS TIME) < TIME '09:30:00' AS early, nxt FROM local JOIN n ON n.day = CAST(t AS DATE))
        SELECT event_id, local_date, CASE WHEN early THEN local_date ELSE nxt END AS buffer_day, CASE WHEN early THEN nxt ELSE (SELECT n2.nxt FROM n n2 WHERE n2.day = j.nxt) END AS available_date FROM j""",
    "last_session_asof": f"""WITH {_CALENDAR}, asked AS (SELECT event_id, t, CASE WHEN event_id % 2 = 0 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) - 3 END AS d FROM local),
        k AS (SELECT c.day, c.closed, (SELECT max(s.day) FROM sessions s WHERE s.day <= c.day) AS last, (SELECT max(s.day) FROM sessions s WHERE s.day < c.day) AS earlier FROM calendar c WHERE c.day < DATE '2024-03-01'),
        j AS (SELECT a.*, k.closed, CASE WHEN NOT k.closed AND a.d = CAST(t AS DATE) AND CAST(t AS TIME) < TIME '16:00:00' THEN true ELSE false END AS open_now, last, earlier FROM asked a JOIN k ON k.day = a.d)
        SELECT event_id, CASE WHEN open_now THEN earlier ELSE last END AS effective_date, (CASE WHEN open_now THEN earlier ELSE last END) <> d AS adjusted,
            CASE WHEN dayofweek(d) IN (0, 6) THEN 'WEEKEND' WHEN closed THEN 'MARKET_HOLIDAY' WHEN open_now THEN 'SESSION_NOT_CLOSED' ELSE 'NONE' END AS reason FROM j""",
    "context_match_cardinality": """WITH f AS (SELECT l_orderkey AS accession, CAST(l_partkey % 5 AS VARCHAR) AS local_concept, CAST(date_trunc('year', l_shipdate) AS DATE) AS s, last_day(CAST(l_shipdate AS DATE)) AS e, CAST(l_quantity AS DECIMAL(20,2)) AS value,
            l_suppkey || '-' || l_linenumber AS context_id, l_suppkey % 2 AS dimensions FROM lineitem),
        c AS (SELECT DISTINCT accession, local_concept, s, e, value FROM f WHERE accession IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')),
        i AS (SELECT accession, local_concept, s, e, value, count(DISTINCT context_id) AS contexts, count(DISTINCT context_id) FILTER (dimensions = 0) AS plain, min(context_id) FILTER (dimensions = 0) AS one FROM f WHERE dimensions = 0 OR accession % 4 > 0 GROUP BY ALL),
        m AS (SELECT c.*, coalesce(i.contexts, 0) AS contexts, CASE WHEN i.contexts IS NULL THEN 'NO_MATCH' WHEN plain = 0 THEN 'ONLY_DIMENSIONED' WHEN plain > 1 THEN 'MULTIPLE_DEFAULT_CONTEXTS' ELSE 'EXACT' END AS match, one FROM c LEFT JOIN i USING (accession, local_concept, s, e, value))
        SELECT match, count(*) AS candidates, CAST(sum(contexts) AS BIGINT) AS contexts, max(one) FILTER (match = 'EXACT') AS last_context FROM m GROUP BY match""",
    "identity_0_1_many": """WITH s AS (SELECT concat_ws('-', c_nationkey, c_mktsegment, c_custkey % 7) AS symbol, c_custkey AS entity FROM customer),
        a AS (SELECT DISTINCT concat_ws('-', c_nationkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE c_custkey % 7 END) AS symbol FROM customer), k AS (SELECT symbol, count(*) AS n, min(entity) AS e FROM s GROUP BY symbol)
        SELECT a.symbol, CASE WHEN n = 1 THEN e END AS entity, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS resolution FROM a LEFT JOIN k USING (symbol)""",
    "requested_selection": """WITH r AS (SELECT l_suppkey AS issuer, count(*) AS lines FROM lineitem GROUP BY 1)
        SELECT s_suppkey * 2 AS issuer, s_suppkey AS pos, lines, CASE WHEN lines IS NULL THEN 'UNSCORED' ELSE 'SCORED' END AS status FROM supplier LEFT JOIN r ON r.issuer = s_suppkey * 2""",
    "batch_slice": "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey, row_number() OVER w AS position, CAST(ceil(row_number() OVER w / 4.0) AS BIGINT) AS batch FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    "set_and_key_gates": f"""WITH {_CELLS}, l AS (SELECT DISTINCT l_suppkey + 1 AS k FROM lineitem), s AS (SELECT s_suppkey AS k FROM supplier), rev AS (SELECT issuer, q_end FROM cells WHERE concept = 'revenue')
        SELECT 'left_only' AS gate, count(*) AS broken FROM l ANTI JOIN s USING (k) UNION ALL SELECT 'right_only', count(*) FROM s ANTI JOIN l USING (k)
        UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'missing_cell', (SELECT count(DISTINCT issuer) * count(DISTINCT q_end) - count(*) FROM rev)""",
    "fallback_union": """WITH o AS (SELECT o_custkey AS issuer, month(o_orderdate) AS m, CAST(o_totalprice AS DECIMAL(12,2)) AS value FROM orders), a AS (SELECT issuer, sum(value) AS value FROM o WHERE m IN (1, 7) GROUP BY 1)
        SELECT issuer, CAST(value AS DECIMAL(28,2)) AS value, 'FIRST' AS source FROM a UNION ALL SELECT issuer, CAST(sum(value) AS DECIMAL(28,2)), 'SECOND' FROM o WHERE issuer NOT IN (SELECT issuer FROM a) GROUP BY issuer""",
    "cell_diff": """WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS total, o_orderstatus AS status FROM orders)
        SELECT k, 'total' AS field, total AS old_value, CASE WHEN k % 97 = 0 THEN NULL ELSE '0.00' END AS new_value FROM o WHERE k % 97 = 0 OR (k % 50 = 0 AND CAST(total AS DECIMAL(12,2)) <> 0)
        UNION ALL SELECT k, 'status', status, CASE WHEN k % 97 = 0 THEN NULL ELSE 'X' END FROM o WHERE k % 97 = 0 OR (k % 41 = 0 AND status <> 'X')""",
    "row_diff": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'total|status' ELSE concat_ws('|', CASE WHEN o_orderkey % 50 = 0 AND o_totalprice <> 0 THEN 'total' END, CASE WHEN o_orderkey % 41 = 0 THEN 'status' END) END AS columns
        FROM orders WHERE o_orderkey % 97 = 0 OR (o_orderkey % 50 = 0 AND o_totalprice <> 0) OR o_orderkey % 41 = 0 ORDER BY k LIMIT 10""",
    "first_failing_reason": f"""{_PANEL}, q AS (SELECT *, CASE WHEN lag(run, 4) OVER w = run THEN lag(ttm) OVER w + value - lag(value, 4) OVER w END AS expected, (issuer * 7 + year(q_end) * 4 + quarter(q_end)) % 13 AS code FROM obs {_W}),
        z AS (SELECT *, q_end + CASE WHEN code = 2 THEN -5 ELSE 20 END AS available FROM q)
        SELECT issuer, concept, q_end, CASE WHEN code = 1 THEN 'MODEL_DATE_MISMATCH' WHEN code = 3 THEN 'MISSING_SOURCE_LINEAGE' WHEN code = 4 OR coalesce(expected <> ttm, false) THEN 'PERIOD_INCOMPARABLE_OR_CONSTRUCTION_FAILURE'
            WHEN available > DATE '2001-06-30' OR q_end > DATE '2001-06-30' THEN 'LOOK_AHEAD_OR_MISSING_AVAILABILITY' WHEN available < q_end THEN 'AVAILABILITY_PRECEDES_PERIOD_END' WHEN DATE '2001-06-30' - available > 180 THEN 'STALE_EXCLUDED_OVER_180_DAYS' END AS reason FROM z""",
    "metric_eligibility": f"""{_PANEL}, s AS (SELECT unnest([{{'scenario': 'BASELINE', 'x': 180}}, {{'scenario': 'AGE_90_150', 'x': 150}}, {{'scenario': 'AGE_150_210', 'x': 210}}], recursive := true)),
        r AS (SELECT scenario, concept || '_ttm_yoy' AS input_id, CASE WHEN concept NOT IN ('revenue', 'operating_income') THEN 'DIAGNOSTIC_OR_CONDITIONAL_INPUT' WHEN q_end + 20 > DATE '2001-06-30' OR q_end > DATE '2001-06-30' THEN 'LOOK_AHEAD_OR_MISSING_PERIOD'
            WHEN ttm_yoy_method <> 'PERCENT_CHANGE' THEN 'FALLBACK_OR_UNAPPROVED_TRANSFORMATION' WHEN DATE '2001-06-30' - (q_end + 20) > x THEN 'STALE_EXCLUDED' ELSE 'ELIGIBLE' END AS reason FROM obs, s WHERE ttm_yoy_method IS NOT NULL)
        SELECT scenario, input_id, reason, count(*) AS n FROM r GROUP BY ALL""",
    "direction_families": f"""{_FAMILIES}, c AS (SELECT *, [growth, profit, cash, margin] AS f FROM families), n AS (SELECT *, len(list_filter(f, lambda x: x = 'SUPPORTIVE')) AS up, len(list_filter(f, lambda x: x = 'ADVERSE')) AS down, len(list_filter(f, lambda x: x <> 'INELIGIBLE')) AS eligible FROM c)
        SELECT issuer, q_end, growth, profit, cash, margin, {_d('CAST(up - down AS DOUBLE) / nullif(eligible, 0)', 'direction_index')}, eligible FROM n""",
    "breadth_conflict_scenarios": f"""{_FAMILIES}, s AS (SELECT unnest([{{'scenario': 'BASELINE', 'c': 0.25}}, {{'scenario': 'ROBUST_Z', 'c': 0.25}}, {{'scenario': 'BREADTH_CONFLICT_0', 'c': 0.0}}, {{'scenario': 'BREADTH_CONFLICT_0_5', 'c': 0.5}}], recursive := true)),
        v AS (SELECT scenario, issuer, q_end, unnest([growth, profit, cash, margin]) AS k, c FROM families, s), w AS (SELECT *, CASE k WHEN 'SUPPORTIVE' THEN 1.0 WHEN 'NEUTRAL' THEN 0.5 WHEN 'ADVERSE' THEN 0.0 WHEN 'CONFLICTED' THEN c END AS p FROM v)
        SELECT scenario, issuer, q_end, count(p) AS families, {_d('CASE WHEN count(p) >= 3 THEN 100.0 * CAST(sum(p) AS DOUBLE) / count(p) END', 'breadth_score')} FROM w GROUP BY scenario, issuer, q_end""",
    "coverage_by_transformation": f"""{_PANEL} SELECT concept || '_ttm_yoy' AS input_id, ttm_yoy_method AS transformation, count(DISTINCT issuer) AS peers, CASE WHEN count(DISTINCT issuer) >= 50 THEN 'PASS' ELSE 'PEER_GROUP_INSUFFICIENT' END AS coverage FROM obs WHERE ttm_yoy_method IS NOT NULL GROUP BY 1, 2""",
    "midrank_percentile": f"""{_METRICS_BY_DIGITS}, r AS (SELECT *, count(*) OVER (PARTITION BY q_end, input_id, value) AS ties, count(*) OVER (PARTITION BY q_end, input_id) AS peers, {_RANKS} AS midrank FROM metrics)
        SELECT q_end, issuer, input_id, {_d('value')}, ties, peers, {_d('midrank')}, {_d('100.0 * (CAST(midrank AS DOUBLE) - 0.5) / peers', 'percentile')} FROM r""",
    "mad_robust_z": f"""{_METRICS}, c AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY q_end, input_id) AS center FROM metrics), m AS (SELECT *, quantile_cont(abs(value - center), 0.5) OVER (PARTITION BY q_end, input_id) AS mad FROM c)
        SELECT q_end, issuer, input_id, {_d('center')}, {_d('mad')}, {_d('CASE WHEN mad > 0 THEN greatest(least(0.6745 * (value - center) / mad, 3.0), -3.0) END', 'z')} FROM m""",
    "winsor_scenarios": f"""{_METRICS}, q AS (SELECT q_end, input_id, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b, quantile_cont(value, 0.05) AS c, quantile_cont(value, 0.95) AS d FROM metrics GROUP BY ALL)
        SELECT 'WINSOR_2_5_97_5' AS scenario, q_end, issuer, input_id, {_d('greatest(least(value, b), a)', 'clipped')}, value < a OR value > b AS extreme FROM metrics JOIN q USING (q_end, input_id)
        UNION ALL SELECT 'WINSOR_5_95', q_end, issuer, input_id, {_d('greatest(least(value, d), c)', 'clipped')}, value < a OR value > b FROM metrics JOIN q USING (q_end, input_id)""",
    "spearman_sensitivity": f"""{_PANEL}, p AS (SELECT q_end, issuer, round(q_yoy, 2) AS a, round(ttm_yoy, 2) AS b FROM obs WHERE concept = 'revenue' AND q_yoy IS NOT NULL AND ttm_yoy IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY q_end ORDER BY a) + (count(*) OVER (PARTITION BY q_end, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY q_end ORDER BY b) + (count(*) OVER (PARTITION BY q_end, b) - 1) / 2.0 AS rb, count(*) OVER (PARTITION BY q_end) AS k FROM p),
        m AS (SELECT *, abs(100.0 * (CAST(ra AS DOUBLE) - 0.5) / k - 100.0 * (CAST(rb AS DOUBLE) - 0.5) / k) AS move FROM r)
        SELECT q_end, count(*) AS n, CAST(CASE WHEN count(*) > 1 AND NOT isnan(corr(ra, rb)) THEN corr(ra, rb) END AS DECIMAL(18,6)) AS rho, CAST(avg(move) AS DECIMAL(18,6)) AS mean_move, CAST(max(move) AS DECIMAL(18,6)) AS max_move, count(*) FILTER (move > 10) AS over_10 FROM m GROUP BY q_end""",
    "peer_fallback": f"""{_METRICS}, h AS (SELECT s_suppkey AS issuer, s_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey), m AS (SELECT * FROM metrics JOIN h USING (issuer)),
        k AS (SELECT *, count(*) OVER (PARTITION BY q_end, input_id, nation) AS a, count(*) OVER (PARTITION BY q_end, input_id, region) AS b, count(*) OVER (PARTITION BY q_end, input_id) AS c FROM m)
        SELECT q_end, issuer, input_id, CASE WHEN a >= 4 THEN 'NATION' WHEN b >= 10 THEN 'REGION' WHEN c >= 20 THEN 'ALL' END AS level, CASE WHEN a >= 4 THEN CAST(nation AS VARCHAR) WHEN b >= 10 THEN CAST(region AS VARCHAR) WHEN c >= 20 THEN 'all' END AS level_key,
            CASE WHEN a >= 4 THEN a WHEN b >= 10 THEN b WHEN c >= 20 THEN c END AS level_peers FROM k""",
    "score_bands": f"""{_METRICS}, r AS (SELECT input_id, 100.0 * (CAST({_RANKS} AS DOUBLE) - 0.5) / count(*) OVER (PARTITION BY q_end, input_id) AS p FROM metrics)
        SELECT input_id, CASE WHEN p >= 80 THEN 'VERY_HIGH' WHEN p >= 60 THEN 'HIGH' WHEN p >= 40 THEN 'MIDDLE' WHEN p >= 20 THEN 'LOW' ELSE 'VERY_LOW' END AS band, count(*) AS n FROM r GROUP BY ALL""",
    "confidence_bounds": f"""{_PANEL}, a AS (SELECT issuer, CAST(count(ttm_yoy_change) AS DOUBLE) / count(*) AS coverage, issuer % 2 = 0 AS q4, count(*) < 25 AS stale FROM obs WHERE concept = 'revenue' GROUP BY issuer),
        f AS (SELECT *, CAST(0.20 AS DOUBLE) * 100 + CAST(0.25 AS DOUBLE) * (CASE WHEN q4 THEN 98 ELSE 100 END) + CAST(0.15 AS DOUBLE) * (CASE WHEN stale THEN 85 ELSE 100 END) + CAST(0.15 AS DOUBLE) * least(100.0, 100.0 * coverage / CAST(0.85 AS DOUBLE)) AS lo FROM a)
        SELECT issuer, {_d('coverage')}, {_d('lo', 'confidence_low')}, {_d('lo + CAST(0.20 AS DOUBLE) * 95 + CAST(0.05 AS DOUBLE) * 100', 'confidence_high')} FROM f""",
    "publication_gate": """WITH l AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last, count(*) AS lines FROM lineitem GROUP BY 1),
        r AS (SELECT CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS c, o_orderstatus = 'P' AS bad, lines * 20 AS confidence, DATE '2001-12-31' - last AS age FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        g AS (SELECT CASE WHEN c IS NULL THEN 1 WHEN bad THEN 2 WHEN confidence IS NULL OR confidence < 70 THEN 3 WHEN age IS NULL OR age > 180 THEN 4 WHEN age > 120 THEN 5 ELSE 6 END AS k FROM r)
        SELECT k >= 5 AS published, ['INSUFFICIENT_HISTORY', 'REVIEW_REQUIRED', 'REVIEW_REQUIRED', 'STALE', 'STALE', 'PARTIAL'][k] AS data_status, ['EXISTING_CANDIDATE_COVERAGE_OR_HISTORY_HOLD', 'FILING_VINTAGE_VALIDATION_FAILED', 'CONFIDENCE_BELOW_RESEARCH_FLOOR',
            'PRIMARY_EVIDENCE_TOO_OLD_OR_AGE_UNKNOWN', 'OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING', 'OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING'][k] AS gate_reason, count(*) AS n FROM g GROUP BY k""",
    "component_completeness": """WITH r AS (SELECT l_orderkey, CAST(p_size % 3 AS VARCHAR) AS c, CAST(l_quantity AS DECIMAL(12,2)) AS v FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT l_orderkey, sum(v) AS s, list_distinct(list(c)) AS have FROM r GROUP BY 1)
        SELECT l_orderkey, CASE WHEN len(have) = 3 THEN CAST(s AS DECIMAL(28,2)) END AS total, array_to_string(list_filter(['0', '1', '2'], lambda x: NOT list_contains(have, x)), '|') AS missing FROM g""",
    "lineage_collect": """SELECT l_suppkey AS issuer, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q_start, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(28,2)) AS value, count(*) AS parent_count,
        array_to_string(list_sort(list_distinct(list(l_orderkey))), '|') AS parent_ids, CAST(max(l_shipdate) AS DATE) AS signal_available FROM lineitem GROUP BY 1, 2""",
    "vintage_audit": f"""WITH {_FILINGS}, c AS (SELECT DISTINCT l_suppkey AS issuer, l_orderkey AS accession FROM lineitem)
        SELECT c.issuer, count(*) AS parents, count(*) FILTER (f.available IS NULL OR f.available > DATE '2000-06-30') AS failures FROM c LEFT JOIN filings f USING (accession) GROUP BY c.issuer""",
    "cited_once": """WITH o AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT c, d, count(*) AS n FROM o GROUP BY ALL)
        SELECT CASE WHEN n > 1 THEN 'SEVERAL_SOURCES' ELSE 'PASS' END AS lineage, count(*) AS n FROM o JOIN k USING (c, d) GROUP BY 1""",
    "accounting_text_to_number": f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 5 = 3 THEN NULL WHEN l_orderkey % 5 IN (0, 2) THEN -p ELSE p END * CASE WHEN l_linenumber = 1 THEN 1000 ELSE 1 END AS DECIMAL(28,4)) AS value, {_d('CASE WHEN l_linenumber % 2 = 0 THEN 500 ELSE 0 END', 'bound')} FROM l""",
    "json_flatten": "SELECT user_id, event_type AS taxonomy_concept, event_id, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS DECIMAL(20,2)) AS value FROM events WHERE event_id % 5 <> 0",
    "parallel_arrays": "SELECT o_custkey, o_orderkey AS accession, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5 THEN o_orderstatus END AS form FROM orders",
    "tagged_html_facts": f"""WITH {_CELLS} SELECT issuer, 'Revenues' AS concept, CASE WHEN month(q_end) <> 12 THEN q_start END AS q_start, CASE WHEN month(q_end) <> 12 THEN q_end END AS q_end, value, CASE WHEN month(q_end) = 12 THEN 'CONTEXT_NOT_FOUND' ELSE 'FOUND' END AS match FROM cells WHERE concept = 'revenue'""",
    "preamble_table": """SELECT CAST(s_nationkey AS BIGINT) AS file, DATE '2026-09-17' AS as_of, 'S' || s_suppkey AS symbol, s_name || ', Inc' AS name,
        CASE WHEN s_suppkey % 9 = 0 THEN 'NON_EQUITY' WHEN s_suppkey % 6 = 0 THEN 'MISSING_SECTOR' WHEN s_suppkey % 6 = 1 THEN 'UNKNOWN_SECTOR' ELSE 'CANDIDATE' END AS class FROM supplier""",
    "symbol_map": "SELECT DISTINCT 'S' || c_nationkey || 'X' || (c_custkey % 11) AS symbol, lpad(CAST(c_custkey % 11 AS VARCHAR), 10, '0') AS entity FROM customer",
    "request_list": """WITH r AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'BAD NAME' ELSE 'AB' || (c_custkey % 500) END AS symbol FROM customer), f AS (SELECT *, min(pos) OVER (PARTITION BY symbol) AS first FROM r)
        SELECT pos, symbol, CASE WHEN symbol = '' THEN 'EMPTY' WHEN symbol = 'BAD NAME' THEN 'INVALID_SYMBOL' WHEN pos > first THEN 'DUPLICATE' END AS problem FROM f""",
    "archive_union": """WITH o AS (SELECT o_orderkey AS accession, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-12-31' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1999-01-01')
        SELECT accession, CASE WHEN accession % 30 <> 0 THEN o_orderstatus END AS o_orderstatus, CAST(CASE WHEN accession % 30 <> 0 THEN 1 ELSE 2 END AS BIGINT) AS versions FROM o""",
    "distinct_payloads": "SELECT sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS chars, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text",
    "incremental_new": """WITH o AS (SELECT o_custkey || '/' || year(o_orderdate) AS url, CAST(o_orderdate AS DATE) AS day, o_orderkey AS accession, o_orderstatus FROM orders)
        SELECT url, arg_max(accession, (day, accession)) AS accession FROM o WHERE o_orderstatus <> 'P' AND url NOT IN (SELECT url FROM o WHERE accession % 4 = 0) GROUP BY url""",
    # a reference cut off before its semicolon, as at the end of a shortened title, is read as HTML reads it
    "html_elements": """SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, CASE WHEN html LIKE '%<title>%</title>%' THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39(;|$)', chr(39), 'g'), '&amp;?', '&', 'g')) END AS title FROM pages""",
    "stream_latest": f"""WITH {_FILINGS} SELECT issuer, report_period, accession, value FROM filings QUALIFY row_number() OVER (PARTITION BY issuer, report_period ORDER BY available DESC, accepted DESC, accession DESC) = 1""",
    "company_coverage": f"""{_PANEL}, last AS (SELECT issuer, concept, arg_max_null(q_yoy, q_end) AS q, arg_max_null(ttm_yoy, q_end) AS t FROM obs GROUP BY ALL),
        have AS (SELECT issuer, concept || '_q_yoy' AS input_id FROM last WHERE q IS NOT NULL UNION ALL SELECT issuer, concept || '_ttm_yoy' FROM last WHERE t IS NOT NULL),
        named AS (SELECT issuer, replace(input_id, 'cash_from_operations', 'cfo') AS input_id FROM have), ids AS (SELECT DISTINCT issuer FROM obs), c AS ({_COMPONENTS})
        SELECT i.issuer, c.factor, {_d('CAST(sum(CASE WHEN n.input_id IS NULL THEN 0 ELSE c.weight END) AS DOUBLE)', 'coverage')} FROM ids i CROSS JOIN c LEFT JOIN named n ON n.issuer = i.issuer AND n.input_id = c.input_id GROUP BY i.issuer, c.factor""",
}
