"""DuckDB SQL for the stage queries, from the rules of the method and not from the Spark code."""

from __future__ import annotations

from vintara.functions.scalars import SERIES_TERMS
from vintara.oracle import _CELLS, _COMPONENTS, _FCF, _HISTORY, _MARGIN, _W, _accelerated, _d, _digits, _dir, _obs, _rec, _score
from vintara.plans import policy

_K = "q_end, issuer"


def _values(rows, names: str) -> str:
    """A relation from fixed rows; numbers are doubles."""
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") t({names})"


def _phi(z: str) -> str:
    series = "CAST(1 AS DOUBLE)"
    for k in range(SERIES_TERMS, 0, -1):
        series = f"(1 + {series} * {z} * {z} / {2 * k + 1})"
    return f"(0.5 + {z} * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series})"


def _rec_of(*classes: str) -> str:
    return _rec(*classes)


_FCF_MARGIN = _MARGIN
for _old, _new in (("joint", "fjoint"), ("jruns", "fjruns"), ("msums", "fmsums"), ("mrates", "fmrates"), ("mpp", "fmpp"), ("margins", "fmargins"), ("FROM cells a JOIN cells b", "FROM fcf a JOIN fcf b"), ("'operating_income'", "'free_cash_flow'")):
    _FCF_MARGIN = _FCF_MARGIN.replace(_old, _new)

_kind = lambda k, m: f"{{'kind': '{k}', 'v': coalesce({k}, CAST({k}_change AS DOUBLE)), 't': {m}}}"
_INPUTS = f"""WITH {_CELLS}, {_FCF}, {_obs('fcf')}, {_MARGIN}, {_FCF_MARGIN}, acc AS (SELECT *, {_accelerated('q_yoy')}, {_accelerated('ttm_yoy')} FROM obs {_W}),
named AS (SELECT *, CASE concept WHEN 'cash_from_operations' THEN 'cfo' WHEN 'capital_expenditures' THEN 'capex' WHEN 'free_cash_flow' THEN 'fcf' ELSE concept END AS short FROM acc),
every AS (
    SELECT {_K}, short || '_' || kind AS input_id, v, t FROM (SELECT {_K}, short, unnest([{_kind('q_yoy', 'q_yoy_method')}, {_kind('ttm_yoy', 'ttm_yoy_method')}, {_kind('q_yoy_acceleration', 'q_yoy_acceleration_method')}, {_kind('ttm_yoy_acceleration', 'ttm_yoy_acceleration_method')}], recursive := true) FROM named)
    UNION ALL SELECT {_K}, 'operating_margin_yoy_pp', yoy_pp, 'MARGIN_YOY_PP' FROM margins UNION ALL SELECT {_K}, 'operating_margin_acceleration_pp', acceleration_pp, 'MARGIN_YOY_PP_DELTA' FROM margins
    UNION ALL SELECT {_K}, 'fcf_margin_yoy_pp', yoy_pp, 'MARGIN_YOY_PP' FROM fmargins UNION ALL SELECT {_K}, 'fcf_margin_acceleration_pp', acceleration_pp, 'MARGIN_YOY_PP_DELTA' FROM fmargins
    UNION ALL SELECT a.q_end, a.issuer, 'operating_leverage_spread', a.ttm_yoy - b.ttm_yoy, 'YOY_RATE_SPREAD' FROM obs a JOIN obs b USING (issuer, q_end) WHERE a.concept = 'operating_income' AND b.concept = 'revenue'
), inputs AS (SELECT {_K}, input_id, round(v, 6) AS value, t AS transformation, CAST(80 + (issuer * 13 + month(q_end) * 7) % 120 AS INTEGER) AS age_days FROM every WHERE v IS NOT NULL),
req AS ({_values(policy.TRANSFORMATIONS, 'input_id, required')}), c AS ({_COMPONENTS}),
fit AS (SELECT i.* FROM inputs i JOIN req USING (input_id) WHERE transformation = required),
wide AS (SELECT {_K}, {', '.join(f"max(f.value) FILTER (f.input_id = '{n}') AS {n}" for n, _ in policy.TRANSFORMATIONS)} FROM (SELECT DISTINCT {_K} FROM inputs) LEFT JOIN fit f USING ({_K}) GROUP BY ALL),
classes AS (SELECT *, {_rec(_dir('revenue_ttm_yoy', 0.01), _dir('revenue_q_yoy', 0.01))} AS growth,
    CASE WHEN operating_income_ttm_yoy IS NULL THEN 'INELIGIBLE' ELSE {_rec(_dir('operating_income_ttm_yoy', 0.02), _dir('operating_margin_yoy_pp', 0.0025))} END AS profit,
    {_rec(_dir('cfo_ttm_yoy', 0.03), _dir('fcf_ttm_yoy', 0.03))} AS cash, CASE WHEN operating_margin_yoy_pp IS NULL THEN 'INELIGIBLE' ELSE {_rec(_dir('operating_margin_yoy_pp', 0.0025), _dir('fcf_margin_yoy_pp', 0.005))} END AS margin FROM wide)
""".replace("WITH \nli AS", "WITH li AS").replace("), wide AS (\n    SELECT issuer, q_start,", "), wide_cells AS (\n    SELECT issuer, q_start,").replace("SELECT * FROM wide\n", "SELECT * FROM wide_cells\n")


def _factors(p: str, keys: str, grid: str) -> str:
    """CTEs that bring a grid (keys, factor, input_id, family, weight, score) to factors with floors, under names that begin with ``p``."""
    got = lambda n: f"bool_or(input_id = '{n}' AND score IS NOT NULL)"
    return f"""{p}g AS ({grid}),
{p}h AS (SELECT {keys}, {got('revenue_q_yoy')} AND {got('operating_income_q_yoy')} AND NOT {got('gross_profit_q_yoy')} AS half FROM {p}g GROUP BY {keys}),
{p}w AS (SELECT g.*, CASE WHEN score IS NULL THEN 0 WHEN half AND input_id IN ('revenue_q_yoy', 'operating_income_q_yoy') THEN 0.5 ELSE weight END AS applied FROM {p}g g JOIN {p}h USING ({keys})),
{p}a AS (SELECT {keys}, factor, CAST(sum(applied * coalesce(score, 0)) AS DOUBLE) AS num, CAST(sum(applied) AS DOUBLE) AS applied, CAST(sum(CASE WHEN score IS NULL THEN 0 ELSE weight END) AS DOUBLE) AS original,
    {got('revenue_ttm_yoy')} AND {got('operating_income_ttm_yoy')} AND bool_or(family = 'CASH' AND score IS NOT NULL) AS one, {got('revenue_q_yoy')} AND {got('operating_income_q_yoy')} AS two, {got('operating_margin_yoy_pp')} AND {got('fcf_margin_yoy_pp')} AS three,
    count(DISTINCT family) FILTER (score IS NOT NULL AND family <> 'CROSS_FAMILY') >= 2 AS four FROM {p}w GROUP BY {keys}, factor),
{p}f AS (SELECT {keys}, factor, num / nullif(applied, 0) AS factor_score, original, applied,
    CASE factor WHEN 'F1_TTM' THEN one AND original >= 0.60 - 1e-9 WHEN 'F2_QUARTER' THEN two AND applied >= 0.90 - 1e-9 WHEN 'F3_QUALITY' THEN three AND original >= 0.50 - 1e-9 ELSE four AND original >= 0.40 - 1e-9 END AS floor FROM {p}a)"""


_ELIGIBLE = "(CASE WHEN growth <> 'INELIGIBLE' THEN 1 ELSE 0 END + CASE WHEN profit <> 'INELIGIBLE' THEN 1 ELSE 0 END + CASE WHEN cash <> 'INELIGIBLE' THEN 1 ELSE 0 END + CASE WHEN margin <> 'INELIGIBLE' THEN 1 ELSE 0 END)"
_GATES = f"""{_INPUTS}, {_factors('k', _K, f"SELECT i.{_K.replace(', ', ', i.')}, c.factor, c.input_id, c.family, c.weight, CASE WHEN f.value IS NOT NULL THEN 1.0 END AS score FROM classes i CROSS JOIN c LEFT JOIN fit f ON f.issuer = i.issuer AND f.q_end = i.q_end AND f.input_id = c.input_id AND f.age_days <= 180")},
gates AS (SELECT {_K}, factor, original AS coverage, coalesce(floor, false) AS ok FROM kf UNION ALL SELECT {_K}, 'F5_BREADTH', {_ELIGIBLE} / 6.0, {_ELIGIBLE} >= 3 FROM classes),
approved AS (SELECT {_K} FROM gates GROUP BY {_K} HAVING bool_and(ok))"""

_G = "PARTITION BY q_end, input_id, scenario"
_NORMAL = f"""{_GATES}, sc AS ({_values(policy.NORMALIZATION_SCENARIOS, 'scenario, min_peers, stale_days, excluded_days, winsor')}),
e AS (SELECT f.*, sc.* FROM fit f CROSS JOIN sc WHERE age_days <= excluded_days),
q AS (SELECT q_end, input_id, scenario, quantile_cont(value, 0.025) AS p1, quantile_cont(value, 0.975) AS p2, quantile_cont(value, 0.05) AS p3, quantile_cont(value, 0.95) AS p4 FROM e GROUP BY ALL),
v AS (SELECT e.*, CASE WHEN winsor IS NULL THEN value WHEN winsor = 0.025 THEN greatest(least(value, p2), p1) ELSE greatest(least(value, p4), p3) END AS sv, value < p1 OR value > p2 AS extreme FROM e JOIN q USING (q_end, input_id, scenario)),
rk AS (SELECT *, rank() OVER ({_G} ORDER BY sv) + (count(*) OVER ({_G}, sv) - 1) / 2.0 AS midrank, count(*) OVER ({_G}, sv) AS ties, count(*) OVER ({_G}) AS peer_count, quantile_cont(sv, 0.5) OVER ({_G}) AS center FROM v),
md AS (SELECT *, quantile_cont(abs(sv - center), 0.5) OVER ({_G}) AS mad FROM rk),
zs AS (SELECT *, CASE WHEN mad > 0 THEN greatest(least(0.6745 * (sv - center) / mad, 3.0), -3.0) END AS z FROM md),
n AS (SELECT zs.*, 100.0 * (CAST(midrank AS DOUBLE) - 0.5) / peer_count AS pct, 100 * {_phi('z')} AS rob, CASE WHEN p.ok IS NULL THEN 'COMPANY_COVERAGE_HOLD' WHEN peer_count < min_peers THEN 'PEER_GROUP_INSUFFICIENT' ELSE 'PASS' END AS st
    FROM zs LEFT JOIN (SELECT *, true AS ok FROM approved) p USING ({_K}))"""

_S = "scenario, q_end, issuer"
_FACTORS = f"""{_NORMAL}, ss AS ({_values(policy.SCORE_SCENARIOS, 'scenario, score_field, conflict')}),
shown AS (SELECT ss.scenario, n.q_end, n.issuer, n.input_id, CASE WHEN score_field = 'percentile' THEN pct ELSE rob END AS score FROM n CROSS JOIN ss WHERE n.scenario = 'BASELINE' AND st = 'PASS'),
{_factors('s', _S, "SELECT ss.scenario, i.q_end, i.issuer, c.factor, c.input_id, c.family, c.weight, x.score FROM classes i CROSS JOIN ss CROSS JOIN c LEFT JOIN shown x ON x.scenario = ss.scenario AND x.issuer = i.issuer AND x.q_end = i.q_end AND x.input_id = c.input_id")},
pts AS (SELECT ss.scenario, {_K}, unnest([growth, profit, cash, margin]) AS k, conflict FROM classes CROSS JOIN ss),
five AS (SELECT {_S}, count(w) AS nf, CASE WHEN count(w) >= 3 THEN 100 * sum(w) / count(w) END AS sc FROM (SELECT {_S}, CASE k WHEN 'SUPPORTIVE' THEN 1.0 WHEN 'NEUTRAL' THEN 0.5 WHEN 'ADVERSE' THEN 0.0 WHEN 'CONFLICTED' THEN conflict END AS w FROM pts) GROUP BY ALL),
both_f AS (SELECT {_S}, factor, factor_score, coalesce(floor, false) AS floor, original, applied FROM sf UNION ALL SELECT {_S}, 'F5_BREADTH', sc, nf >= 3, nf / 6.0, nf / 6.0 FROM five),
fs AS (SELECT b.* REPLACE (CASE WHEN floor AND p.ok THEN factor_score END AS factor_score), CASE WHEN p.ok IS NULL THEN 'COMPANY_COVERAGE_HOLD' WHEN NOT floor THEN 'FACTOR_FLOOR_FAILED' ELSE 'PASS' END AS status
    FROM both_f b LEFT JOIN (SELECT *, true AS ok FROM approved) p USING ({_K}))"""

_COMPOSITE = f"""{_FACTORS}, {_HISTORY}, hs AS (SELECT {_K}, concept, {_score("CASE WHEN concept = 'revenue' THEN 0.01 WHEN concept = 'operating_income' THEN 0.02 ELSE 0.03 END")} AS s FROM history WHERE q_yoy IS NOT NULL),
hw AS (SELECT {_K}, max(s) FILTER (concept = 'revenue') AS r, max(s) FILTER (concept = 'operating_income') AS o, max(s) FILTER (concept = 'cash_from_operations') AS cf, max(s) FILTER (concept = 'free_cash_flow') AS fc FROM (SELECT DISTINCT {_K} FROM obs) LEFT JOIN hs USING ({_K}) GROUP BY ALL),
ps AS ({_values(policy.PERSISTENCE_SCENARIOS, 'scenario, wr, wp, wc, cs, strict')}),
pa AS (SELECT ps.scenario, {_K}, r IS NOT NULL AND o IS NOT NULL AND (NOT strict OR (cf IS NOT NULL AND fc IS NOT NULL)) AS passed, wr + wp + CASE WHEN cf IS NULL THEN 0 ELSE wc * cs END + CASE WHEN fc IS NULL THEN 0 ELSE wc * (1 - cs) END AS used,
    wr * r + wp * o + coalesce(wc * cs * cf, 0) + coalesce(wc * (1 - cs) * fc, 0) AS points, wr + wp + wc AS total FROM hw CROSS JOIN ps),
pc AS (SELECT scenario, {_K}, passed, CASE WHEN passed THEN points / used END AS pscore, CASE WHEN passed THEN used / total ELSE 0 END AS pcover FROM pa),
b AS (SELECT {_K}, {', '.join(f"max(factor_score) FILTER (factor = '{f}') AS {f[:2]}" for f in policy.FACTOR_WEIGHTS)}, max(applied) FILTER (factor = 'F4_ACCELERATION') AS f4a,
    sum(CASE factor WHEN 'F1_TTM' THEN 0.35 * original WHEN 'F2_QUARTER' THEN 0.25 * applied WHEN 'F3_QUALITY' THEN 0.2 * original WHEN 'F5_BREADTH' THEN 0.05 * original ELSE 0 END) AS bc, count(*) FILTER (status = 'PASS' AND factor_score IS NOT NULL) = 5 AS allowed
    FROM fs WHERE scenario = 'BASELINE' GROUP BY ALL),
m1 AS (SELECT b.*, pc.scenario, passed, pscore, CASE WHEN allowed AND passed THEN 0.15 * pcover ELSE 0 END AS sleeve FROM b JOIN pc USING ({_K})),
m2 AS (SELECT *, f4a + sleeve AS f4c, CASE WHEN allowed AND passed THEN (F4 * f4a + pscore * sleeve) / (f4a + sleeve) END AS f4s, bc + 0.15 * (f4a + sleeve) AS tc FROM m1),
m3 AS (SELECT *, CASE WHEN allowed AND passed AND tc >= 0.70 - 1e-9 THEN 0.35 * F1 + 0.25 * F2 + 0.2 * F3 + 0.15 * f4s + 0.05 * F5 END AS composite FROM m2),
cm AS (SELECT *, CASE WHEN NOT allowed THEN 'EXISTING_COMPANY_HOLD' WHEN NOT passed THEN 'PERSISTENCE_HISTORY_INCOMPLETE' WHEN composite IS NULL THEN 'TOTAL_COVERAGE_BELOW_70_PERCENT' END AS hold,
    CASE WHEN composite IS NOT NULL THEN (0.35 * F1 + 0.25 * F2 + 0.2 * F3) / 0.8 END AS level, CASE WHEN composite IS NOT NULL THEN f4s END AS momentum FROM m3)"""

_in = lambda c, *x: "(" + " + ".join(f"CASE WHEN {y} = '{c}' THEN 1 ELSE 0 END" for y in x) + ")"
_back = lambda *pairs: "(" + " OR ".join(f"coalesce({n} - {a} < -{band} AND {a} > 0.01, false)" for n, a, band in pairs) + ")"
_FAM, _ACC = ("growth", "profit", "cash", "margin"), ("ag", "ap", "ac", "am")
_PILOT = f"""{_COMPOSITE}, pi AS ({_values(policy.PILOT_SCENARIOS, 'scenario, t, torn_mixes, pit, den')}),
excl AS (SELECT s_suppkey AS issuer FROM supplier WHERE s_acctbal < 0), exc AS (SELECT DISTINCT l_suppkey AS issuer, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS q_end FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50),
one AS (SELECT * FROM cm WHERE scenario = 'EQUAL_FAMILIES_40_60'),
ev AS (SELECT k.*, one.composite, one.level, one.momentum, one.tc, 80 + (issuer * 13 + month(q_end) * 7) % 120 AS age, issuer % 17 <> 0 AS sure, month(q_end) = 12 AND issuer % 3 = 0 AS q4 FROM classes k LEFT JOIN one USING ({_K})),
cf2 AS (SELECT ev.*, pi.*, CASE WHEN sure AND tc IS NOT NULL THEN 0.2 * 100 + 0.25 * (CASE WHEN q4 THEN 98 ELSE 100 END) + 0.15 * (CASE WHEN age > 120 THEN 85 ELSE 100 END) + 0.15 * least(100.0, 100.0 * tc / CAST(0.85 AS DOUBLE)) + 0.2 * pit + 0.05 * den END AS confidence FROM ev CROSS JOIN pi),
gt AS (SELECT cf2.*, CASE WHEN e.issuer IS NOT NULL THEN 8 WHEN x.issuer IS NOT NULL THEN 7 WHEN composite IS NULL THEN 1 WHEN NOT sure THEN 2 WHEN confidence IS NULL OR confidence < 70 THEN 3 WHEN age > 180 THEN 4 WHEN age > 120 THEN 5 ELSE 6 END AS g
    FROM cf2 LEFT JOIN excl x USING (issuer) LEFT JOIN exc e ON e.issuer = cf2.issuer AND e.q_end = cf2.q_end),
ac0 AS (SELECT *, g IN (5, 6) AS published, {_rec(_dir('revenue_q_yoy_acceleration', 0.01), _dir('revenue_ttm_yoy_acceleration', 0.01))} AS ag, {_rec(_dir('operating_income_q_yoy_acceleration', 0.01), _dir('operating_income_ttm_yoy_acceleration', 0.01))} AS ap,
    {_rec(_dir('cfo_ttm_yoy_acceleration', 0.01), _dir('fcf_ttm_yoy_acceleration', 0.01))} AS ac, {_dir('operating_margin_acceleration_pp', 0.01)} AS am,
    coalesce((revenue_q_yoy > 0.01 AND revenue_ttm_yoy < -0.01) OR (revenue_q_yoy < -0.01 AND revenue_ttm_yoy > 0.01), false) OR coalesce((operating_income_q_yoy > 0.02 AND operating_income_ttm_yoy < -0.02) OR (operating_income_q_yoy < -0.02 AND operating_income_ttm_yoy > 0.02), false) AS opposing FROM gt),
ct AS (SELECT *, {_in('SUPPORTIVE', *_FAM)} AS up, {_in('ADVERSE', *_FAM)} AS down, {_in('NEUTRAL', *_FAM)} AS flat, {_in('CONFLICTED', *_FAM)} AS torn, 4 - {_in('INELIGIBLE', *_FAM)} AS k, {_in('SUPPORTIVE', *_ACC)} - {_in('ADVERSE', *_ACC)} AS lean, {_in('ADVERSE', *_ACC)} AS adown, 4 - {_in('INELIGIBLE', *_ACC)} AS ak,
    CASE WHEN ag = 'SUPPORTIVE' AND {_back(('revenue_ttm_yoy', 'revenue_ttm_yoy_acceleration', 0.01))} THEN 1 ELSE 0 END + CASE WHEN ap = 'SUPPORTIVE' AND {_back(('operating_income_ttm_yoy', 'operating_income_ttm_yoy_acceleration', 0.02))} THEN 1 ELSE 0 END
    + CASE WHEN ac = 'SUPPORTIVE' AND {_back(('cfo_ttm_yoy', 'cfo_ttm_yoy_acceleration', 0.03), ('fcf_ttm_yoy', 'fcf_ttm_yoy_acceleration', 0.03))} THEN 1 ELSE 0 END + CASE WHEN am = 'SUPPORTIVE' AND {_back(('operating_margin_yoy_pp', 'operating_margin_acceleration_pp', 0.0025))} THEN 1 ELSE 0 END AS back FROM ac0),
ix AS (SELECT *, (up - down) / CAST(nullif(k, 0) AS DOUBLE) AS adi, lean / CAST(nullif(ak, 0) AS DOUBLE) AS adx FROM ct),
st AS (SELECT *, CASE WHEN NOT published OR level IS NULL OR momentum IS NULL THEN 'DATA_OR_METHODOLOGY_GATE'
    WHEN (up >= 2 AND down + torn >= 2) OR opposing OR coalesce((adi >= t AND level < 47.5) OR (adi <= -t AND level >= 52.5), false) OR coalesce((adx >= t AND momentum < 47.5) OR (adx <= -t AND momentum >= 52.5), false) OR (torn > 0 AND torn_mixes) THEN 'MATERIAL_CONFLICT_PRECEDENCE'
    WHEN level < 42.5 AND momentum < 47.5 AND down >= 3 AND down - up >= 2 THEN 'DETERIORATING' WHEN (level >= 47.5 OR coalesce(adi >= t, false)) AND (momentum < 42.5 OR adown >= 2) THEN 'DECELERATING'
    WHEN level >= 55 AND momentum >= 60 AND up >= 3 AND up - down >= 2 AND torn = 0 AND coalesce(adi > -t, false) THEN 'ACCELERATING' WHEN level >= 52.5 AND (momentum >= 47.5 OR coalesce(adi >= t, false)) THEN 'IMPROVING_POSITIVE'
    WHEN level >= 35 AND level < 52.5 AND momentum >= 60 AND back >= 2 AND coalesce(adx > 0, false) THEN 'IMPROVING_RECOVERY'
    WHEN level BETWEEN 45 AND 55 AND momentum BETWEEN 42.5 AND 57.5 AND k > 0 AND flat >= 0.5 * k AND torn = 0 THEN 'STABLE' ELSE 'NO_DIRECTIONAL_RULE_MATCH_REVIEW' END AS reason FROM ix),
pilot AS (SELECT scenario, {_K}, CASE WHEN published THEN composite END AS score, confidence, published, ['INSUFFICIENT_HISTORY', 'REVIEW_REQUIRED', 'REVIEW_REQUIRED', 'STALE', 'STALE', 'PARTIAL', 'EXCLUDED_PEER_GROUP', 'REVIEW_REQUIRED'][g] AS data_status,
    ['EXISTING_CANDIDATE_COVERAGE_OR_HISTORY_HOLD', 'FILING_VINTAGE_VALIDATION_FAILED', 'CONFIDENCE_BELOW_RESEARCH_FLOOR', 'PRIMARY_EVIDENCE_TOO_OLD_OR_AGE_UNKNOWN', 'OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING', 'OPTIONAL_WORKFORCE_AND_CONDITIONAL_SLEEVES_MISSING', 'NEGATIVE_BALANCE', 'LARGE_RETURN'][g] AS gate_reason,
    CASE reason WHEN 'DATA_OR_METHODOLOGY_GATE' THEN 'UNSCORED' WHEN 'MATERIAL_CONFLICT_PRECEDENCE' THEN 'MIXED' WHEN 'NO_DIRECTIONAL_RULE_MATCH_REVIEW' THEN 'MIXED' WHEN 'IMPROVING_POSITIVE' THEN 'IMPROVING' WHEN 'IMPROVING_RECOVERY' THEN 'IMPROVING' ELSE reason END AS status, reason AS status_reason, level, momentum FROM st)"""

_R = "DECIMAL(18,6)"
ORACLE_SQL: dict[str, str] = {
    "family_classes": f"{_INPUTS} SELECT {_K}, growth, profit, cash, margin, 'INELIGIBLE' AS productivity, 'INELIGIBLE' AS capital FROM classes",
    "company_gates": f"{_GATES} SELECT {_K}, factor, {_d('CAST(coverage AS DOUBLE)', 'coverage')}, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS gate FROM gates",
    "factor_coverage_counts": f"""{_GATES}, k AS (SELECT q_end, factor, count(*) FILTER (ok) AS companies FROM gates GROUP BY ALL) SELECT q_end, factor, companies, CASE WHEN companies >= 50 THEN 'PASS' ELSE 'PEER_GROUP_INSUFFICIENT' END AS coverage FROM k""",
    "metric_normalization": f"""{_NORMAL} SELECT scenario, {_K}, input_id, {_d('value')}, {_d('sv', 'sensitivity_value')}, ties, peer_count, CAST(min_peers AS INTEGER) AS min_peers, {_d("CASE WHEN st = 'PASS' THEN midrank END", 'midrank')}, {_d("CASE WHEN st = 'PASS' THEN pct END", 'percentile')},
        CAST(CASE WHEN st = 'PASS' THEN rob END AS {_R}) AS robust, extreme AS peer_extreme, CASE WHEN age_days > stale_days THEN 'STALE' ELSE 'CURRENT' END AS age_class, st AS normalization_status FROM n""",
    "normalization_distributions": f"""{_NORMAL} SELECT scenario, q_end, input_id, count(*) AS peers, count(DISTINCT sv) AS distinct_values, sum(CASE WHEN ties > 1 THEN 1 ELSE 0 END)::BIGINT AS tied, sum(CASE WHEN age_days > stale_days THEN 1 ELSE 0 END)::BIGINT AS stale_peers,
        CASE WHEN count(*) >= min(min_peers) THEN 'PASS' ELSE 'PEER_GROUP_INSUFFICIENT' END AS coverage FROM n GROUP BY scenario, q_end, input_id""",
    "normalization_sensitivity": f"""{_NORMAL}, sh AS (SELECT {_K}, input_id, scenario, unnest([{{'method': 'percentile', 'score': round(pct, 6)}}, {{'method': 'robust', 'score': round(rob, 6)}}], recursive := true) FROM n WHERE st = 'PASS'),
        pr AS (SELECT s.q_end, s.scenario, s.input_id, s.method, s.score, round(b.pct, 6) AS reference FROM sh s JOIN n b ON b.issuer = s.issuer AND b.q_end = s.q_end AND b.input_id = s.input_id AND b.scenario = 'BASELINE' AND b.st = 'PASS' WHERE s.score IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY q_end, scenario, input_id, method ORDER BY score) + (count(*) OVER (PARTITION BY q_end, scenario, input_id, method, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY q_end, scenario, input_id, method ORDER BY reference) + (count(*) OVER (PARTITION BY q_end, scenario, input_id, method, reference) - 1) / 2.0 AS y FROM pr),
        ag AS (SELECT q_end, scenario, input_id, method, count(*) AS n, CAST(CASE WHEN count(*) > 1 AND NOT isnan(corr(x, y)) THEN corr(x, y) END AS {_R}) AS rho, CAST(avg(abs(score - reference)) + 1e-9 AS DECIMAL(18,4)) AS mean_change, CAST(max(abs(score - reference)) AS DECIMAL(18,6)) AS max_change, count(*) FILTER (abs(reference - score) > 10) AS over_10 FROM r GROUP BY ALL),
        cell AS (SELECT DISTINCT q_end, scenario, input_id, method FROM n, (VALUES ('percentile'), ('robust')) k(method))
        SELECT c.q_end, c.scenario, c.input_id, c.method, coalesce(n, 0) AS n, rho, mean_change, max_change, coalesce(over_10, 0) AS over_10 FROM cell c LEFT JOIN ag a ON a.q_end = c.q_end AND a.scenario = c.scenario AND a.input_id = c.input_id AND a.method = c.method""",
    "method_difference_review": f"""{_NORMAL}, d AS (SELECT {_K}, input_id, CAST(round(abs(pct - rob), 6) AS {_R}) AS difference FROM n WHERE scenario = 'BASELINE' AND st = 'PASS' AND rob IS NOT NULL)
        SELECT {_K}, input_id, difference, row_number() OVER (PARTITION BY q_end ORDER BY difference DESC, issuer, input_id) AS place FROM d QUALIFY place <= 20""",
    "factor_scores_scenarios": f"""{_FACTORS} SELECT {_S}, factor, {_d('factor_score')}, CASE WHEN floor THEN 'PASS' ELSE 'FAIL' END AS floor, status AS score_status, {_d('CAST(original AS DOUBLE)', 'original_coverage')}, {_d('CAST(applied AS DOUBLE)', 'applied_coverage')} FROM fs""",
    "composite_scores": f"""{_COMPOSITE} SELECT {_S}, {_d('f4s', 'f4_score')}, {_d('CAST(f4c AS DOUBLE)', 'f4_coverage')}, {_d('CAST(tc AS DOUBLE)', 'total_coverage')}, {_d('composite')}, hold AS hold_reason, {_d('level')}, {_d('momentum')} FROM cm""",
    "research_pilot": f"""{_PILOT} SELECT scenario, {_K}, {_d('score')}, {_d('confidence')}, published, data_status, gate_reason, status, status_reason FROM pilot""",
    "composite_status": f"{_PILOT} SELECT scenario, {_K}, CAST(level AS {_R}) AS level, CAST(momentum AS {_R}) AS momentum, status, status_reason FROM pilot",
    "persistence_candidates": f"{_COMPOSITE} SELECT scenario, {_K}, passed, {_d('CAST(pscore AS DOUBLE)', 'persistence_score')}, {_d('CAST(pcover AS DOUBLE)', 'persistence_coverage')} FROM pc",
    "weighted_factor_scores": f"""{_INPUTS}, ranked AS (SELECT {_K}, input_id, 100.0 * (CAST(rank() OVER (PARTITION BY q_end, input_id ORDER BY value) + (count(*) OVER (PARTITION BY q_end, input_id, value) - 1) / 2.0 AS DOUBLE) - 0.5) / count(*) OVER (PARTITION BY q_end, input_id) AS score FROM fit),
        {_factors('u', _K, "SELECT i.q_end, i.issuer, c.factor, c.input_id, c.family, c.weight, r.score FROM (SELECT DISTINCT q_end, issuer FROM ranked) i CROSS JOIN c LEFT JOIN ranked r ON r.issuer = i.issuer AND r.q_end = i.q_end AND r.input_id = c.input_id")},
        names AS (SELECT {_K}, factor, coalesce(array_to_string(list_sort(list_distinct(list(family) FILTER (score IS NOT NULL))), '|'), '') AS families FROM ug GROUP BY ALL)
        SELECT {_K}, factor, {_d('factor_score')}, {_d('original', 'original_coverage')}, {_d('applied', 'applied_coverage')}, families FROM uf JOIN names USING ({_K}, factor)""",
    "pilot_sensitivity": f"""{_PILOT} SELECT p.q_end, p.scenario, count(*) FILTER (p.published) AS published, count(*) FILTER (p.status <> b.status) AS status_changes, {_d('max(abs(p.confidence - b.confidence))', 'max_confidence_change')}
        FROM pilot p JOIN pilot b ON b.issuer = p.issuer AND b.q_end = p.q_end AND b.scenario = 'BASELINE' GROUP BY ALL""",
    "robust_cdf_score": f"""{_INPUTS}, g AS (SELECT q_end, issuer, concept || '_ttm_yoy' AS input_id, CAST({_digits('ttm_yoy', 3)} AS DOUBLE) AS value FROM obs WHERE ttm_yoy IS NOT NULL AND concept <> 'free_cash_flow'),
        a AS (SELECT *, count(*) OVER (PARTITION BY q_end, input_id) AS k, quantile_cont(value, 0.5) OVER (PARTITION BY q_end, input_id) AS center FROM g), m2 AS (SELECT *, quantile_cont(abs(value - center), 0.5) OVER (PARTITION BY q_end, input_id) AS mad FROM a),
        z2 AS (SELECT *, CASE WHEN mad > 0 AND k >= 50 THEN greatest(least(0.6745 * (value - center) / mad, 3.0), -3.0) END AS z FROM m2) SELECT q_end, issuer, input_id, {_digits(f"100 * {_phi('z')}", 6)} AS score FROM z2""",
}
