"""Registered queries of histories: as-of joins, intervals, keyed streams, lineage, balances and metric modules, with their DuckDB SQL side by side."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.functions import scalars as S
from vintara.operators import asof, balances, closure, intervals, productivity, scoring, timeseries
from vintara.oracle import _FILINGS, _PANEL, _d, _dir, _rec
from vintara.plans import bridge, modules, policy, stages
from vintara.plans.bridge import table
from vintara.plans.settle import settle, shared_folder
from vintara.stage_oracle import _INPUTS
from vintara.stage_queries import Method, dec
from vintara.streaming import intake, vintages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query(f"""WITH {_FILINGS}, f AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY issuer, available ORDER BY accepted DESC, accession DESC) = 1),
    e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) - INTERVAL 24 YEAR AS moment FROM events)
    SELECT event_id, CASE WHEN fresh THEN accession END AS accession, CASE WHEN fresh THEN form END AS form, CASE WHEN fresh THEN CAST(CAST(moment AS DATE) - available AS INTEGER) END AS age_days
    FROM (SELECT e.*, f.accession, f.form, f.available, moment <= f.available + INTERVAL 400 DAY AS fresh FROM e ASOF LEFT JOIN f ON e.user_id = f.issuer AND e.moment >= f.available)""")
def events_asof_filings(spark, sf_dir):
    """Every event with the latest filing of its user known then, if that is at most 400 days old; events are read as of 24 years earlier, when the filings are."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("issuer"), (F.col("ts").cast("timestamp") - F.make_interval(years=F.lit(24))).alias("at"))
    filings = bridge.filings(spark, sf_dir)
    met = asof.merge_asof(events, filings, ("issuer",), "at", "available", ("accession", "form", "available"), order=("accepted", "accession"), max_age=400)
    return met.select("event_id", "accession", "form", F.date_diff(F.to_date("at"), "available").alias("age_days"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate FROM lineitem),
    r AS (SELECT l_suppkey, l_shipdate, l_orderkey AS returned_order, l_linenumber AS returned_line FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.returned_order, r.returned_line, CAST(CAST(l.l_shipdate AS DATE) - CAST(r.l_shipdate AS DATE) AS INTEGER) AS days_since FROM l ASOF LEFT JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_shipdate > r.l_shipdate""")
def lines_asof_returns(spark, sf_dir):
    """Every line with the last return that its supplier had shipped before it: both sides are fact tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("at"), "l_returnflag")
    returns = lines.where("l_returnflag = 'R'").select("l_suppkey", F.col("at").alias("returned_at"), F.col("l_orderkey").alias("returned_order"), F.col("l_linenumber").alias("returned_line"))
    met = asof.merge_asof(lines.drop("l_returnflag"), returns, ("l_suppkey",), "at", "returned_at", ("returned_at", "returned_order", "returned_line"), order=("returned_order", "returned_line"), strict=True, span_days=90)
    return met.select("l_orderkey", "l_linenumber", "l_partkey", "returned_order", "returned_line", F.date_diff("at", "returned_at").alias("days_since"))


_HISTORY = """WITH daily AS (SELECT o_custkey AS issuer, CAST(o_orderdate AS DATE) AS day, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL),
    seen AS (SELECT *, lag(status) OVER w IS DISTINCT FROM status AS s, lag(priority) OVER w IS DISTINCT FROM priority AS p FROM daily WINDOW w AS (PARTITION BY issuer ORDER BY day)),
    a AS (SELECT issuer, status, day AS f, lead(day) OVER (PARTITION BY issuer ORDER BY day) AS t FROM seen WHERE s), b AS (SELECT issuer, priority, day AS f, lead(day) OVER (PARTITION BY issuer ORDER BY day) AS t FROM seen WHERE p)"""


def _histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("at"), "o_orderkey")
    return tuple(intervals.from_changes(orders, ("issuer",), "at", (c,), ("o_orderkey",)) for c in ("status", "priority"))


@query(f"""{_HISTORY} SELECT issuer, 'status' AS what, status AS state, f AS valid_from, t AS valid_to FROM a UNION ALL SELECT issuer, 'priority', priority, f, t FROM b""")
def validity_from_changes(spark, sf_dir):
    """How long each customer's order status and priority held, from the orders that tell them."""
    status, priority = _histories(spark, sf_dir)
    parts = [h.select("issuer", F.lit(c).alias("what"), F.col(c).alias("state"), "valid_from", "valid_to") for h, c in ((status, "status"), (priority, "priority"))]
    return parts[0].unionByName(parts[1])


@query(f"""{_HISTORY}, m AS (SELECT max(greatest(f, coalesce(t, f))) + 1 AS far FROM (SELECT f, t FROM a UNION ALL SELECT f, t FROM b))
    SELECT issuer, status, priority, greatest(a.f, b.f) AS valid_from, CASE WHEN a.t IS NOT NULL OR b.t IS NOT NULL THEN least(coalesce(a.t, b.t), coalesce(b.t, a.t)) END AS valid_to,
        CAST(least(coalesce(a.t, CAST(far AS DATE)), coalesce(b.t, CAST(far AS DATE))) - greatest(a.f, b.f) AS INTEGER) AS shared_days
    FROM a JOIN b USING (issuer), m WHERE a.f < coalesce(b.t, DATE '9999-12-31') AND b.f < coalesce(a.t, DATE '9999-12-31')""")
def overlap_of_histories(spark, sf_dir):
    """When a customer's status and priority held together: two histories joined where their intervals overlap."""
    status, priority = _histories(spark, sf_dir)
    return intervals.overlap_join(status, priority, ("issuer",), days=365)


@query("""WITH l AS (SELECT l_suppkey AS issuer, l_partkey % 20 AS shelf, CAST(l_shipdate AS DATE) AS f, CAST(l_shipdate AS DATE) + 3 + CAST(l_quantity AS INTEGER) AS t FROM lineitem),
    d AS (SELECT issuer, shelf, f, t, count(*) AS n FROM l GROUP BY ALL),
    m AS (SELECT *, f > max(t) OVER w AS fresh, coalesce(f < max(t) OVER w, false) AS o FROM d WINDOW w AS (PARTITION BY issuer, shelf ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(CASE WHEN fresh OR fresh IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY issuer, shelf ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT issuer, shelf, min(f) AS valid_from, max(t) AS valid_to, CAST(sum(n) AS BIGINT) AS parts, CAST(sum(n - 1 + o::INTEGER) AS BIGINT) AS overlapping FROM i GROUP BY issuer, shelf, island""")
def merged_spans(spark, sf_dir):
    """Days on which a supplier's shelf was in use, from spans that overlap or touch, and how many spans of each began inside another."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), (F.col("l_partkey") % 20).alias("shelf"), F.to_date("l_shipdate").alias("valid_from"), F.date_add(F.to_date("l_shipdate"), 3 + F.col("l_quantity").cast("int")).alias("valid_to"))
    keys = ("issuer", "shelf")
    merged = intervals.merge_intervals(lines, keys)
    inside = intervals.conflicts(lines, keys).where("overlaps").select(*keys, F.col("valid_from").alias("day"))
    # a span that overlaps an earlier one lies in the merged span that is the latest to begin by its first day
    counts = asof.merge_asof(inside, merged.withColumn("start", F.col("valid_from")), keys, "day", "valid_from", ("start",), span_days=365).groupBy(*keys, F.col("start").alias("valid_from")).agg(F.count(F.lit(1)).alias("overlapping"))
    return merged.join(counts, [*keys, "valid_from"], "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0)).cast("long"))


def _in_waves(frame: DataFrame, path: str, bounds: list, column: str, waves: range) -> None:
    """Write the slices of ``frame`` between successive ``bounds`` one after the other, as they would arrive."""
    for k in waves:
        low, high = bounds[k], bounds[k + 1]
        frame.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))).write.mode("append").parquet(path)


@query(f"""WITH {_FILINGS}, k AS (SELECT issuer, report_period, accession, row_number() OVER (PARTITION BY issuer, report_period ORDER BY available DESC, accepted DESC, accession DESC) AS n, max(available) OVER (PARTITION BY issuer, report_period) AS known FROM filings),
    w AS (SELECT max(available) - 400 AS mark FROM filings)
    SELECT issuer, report_period, accession, CASE WHEN n > 1 THEN 'SUPERSEDED' WHEN known + 120 <= mark THEN 'FINAL' ELSE 'CURRENT' END AS standing FROM k, w""")
def stream_vintages(spark, sf_dir):
    """What became of every filing, from a stream that is stopped half way and started again; periods are closed 120 days after their last vintage."""
    root = scratch(spark)
    filings = bridge.filings(spark, sf_dir)
    years = [f"{y}-01-01" for y in range(*(f + k for f, k in zip(filings.agg(F.min(F.year("available")), F.max(F.year("available"))).first(), (0, 2), strict=True)))]
    half = len(years) // 2
    _in_waves(filings, f"{root}/arrivals", years, "available", range(half))
    for waves in (range(0), range(half, len(years) - 1)):
        _in_waves(filings, f"{root}/arrivals", years, "available", waves)
        stream = spark.readStream.schema(filings.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/arrivals")
        vintages.follow_vintages(stream, f"{root}/told", f"{root}/checkpoint", delay="400 days", close_after=120)
    return vintages.standing(spark, f"{root}/told")


class _Interrupted(Exception):
    """A fault put into one batch on purpose."""


@query("""SELECT md5(coalesce(text, '')) AS digest, 1::BIGINT AS stored, CAST(max(length(coalesce(text, ''))) AS INTEGER) AS n_chars FROM documents GROUP BY 1""")
def stream_intake(spark, sf_dir):
    """Documents stored once a content, though copies arrive in several batches, a wave comes twice, and a batch fails after it has stored its rows."""
    root = scratch(spark)
    docs = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), "doc_id")
    third = (docs.agg(F.max("doc_id")).first()[0] or 0) // 3 + 1
    _in_waves(docs, f"{root}/arrivals", [0, third, 2 * third, 3 * third], "doc_id", range(3))
    _in_waves(docs, f"{root}/arrivals", [0, third], "doc_id", range(1))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/arrivals")
    failed = []

    def fault(step: str, number: int) -> None:
        if (step, number) == ("after", 1) and not failed:
            failed.append(number)
            raise _Interrupted

    try:
        intake.take_in(stream, "digest", f"{root}/store", hook=fault)
    except Exception:
        if not failed:
            raise
    intake.take_in(stream, "digest", f"{root}/store", hook=fault)
    return intake.documents(spark, f"{root}/store").groupBy("digest").agg(F.count(F.lit(1)).alias("stored"), F.max("n_chars").alias("n_chars"))


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (child, parent): a yearly signal rests on two observations, an observation on four quarters, a quarter on the filings that its lines cite."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.trunc("l_shipdate", "quarter").alias("q"), F.col("l_orderkey"))
    name = lambda kind, day: F.concat_ws("|", F.lit(kind), F.col("issuer"), day)
    quarters = settle(cited.select("issuer", "q").distinct())
    observed = quarters.select("issuer", "q", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("issuer", "q", F.add_months("q", 3 * F.col("k")).alias("t"))
    signals = observed.select("issuer", "t").distinct().select("issuer", "t", F.explode(F.array(F.lit(0), F.lit(12))).alias("k")).select("issuer", "t", F.add_months("t", F.col("k")).alias("g"))
    return (
        signals.select(name("signal", F.col("g")).alias("child"), name("observation", F.col("t")).alias("parent"))
        .unionByName(observed.select(name("observation", F.col("t")).alias("child"), name("quarter", F.col("q")).alias("parent")))
        .unionByName(cited.select(name("quarter", F.col("q")).alias("child"), F.concat_ws("|", F.lit("filing"), "l_orderkey").alias("parent")))
    )


def _part(node: str, k: int):
    return F.split_part(node, F.lit("|"), F.lit(k))


_CITED = "cited AS (SELECT DISTINCT l_suppkey AS issuer, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, l_orderkey FROM lineitem)"


@query(f"""WITH {_FILINGS}, {_CITED}, qd AS (SELECT cited.issuer, q, max(available) AS d, bool_or(accession IS NULL) AS lacks FROM cited LEFT JOIN filings ON accession = l_orderkey GROUP BY ALL),
    o AS (SELECT issuer, CAST(q + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS t, max(d) AS d, bool_or(lacks) AS lacks FROM qd, range(4) r(k) GROUP BY ALL), g AS (SELECT issuer, CAST(t + to_months(CAST(12 * k AS INTEGER)) AS DATE) AS quarter, max(d) AS d, bool_or(lacks) AS lacks FROM o, range(2) r(k) GROUP BY ALL)
    SELECT issuer, quarter, CASE WHEN NOT lacks THEN d END AS available, CASE WHEN lacks THEN 'MISSING_PARENT' ELSE 'RESOLVED' END AS status, 3 AS height FROM g""")
def lineage_knowable(spark, sf_dir):
    """When everything that a yearly signal rests on was known, through observations, quarters and filings."""
    known = bridge.filings(spark, sf_dir).select(F.concat_ws("|", F.lit("filing"), "accession").alias("node"), "available")
    told = closure.resolve(_lineage(spark, sf_dir), known).where(_part("node", 1) == "signal")
    return told.select(_part("node", 2).cast("long").alias("issuer"), _part("node", 3).cast("date").alias("quarter"), "available", "status", "height")


@query(f"""WITH {_CITED}, o AS (SELECT DISTINCT issuer, CAST(q + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS t, q FROM cited, range(4) r(k)),
    g AS (SELECT DISTINCT issuer, CAST(t + to_months(CAST(12 * k AS INTEGER)) AS DATE) AS quarter, t FROM o, range(2) r(k)), gq AS (SELECT DISTINCT issuer, quarter, q FROM g JOIN o USING (issuer, t))
    SELECT issuer, quarter, (SELECT count(*) FROM g x WHERE x.issuer = a.issuer AND x.quarter = a.quarter) AS observations, quarters, filings, 3 AS deepest
    FROM (SELECT issuer, quarter, count(DISTINCT q) AS quarters, count(DISTINCT l_orderkey) AS filings FROM gq JOIN cited USING (issuer, q) GROUP BY ALL) a""")
def lineage_closure(spark, sf_dir):
    """How many observations, quarters and filings every yearly signal rests on, from its closure."""
    edges = _lineage(spark, sf_dir)
    found = closure.close_over(edges, edges.where(F.col("child").startswith("signal|")).select(F.col("child").alias("root")))
    count = lambda kind, name: F.count_if(F.col("node").startswith(f"{kind}|")).alias(name)
    counted = found.groupBy("root").agg(count("observation", "observations"), count("quarter", "quarters"), count("filing", "filings"), F.max("depth").alias("deepest"))
    return counted.select(_part("root", 2).cast("long").alias("issuer"), _part("root", 3).cast("date").alias("quarter"), "observations", "quarters", "filings", "deepest")


def _open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open of each supplier's lines: added on the earlier of a line's order and shipping day, taken away on the later."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("issuer"), F.to_date("l_shipdate").alias("shipped"), bridge.hundredths("l_extendedprice", 12).alias("amount"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ordered"))
    spells = lines.join(orders, "l_orderkey").select("issuer", F.least("ordered", "shipped").alias("since"), F.greatest("ordered", "shipped").alias("until"), "amount")
    return balances.averaged(balances.spell_balances(spells, ("issuer",)), ("issuer",))


def _flows(rows: DataFrame) -> DataFrame:
    """issuer, q_end and the trailing revenue and operating income, where both are whole."""
    told = ("revenue", "operating_income")
    return rows.where(" and ".join(f"ttm_{c} is not null" for c in told)).select("issuer", "q_end", *[F.col(f"ttm_{c}").alias(c) for c in told])


def _trailing_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(timeseries.trailing_of_rows(bridge.quarter_rows(spark, sf_dir), ("revenue", "operating_income")))


_OPEN = """l AS (SELECT l_suppkey AS issuer, CAST(o_orderdate AS DATE) AS o, CAST(l_shipdate AS DATE) AS s, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    delta AS (SELECT issuer, least(o, s) AS day, p AS amount FROM l UNION ALL SELECT issuer, greatest(o, s), -p FROM l),
    dq AS (SELECT issuer, last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) AS q_end, sum(amount) AS change, coalesce(sum(amount) FILTER (amount > 0), 0) AS opened, coalesce(-sum(amount) FILTER (amount < 0), 0) AS closed FROM delta GROUP BY ALL),
    grid AS (SELECT issuer, last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS q_end FROM (SELECT issuer, unnest(generate_series(date_trunc('quarter', min(q_end)), (SELECT max(q_end) FROM dq), INTERVAL 3 MONTH)) AS q FROM dq GROUP BY issuer)),
    held AS (SELECT issuer, q_end, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed, sum(coalesce(change, 0)) OVER (PARTITION BY issuer ORDER BY q_end) AS balance FROM grid LEFT JOIN dq USING (issuer, q_end)),
    mean AS (SELECT *, CASE WHEN lag(q_end, 4) OVER v IS NOT NULL THEN sum(CAST(balance AS DOUBLE)) OVER (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 END AS average, lag(balance, 4) OVER v AS beginning FROM held WINDOW v AS (PARTITION BY issuer ORDER BY q_end))"""
_FLOWS = "flows AS (SELECT issuer, q_end, max(ttm) FILTER (concept = 'revenue') AS revenue, max(ttm) FILTER (concept = 'operating_income') AS profit FROM obs GROUP BY ALL HAVING revenue IS NOT NULL AND profit IS NOT NULL)"
_TURNOVER = """base AS (SELECT m.issuer, m.q_end, balance, average, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit FROM mean m JOIN flows USING (issuer, q_end)),
    turn AS (SELECT a.issuer, a.q_end, a.balance, a.average, a.revenue / nullif(a.average, 0) AS turnover, a.revenue / nullif(a.average, 0) - b.revenue / nullif(b.average, 0) AS turnover_change, a.profit / nullif(a.average, 0) AS return_on_average,
        (a.profit - b.profit) / nullif(a.average - b.average, 0) AS incremental_return FROM base a LEFT JOIN base b ON b.issuer = a.issuer AND a.q_end = last_day(b.q_end + INTERVAL 12 MONTH))"""


@query(f"""{_PANEL}, {_OPEN}, {_FLOWS}, {_TURNOVER} SELECT issuer, q_end, CAST(balance AS DECIMAL(28,2)) AS balance, CAST(average AS DECIMAL(28,4)) AS average, {_d('turnover')}, {_d('turnover_change')}, {_d('return_on_average')}, {_d('round(incremental_return, 6)', 'incremental_return')} FROM turn""")
def capital_turnover(spark, sf_dir):
    """Trailing sales over the average of what was open at five quarter ends, the return on it, and the return on what was added in a year."""
    flows = _trailing_wide(spark, sf_dir).withColumnRenamed("operating_income", "profit")
    out = balances.returns_on(_open_lines(spark, sf_dir), flows, ("issuer",))
    return out.select("issuer", "q_end", "balance", dec("average", kind="decimal(28,4)"), dec("turnover"), dec("turnover_change"), dec("return_on_average"), dec(F.round("incremental_return", 6), "incremental_return"))


_HEADS = f"""{_FLOWS}, told AS (SELECT l_suppkey AS issuer, CAST(l_shipdate AS DATE) AS counted_on, max(CAST(l_quantity * 10 AS INTEGER)) AS heads FROM lineitem WHERE round(l_discount, 2) = 0.1 AND round(l_tax, 2) = 0.08 GROUP BY ALL),
    met AS (SELECT f.*, counted_on, heads AS h, CAST(f.q_end - counted_on AS INTEGER) AS head_age FROM flows f ASOF LEFT JOIN told t ON f.issuer = t.issuer AND f.q_end >= t.counted_on),
    weighed AS (SELECT *, coalesce(CASE WHEN head_age <= 120 THEN 1.0 WHEN head_age <= 240 THEN 0.75 WHEN head_age <= 365 THEN 0.5 ELSE 0 END * CASE WHEN h % 50 = 0 THEN 0.8 ELSE 1 END, 0)::DOUBLE AS head_weight FROM met),
    headed AS (SELECT issuer, q_end, CAST(revenue AS DOUBLE) AS r, CAST(profit AS DOUBLE) AS o, head_age, head_weight, CASE WHEN head_weight > 0 THEN h END AS heads FROM weighed),
    perhead AS (SELECT a.*, a.r / a.heads AS revenue_per_head, a.o / a.heads AS operating_income_per_head, CASE WHEN b.r > 0 THEN (a.r / a.heads) / (b.r / b.heads) - 1 END AS r_yoy, CASE WHEN b.o > 0 THEN (a.o / a.heads) / (b.o / b.heads) - 1 END AS o_yoy,
        a.heads::DOUBLE / b.heads - 1 AS heads_yoy, CASE WHEN b.r > 0 THEN a.r / b.r - 1 END - (a.heads::DOUBLE / b.heads - 1) AS growth_spread FROM headed a LEFT JOIN (SELECT issuer, lead(q_end, 4) OVER (PARTITION BY issuer ORDER BY q_end) AS q_next, q_end AS q_was, r, o, heads FROM headed) b ON a.issuer = b.issuer AND a.q_end = b.q_next AND a.q_end = last_day(b.q_was + INTERVAL 12 MONTH))"""


def _per_head(spark: SparkSession, sf_dir: str, flows: DataFrame) -> DataFrame:
    """Suppliers' figures per head; a line with the highest discount and tax discloses a head count, which is approximate where it is a multiple of fifty."""
    lines = table(spark, sf_dir, "lineitem").where((F.round("l_discount", 2) == 0.1) & (F.round("l_tax", 2) == 0.08))
    heads = (F.col("l_quantity") * 10).cast("int")
    told = lines.select(F.col("l_suppkey").alias("issuer"), F.to_date("l_shipdate").alias("counted_on"), heads.alias("heads"), (heads % 50 == 0).alias("approximate"))
    return productivity.per_head(productivity.carried_counts(flows, told))


@query(f"""{_PANEL}, {_HEADS} SELECT issuer, q_end, heads, head_age, CASE WHEN head_weight = 0 THEN 'NO_EMPLOYEE_SIGNAL' WHEN head_age <= 120 THEN 'OBSERVED_EMPLOYEE' ELSE 'CARRIED_EMPLOYEE' END AS employee_class, CAST(head_weight AS DECIMAL(9,4)) AS head_weight,
    {_d('revenue_per_head')}, {_d('operating_income_per_head')}, {_d('r_yoy', 'revenue_per_head_yoy')}, {_d('o_yoy', 'operating_income_per_head_yoy')}, {_d('heads_yoy')}, {_d('growth_spread')} FROM perhead""")
def per_head_productivity(spark, sf_dir):
    """Trailing figures per head with irregular head counts carried to quarter ends; the count's weight falls with its age and its precision."""
    out = _per_head(spark, sf_dir, _trailing_wide(spark, sf_dir))
    return out.select("issuer", "q_end", "heads", "head_age", "employee_class", dec("head_weight", kind="decimal(9,4)"), dec("revenue_per_head"), dec("operating_income_per_head"), dec("revenue_per_head_yoy"), dec("operating_income_per_head_yoy"), dec("heads_yoy"), dec("growth_spread"))


_WORTH = "CASE {c} WHEN 'SUPPORTIVE' THEN 1.0 WHEN 'NEUTRAL' THEN 0.5 WHEN 'ADVERSE' THEN 0.0 WHEN 'CONFLICTED' THEN 0.25 END"
_SIX = "[" + ", ".join(_WORTH.format(c=c) for c in ("growth", "profit", "cash", "margin", "productivity", "capital")) + "]"


@query(f"""{_INPUTS}, {_OPEN}, {_HEADS}, {_TURNOVER.replace('base', 'tbase')},
    six AS (SELECT c.q_end, c.issuer, growth, profit, cash, margin, coalesce({_rec(_dir('round(r_yoy, 6)', 0.01), _dir('round(o_yoy, 6)', 0.02))}, 'INELIGIBLE') AS productivity, {_dir('round(turnover_change, 6)', 0.01)} AS capital FROM classes c LEFT JOIN perhead p ON p.issuer = c.issuer AND p.q_end = c.q_end LEFT JOIN turn t ON t.issuer = c.issuer AND t.q_end = c.q_end)
    SELECT q_end, issuer, productivity, capital, len(list_filter({_SIX}, lambda x: x IS NOT NULL)) AS families, CASE WHEN len(list_filter({_SIX}, lambda x: x IS NOT NULL)) >= 3 THEN CAST(100.0 * list_sum({_SIX}) / len(list_filter({_SIX}, lambda x: x IS NOT NULL)) AS DECIMAL(18,9)) END AS breadth_score FROM six""")
def six_family_breadth(spark, sf_dir):
    """Breadth over all six families: productivity from figures per head and capital from the change of turnover beside the other four."""
    method = Method(spark, sf_dir)
    flows = _flows(method.signals)  # of the settled quarters, so that the lines are summed once
    heads = _per_head(spark, sf_dir, flows).select("q_end", "issuer", *[F.round(f"{f}_per_head_yoy", 6).alias(f"{f}_per_head_yoy") for f in ("revenue", "operating_income")])
    turnover = balances.returns_on(_open_lines(spark, sf_dir), flows.withColumnRenamed("operating_income", "profit"), ("issuer",)).select("q_end", "issuer", F.round("turnover_change", 6).alias("turnover_change"))
    classes = stages.six_families(method.classes, heads, turnover)
    score = scoring.breadth_of_row([F.col(f) for f in stages.FAMILIES])
    return classes.select(*stages.KEYS, "productivity", "capital", score["families"].alias("families"), dec(score["breadth_score"], "breadth_score"))


def _module_values(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Long values of every concept, with the module of ``members``: trailing flows, and the average and beginning of what is open."""
    price = F.col("price") * 100
    more = {"returned": F.when(F.col("flag") == "R", price).otherwise(0), "rebates": F.col("price") * F.col("discount")}
    rows = bridge.quarter_rows(spark, sf_dir, more)
    names = tuple(c for c in rows.columns if c not in ("issuer", "q_start", "q_end", "fiscal_quarter"))
    held = _open_lines(spark, sf_dir)
    moved = held.select("*", F.trunc("q_end", "quarter").alias("q_start"), F.quarter("q_end").alias("fiscal_quarter"))

    def values(wide: DataFrame, told: list[tuple[str, str, str]]) -> DataFrame:
        """A row for each of ``told`` (concept, basis, column) that has a value; rows meet their module before they are opened."""
        each = F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(b).alias("basis"), F.col(x).cast("double").alias("value")) for c, b, x in told])
        return wide.join(members, "issuer").select("issuer", "q_end", "module", F.inline(each)).where("value is not null")

    flows = values(timeseries.trailing_of_rows(rows, names), [(c, "ttm", f"ttm_{c}") for c in names])
    instants = [("open_lines", b, b) for b in ("average", "beginning")]
    return flows.unionByName(values(timeseries.trailing_of_rows(moved, ("opened", "closed")), [*[(c, "ttm", f"ttm_{c}") for c in ("opened", "closed")], *instants]))


_MODULE = "CASE r_regionkey WHEN 0 THEN 'OPERATING' WHEN 1 THEN 'BANK' WHEN 2 THEN 'INSURER' WHEN 3 THEN 'ASSET_MANAGER' WHEN 4 THEN 'REIT' END"
_metric = lambda module, name, upper, lower, unit, scale, sign: f"SELECT issuer, q_end, module, '{name}' AS metric, '{unit}' AS unit, ({upper}) / nullif({lower}, 0) * {scale} AS v, {sign} AS sign FROM t WHERE module = '{module}'"
_ALL_METRICS = " UNION ALL ".join(
    (
        _metric("OPERATING", "OPERATING_MARGIN", "oi", "rev", "pp", 100, 1), _metric("OPERATING", "FCF_MARGIN", "cfo - capex", "rev", "pp", 100, 1), _metric("OPERATING", "CAPEX_INTENSITY", "capex", "rev", "pp", 100, "NULL"), _metric("BANK", "EFFICIENCY_RATIO", "rev - oi", "rev", "bp", 10000, -1),
        _metric("BANK", "NET_CHARGE_OFF_RATE", "ret", "average", "bp", 10000, -1), _metric("BANK", "PREPROVISION_YIELD", "oi + ret", "average", "bp", 10000, 1), _metric("INSURER", "LOSS_RATIO", "ret", "rev", "bp", 10000, -1), _metric("INSURER", "EXPENSE_RATIO", "reb", "rev", "bp", 10000, -1),
        _metric("INSURER", "COMBINED_RATIO", "ret + reb", "rev", "bp", 10000, -1), _metric("ASSET_MANAGER", "FEE_RATE", "cfo", "average", "bp", 10000, 1), _metric("ASSET_MANAGER", "ORGANIC_GROWTH_RATE", "opened4 - closed4", "beginning", "pp", 100, 1), _metric("REIT", "INTEREST_BURDEN", "reb", "oi + reb", "pp", 100, -1),
    )
)


@query(f"""{_PANEL}, {_OPEN}, extra AS (SELECT l_suppkey AS issuer, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q_start, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS ret, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS reb FROM lineitem GROUP BY ALL),
    four AS (SELECT issuer, last_day(q_start + INTERVAL 2 MONTH) AS q_end, CASE WHEN last_day(lag(q_start, 3) OVER x + INTERVAL 11 MONTH) = last_day(q_start + INTERVAL 2 MONTH) THEN sum(ret) OVER y END AS ret, CASE WHEN last_day(lag(q_start, 3) OVER x + INTERVAL 11 MONTH) = last_day(q_start + INTERVAL 2 MONTH) THEN sum(reb) OVER y END AS reb FROM extra
        WINDOW x AS (PARTITION BY issuer ORDER BY q_start), y AS (PARTITION BY issuer ORDER BY q_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    moved AS (SELECT issuer, q_end, average, CAST(beginning AS DOUBLE) AS beginning, CASE WHEN count(*) OVER z = 4 THEN sum(opened) OVER z END AS opened4, CASE WHEN count(*) OVER z = 4 THEN sum(closed) OVER z END AS closed4 FROM mean WINDOW z AS (PARTITION BY issuer ORDER BY q_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    o AS (SELECT issuer, q_end, CAST(max(ttm) FILTER (concept = 'revenue') AS DOUBLE) AS rev, CAST(max(ttm) FILTER (concept = 'operating_income') AS DOUBLE) AS oi, CAST(max(ttm) FILTER (concept = 'cash_from_operations') AS DOUBLE) AS cfo, CAST(max(ttm) FILTER (concept = 'capital_expenditures') AS DOUBLE) AS capex FROM obs GROUP BY ALL),
    t AS (SELECT issuer, q_end, {_MODULE} AS module, rev, oi, cfo, capex, CAST(ret AS DOUBLE) AS ret, CAST(reb AS DOUBLE) AS reb, average, beginning, CAST(opened4 AS DOUBLE) AS opened4, CAST(closed4 AS DOUBLE) AS closed4
        FROM moved FULL JOIN o USING (issuer, q_end) FULL JOIN four USING (issuer, q_end) JOIN supplier ON s_suppkey = issuer JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT issuer, q_end, module, metric, unit, {_d('round(v, 6)', 'value')}, {_d('round(v, 6) * sign', 'aligned')} FROM ({_ALL_METRICS}) WHERE v IS NOT NULL""")
def metric_modules(spark, sf_dir):
    """Twelve metrics of five modules from one relation of terms; a supplier's region is its module."""
    names = F.array(*[F.lit(m) for m in ("OPERATING", "BANK", "INSURER", "ASSET_MANAGER", "REIT")])
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    members = table(spark, sf_dir, "supplier").join(places, "s_nationkey").select(F.col("s_suppkey").alias("issuer"), F.try_element_at(names, F.col("n_regionkey") + 1).alias("module"))
    out = modules.evaluate(_module_values(spark, sf_dir, members), members, modules.formulas(spark))
    return out.select("issuer", "q_end", "module", "metric", "unit", dec(F.round("value", 6), "value"), dec(F.round("aligned", 6), "aligned"))
