"""Regressions of round three: each test failed before its change."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from vintara import history_queries, matrix_queries, oracle, queries, stage_oracle
from vintara.operators import closure, peers, scoring, timeseries
from vintara.plans import bridge, policy, settle, stages
from vintara.sources import landing
from vintara.streaming import vintages


def plain(rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


def test_titles_cut_off_inside_a_reference(spark, tmp_path):
    page = "<html><head><title>{}</title></head><body><p>x</p><a href='y'>z</a></body></html>"
    titles = ["Ends in &amp", "Ends in &quot", "&lt;b&gt; &amp;lt; whole", "&am", "&", "plain", "&lt", ""]
    spark.createDataFrame([(k, page.format(t)) for k, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.html_elements(spark, str(tmp_path)).select("page_id", "links", "paragraphs", "title").collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert plain(got) == plain(con.execute(oracle.ORACLE_SQL["html_elements"]).fetchall())


def test_equal_spans_are_counted_the_same_in_any_order(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table lineitem as select (k % 3)::BIGINT as l_suppkey, (k % 20)::BIGINT as l_partkey, DATE '2000-01-01' + (hash(k) % 200 * 60)::INTEGER as l_shipdate, (1 + hash(k, 1) % 3)::DOUBLE as l_quantity from range(200000) r(k)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = history_queries.merged_spans(spark, str(tmp_path)).select("issuer", "shelf", "valid_from", "valid_to", "parts", "overlapping").collect()
    assert plain(got) == plain(con.execute(history_queries.ORACLE_SQL["merged_spans"]).fetchall())


def test_vintages_touch_state_once_a_group(spark, tmp_path):
    data = [(i, f"2000-0{1 + i % 3}-28", 10 * i + v, f"2000-0{4 + v}-10") for i in range(200) for v in range(2)]
    frame = spark.createDataFrame(data, "issuer long, p string, accession long, a string").selectExpr("issuer", "date(p) report_period", "date(a) available", "accession", "timestamp(a) accepted")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = vintages.follow_vintages(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", groups=2)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 2 * 3  # a value, a timer and its index a group, not a key
    assert sorted((r["accession"], r["standing"]) for r in vintages.standing(spark, f"{tmp_path}/out").collect()) == sorted((a, "CURRENT" if a % 10 else "SUPERSEDED") for _, _, a, _ in data)


def test_spearman_behind_one_exchange_writes_nothing(spark, monkeypatch):
    data = spark.range(400).selectExpr("id % 3 as g", "cast(id * 7919 % 23 as double) as a", "cast(if(id % 10 = 0, null, id * 104729 % 19) as double) as b")
    largest = F.max("a").alias("largest")
    want = plain(peers.spearman(data, ("g",), "a", "b", (largest,)).selectExpr("g", "n", "round(rho, 9)", "largest").collect())
    monkeypatch.setattr(peers, "settle", None)  # a call would fail
    assert plain(peers.spearman(data, ("g",), "a", "b", (largest,), small=peers.fits(data, ("g",))).selectExpr("g", "n", "round(rho, 9)", "largest").collect()) == want


def halves(folder):
    """Sixty suppliers whose quantities grow by rates on the edge of a half in the third place, as doubles on either side of it."""
    con = duckdb.connect()
    con.execute("create table q as select s, k, CASE WHEN k < 4 THEN 5000 ELSE ([1657, 1883, 2117, 2343, 2561, 2811][1 + s % 6] + s // 6 * CAST(s % 6 > 2 AS INTEGER)) * 10 // 4 + CAST(k = 7 AS INTEGER) * (([1657, 1883, 2117, 2343, 2561, 2811][1 + s % 6] + s // 6 * CAST(s % 6 > 2 AS INTEGER)) * 10 % 4) END / 100.0 AS quantity from range(60) a(s), range(8) b(k)")
    con.execute("create table lineitem as select s::BIGINT as l_suppkey, quantity::DOUBLE as l_quantity, (1000 + s * k)::DOUBLE as l_extendedprice, 0.0::DOUBLE as l_discount, 0.05::DOUBLE as l_tax, (DATE '1998-02-01' + to_months((3 * k)::INTEGER))::TIMESTAMP as l_shipdate from q")
    con.execute(f"copy lineitem to '{folder}/lineitem.parquet' (format parquet)")
    return con


def test_midranks_of_rates_on_a_half(spark, tmp_path):
    con = halves(tmp_path)
    got = queries.midrank_percentile(spark, str(tmp_path)).select("q_end", "issuer", "input_id", "value", "ties", "peers", "midrank", "percentile").collect()
    assert plain(got) == plain(con.execute(oracle.ORACLE_SQL["midrank_percentile"]).fetchall())


def test_robust_scores_of_rates_on_a_half(spark, tmp_path):
    con = halves(tmp_path)
    got = queries.robust_cdf_score(spark, str(tmp_path)).select("q_end", "issuer", "input_id", "score").collect()
    assert any(r["score"] is not None for r in got)
    assert plain(got) == plain(con.execute(stage_oracle.ORACLE_SQL["robust_cdf_score"]).fetchall())


def test_signals_of_rates_on_a_half(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table pair as select unnest([1, 2, 4, 5, 8]) as s, unnest([48261987, 51315659, 72570813, 91737750, 84331015]) as v, unnest([354, 187, 275, 13853, 161]) as p")
    con.execute("create table lineitem as select s::BIGINT as l_suppkey, 1.0::DOUBLE as l_quantity, CASE WHEN k < 4 THEN p ELSE v END / 100.0::DOUBLE as l_extendedprice, 0.0::DOUBLE as l_discount, 0.05::DOUBLE as l_tax, (DATE '1998-02-01' + to_months((3 * k)::INTEGER))::TIMESTAMP as l_shipdate from pair, range(8) b(k)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = matrix_queries.verified_signals(spark, str(tmp_path)).select("issuer", "q_end", "value", "ttm", "q_yoy", "ttm_yoy", "q_yoy_acceleration", "ttm_yoy_acceleration").collect()
    assert plain(got) == plain(con.execute(queries.ORACLE_SQL["verified_signals"]).fetchall())


def test_closure_walks_no_nodes_without_parents(spark, monkeypatch):
    edges = [(f"r{r}", f"m{r}") for r in range(3)] + [(f"m{r}", f"e{k}") for r in range(3) for k in range(500)] + [("m0", "m1"), ("m1", "m0"), ("r2", "e7"), ("r2", None)]
    monkeypatch.setattr(closure, "LONGEST", 100)
    settled, settle = [], closure.settle

    def counted(frame):
        out = settle(frame)
        settled.append(out.count())
        return out

    monkeypatch.setattr(closure, "settle", counted)
    got = closure.close_over(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([("r0",), ("r2",), ("m0",)], "root string"))
    above = {"r0": {"m0": 1, "m1": 2}, "r2": {"m2": 1}, "m0": {"m1": 1, "m0": 2}}
    ends = {"r0": 2, "r2": 2, "m0": 1}
    want = [(r, n, d) for r, of in above.items() for n, d in of.items()] + [(r, f"e{k}", 1 if (r, k) == ("r2", 7) else d) for r, d in ends.items() for k in range(500)]
    assert plain(got.select("root", "node", "depth").collect()) == plain(want)
    assert max(settled) < 100  # lists of nodes, not nodes


def test_normalization_is_kept_only_where_it_is_read_again(spark):
    settle.forget()
    assert queries.QUERIES["metric_normalization"](spark, "/root/testdata/sf0.001").count() > 0
    assert not any("normalized" in part for key in settle._kept for part in map(str, key))


def test_elements_leave_the_parser_in_bounded_batches():
    pages = ["<html><body>" + "<p a='b'>x</p>" * 98 + "</body></html>"] * 999 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(pages)], names=["k", "h"])
    out = list(landing._tags()(iter([batch])))
    assert max(b.num_rows for b in out) <= 10_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc"], r["position"]) for r in rows] == [(d, p) for d in range(999) for p in range(100)]
    assert {(r["tag"], tuple(r["attributes"]), r["text"]) for r in rows} == {("html", (), ""), ("body", (), ""), ("p", (("a", "b"),), "x")}


def test_quarter_signals_are_those_of_the_long_panel(spark):
    """Holes, missing values, nonpositive bases: one ordering by issuer gives what a window for each concept gave."""
    data = [(i, 4 * (1990 + q // 4) + q % 4, None if (i * 7 + q) % 11 == 0 else 100.0 + (i * 31 + q * 17) % 50, -20.0 + (i * 13 + q * 29) % 50, None if (i + q) % 13 == 5 else 5.0 + (i * q) % 7, 1.0 + (i + 3 * q) % 9) for i in range(1, 9) for q in range(24) if (i + q) % 10]
    start = "make_date(cast(n / 4 as int), cast(1 + n % 4 * 3 as int), 1)"
    names = ("revenue", "operating_income", "cash_from_operations", "capital_expenditures")
    rows = spark.createDataFrame(data, "issuer long, n int, revenue double, operating_income double, cash_from_operations double, capital_expenditures double")
    rows = rows.selectExpr("issuer", f"{start} as q_start", f"last_day(add_months({start}, 2)) as q_end", f"quarter({start}) as fiscal_quarter", *[f"cast({c} as decimal(28,4)) as {c}" for c in names])
    cells = rows.unpivot(["issuer", "q_start", "q_end", "fiscal_quarter"], list(names), "concept", "value")
    observed, cash = timeseries.observations(cells), timeseries.free_cash_flow(cells)
    short = F.create_map(*[F.lit(x) for pair in stages.SHORT.items() for x in pair])[F.col("concept")]
    want = []
    for kind in ("q_yoy", "ttm_yoy", "q_yoy_acceleration", "ttm_yoy_acceleration"):
        want += observed.select("q_end", "issuer", F.concat_ws("_", short, F.lit(kind)), F.round(F.coalesce(kind, F.col(f"{kind}_change").cast("double")), 6).alias("value"), f"{kind}_method").where("value is not null").collect()
    for name, top in (("operating", "operating_income"), ("fcf", "free_cash_flow")):
        for field, told in (("yoy_pp", "MARGIN_YOY_PP"), ("acceleration_pp", "MARGIN_YOY_PP_DELTA")):
            want += timeseries.margins(cash, top).select("q_end", "issuer", F.lit(f"{name}_margin_{field}"), F.round(field, 6).alias("value"), F.lit(told)).where("value is not null").collect()
    want += timeseries.leverage_spread(observed).select("q_end", "issuer", F.lit("operating_leverage_spread"), F.round("spread", 6), F.lit("YOY_RATE_SPREAD")).collect()
    signals = stages.quarter_signals(rows)
    got = stages.factor_inputs(signals).collect()
    assert len(got) > 500 and plain(got) == plain(want)
    for c in stages.SHORT:
        assert plain(signals.where(f"history_{c} is not null").select("issuer", "q_end", f"history_{c}").collect()) == plain(observed.where(f"concept = '{c}' and history is not null").select("issuer", "q_end", "history").collect())


def test_hundredths_are_the_decimal_casts(spark):
    values = [0.05, 1.005, 2.675, -0.125, 1.115, 1e9 + 0.015, 0.1 + 0.2, 99999.995, -7.5, None, 0.0, 123456.78]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(bridge.hundredths("v", 12).alias("a"), (F.col("v").cast("decimal(12,2)") * 100).cast("long").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    big = spark.range(5).select(*bridge.split_sum(F.lit(9 * 10**18) - F.col("id"), "x")).select(bridge.joined_sum("x").alias("x")).first()["x"]
    assert big * 10**4 == 45 * 10**18 - 10


def test_scores_of_a_row_are_those_of_the_long_form(spark):
    names = [n for n, _ in policy.TRANSFORMATIONS]
    data = [(k, n, float((k * 37 + j * 11) % 100)) for k in range(60) for j, n in enumerate(names) if (k * 7 + j * 5) % (2 + k % 5)]
    long = spark.createDataFrame(data, "issuer long, input_id string, score double")
    columns = ("factor_score", "original_coverage", "applied_coverage")
    show = lambda rows: plain(rows.select("issuer", "factor", *[F.round(c, 9) for c in columns], "families", "floor_met").collect())
    wide = long.groupBy("issuer").agg(*[F.max(F.when(F.col("input_id") == n, F.col("score"))).alias(n) for n in names])
    each = [F.struct(F.lit(f).alias("factor"), *[s[c].alias(c) for c in (*columns, "families", "floor_met")]) for f, s in scoring.scores_of_row({n: F.col(n) for n in names}).items()]
    assert show(wide.select("issuer", F.inline(F.array(*each)))) == show(scoring.weighted_scores(long, policy.factor_components(spark)))


def test_the_method_keeps_one_panel(spark):
    for name, kept in (("governed_inputs", 1), ("rank_stability", 1), ("weighted_factor_scores", 1), ("peer_level_ranks", 1), ("research_pilot", 3)):
        settle.forget()
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(settle._kept) == kept, name
