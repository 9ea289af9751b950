"""Regressions of the second part of round three: each test failed before its change."""

import datetime

import pytest
from pyspark.sql import functions as F

from vintara import history_queries, record_queries
from vintara.operators import balances, closure, contexts, pit, timeseries
from vintara.plans import bridge, modules, settle
from vintara.sources import variant_facts

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", ["six_family_breadth", "metric_modules"])
def test_lines_are_summed_once_for_all_flows(spark, monkeypatch, name):
    calls, scan = [], bridge.table
    monkeypatch.setattr(bridge, "table", lambda s, d, t: calls.append(t) or scan(s, d, t))
    monkeypatch.setattr(history_queries, "table", bridge.table)
    settle.forget()
    history_queries.QUERIES[name](spark, SF)
    # the flows, what is open, and in the first the head counts
    assert calls.count("lineitem") == {"six_family_breadth": 3, "metric_modules": 2}[name]


def test_spells_give_the_balances_of_their_changes(spark):
    d = datetime.date
    data = [(k, d(2000 + k % 2, 1 + 5 * j % 12, 1 + j % 28), d(2001 + j % 2, 1 + 7 * j % 12, 5), (-1) ** (j % 5 == 0) * (100 * j + k)) for k in range(4) for j in range(30)] + [(9, None, d(2000, 1, 1), 5), (9, d(1999, 1, 1), d(1999, 1, 2), None)]
    spells = spark.createDataFrame(data, "issuer long, since date, until date, amount long")
    value = (F.col("amount") / F.lit(100)).cast("decimal(13,2)")
    deltas = spells.select("issuer", F.inline(F.array(F.struct(F.col("since").alias("day"), value.alias("amount")), F.struct(F.col("until").alias("day"), (-value).cast("decimal(13,2)").alias("amount")))))
    columns = ("issuer", "q_end", "balance", "opened", "closed")
    got = balances.spell_balances(spells, ("issuer",)).select(*columns).collect()
    assert len(got) > 20 and plain(got) == plain(balances.balances(deltas, ("issuer",)).select(*columns).collect())


def test_trailing_sums_of_rows_are_those_of_cells(spark):
    data = [(i, 2000 + q // 4, 1 + q % 4, None if (i + q) % 11 == 0 else float(i + q), None if (i * q) % 13 == 5 else float(q)) for i in range(6) for q in range(20) if (i + q) % 9]
    rows = spark.createDataFrame(data, "issuer long, y int, fiscal_quarter int, a double, b double").selectExpr("issuer", "make_date(y, fiscal_quarter * 3 - 2, 1) q_start", "last_day(make_date(y, fiscal_quarter * 3, 1)) q_end", "fiscal_quarter", "cast(a as decimal(28,4)) a", "cast(b as decimal(28,4)) b")
    cells = rows.unpivot(["issuer", "q_start", "q_end", "fiscal_quarter"], ["a", "b"], "concept", "value")
    want = timeseries.trailing(timeseries.mark_runs(cells)).where("ttm is not null").select("issuer", "q_end", "concept", "ttm").collect()
    got = timeseries.trailing_of_rows(rows, ("a", "b")).unpivot(["issuer", "q_end"], ["ttm_a", "ttm_b"], "concept", "ttm").where("ttm is not null").selectExpr("issuer", "q_end", "substr(concept, 5)", "ttm").collect()
    assert len(got) > 20 and plain(got) == plain(want)


def test_metrics_of_values_that_know_their_module(spark):
    values = spark.createDataFrame([(1, "2000-03-31", "OPERATING", "operating_income", "ttm", 5.0), (1, "2000-03-31", "OPERATING", "revenue", "ttm", 50.0)], "issuer long, q_end string, module string, concept string, basis string, value double")
    got = modules.evaluate(values, None, modules.formulas(spark)).collect()
    assert [(r["metric"], r["value"], r["unit"], r["aligned"]) for r in got] == [("OPERATING_MARGIN", 10.0, "pp", 10.0)]


def test_resolving_keeps_no_links_to_nodes_without_parents(spark, monkeypatch):
    edges = [(f"q{q}", f"f{k}") for q in range(3) for k in range(q, 300)] * 2 + [("o", "q0"), ("o", "q1"), ("s", "o"), ("s", "q2"), ("s", "f0"), ("x", "y"), ("y", "x"), ("y", "f1"), ("z", "x"), ("l", "gone"), ("l", "q0")]
    settled, settle_one = [], closure.settle

    def counted(frame):
        out = settle_one(frame)
        settled.append(out.count())
        return out

    monkeypatch.setattr(closure, "settle", counted)
    known = spark.createDataFrame([(f"f{k}", 1000 - k) for k in range(300)] + [("q2", 5000)], "node string, available int")
    told = {r["node"]: (r["available"], r["status"], r["height"]) for r in closure.resolve(spark.createDataFrame(edges, "child string, parent string"), known).collect()}
    want = {"q0": (1000, "RESOLVED", 1), "q1": (999, "RESOLVED", 1), "q2": (5000, "RESOLVED", 1), "o": (1000, "RESOLVED", 2), "s": (5000, "RESOLVED", 3), "x": (None, "CYCLE", None), "y": (None, "CYCLE", None), "z": (None, "CYCLE", None), "l": (None, "MISSING_PARENT", 2), "gone": (None, "MISSING_PARENT", 0)}
    assert {n: told[n] for n in want} == want and len(told) == len(want) + 300 and told["f7"] == (993, "RESOLVED", 0)
    assert max(settled) < 30


def test_facts_are_decided_where_their_filing_lies(spark):
    """Lines move by filing once for the candidates and once for their contexts; nothing is joined on all the keys."""
    plan = record_queries.canonical_facts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("local_concept") and "hashpartitioning(accession" in plan
    assert not any("hashpartitioning" in row and "local_concept" in row for row in plan.split("\n"))


def test_null_keys_prove_nothing(spark):
    names = "accession int, local_concept string, start int, end int, value int"
    own = spark.createDataFrame([(1, "a", 1, 1, None), (1, "a", 1, 1, 5), (1, "b", 1, 1, 5), (1, "b", 1, 1, 5)], names)
    proofs = spark.createDataFrame([(1, "a", 1, 1, None, "x", 0), (1, "a", 1, 1, 5, "y", 0), (1, "a", 1, 1, 5, "y", 0), (1, "b", 1, 1, 5, "y", 0), (1, "b", 1, 1, 5, "z", 1), (1, "c", 1, 1, 5, "z", 1)], names + ", context_id string, dimensions int")
    got = contexts.match_contexts(own, proofs).select("local_concept", "value", "contexts", "match", "context_id").collect()
    assert plain(got) == plain([("a", None, 0, "NO_MATCH", None), ("a", 5, 1, "EXACT", "y"), ("b", 5, 2, "EXACT", "y"), ("b", 5, 2, "EXACT", "y")])


def test_kinds_of_variants_need_no_schema_of_what_lies_in_them(spark):
    odd = ['{"facts":{"a":{"c":{"units":{"u":[]}}}}}', '{"facts":{"a":{"c":{"units":{"u":{}, "w":"[]", "n":null}}}}}', '{"facts":{"a":{"c":{"units":[]}, "d":[], "e":7}}}', '{"facts":[]}', '{"facts":null}', '{"facts":{}}', "[]", '{"facts":{"a":{"c":{"units":{"u":[null, 1, [], {}, {"accn":"x","end":"2000-01-31","val":1.50,"b":{"q":[1]},"a":null}]}}}}}']
    frame = spark.createDataFrame(list(enumerate(odd)), "k int, json string")
    facts, rejects = variant_facts.variant_facts(frame, "k")
    assert [(r["k"], r["place"], str(r["value"]), list(r["extra"])) for r in facts.collect()] == [(7, 4, "1.5000", ["a", "b"])]
    want = [(1, "NOT_A_LIST")] * 3 + [(2, "NOT_AN_OBJECT")] * 3 + [(3, "NOT_AN_OBJECT"), (4, "NOT_AN_OBJECT"), (6, "NO_FACTS")] + [(7, "NOT_AN_OBSERVATION")] * 3 + [(7, "NO_ACCESSION")]
    assert plain(rejects.select("k", "problem").collect()) == plain(want)
    assert "schema_of_variant" not in facts._jdf.queryExecution().analyzed().toString()


def test_latest_values_are_counted_behind_one_exchange(spark):
    """The latest date's values, nulls aside; a repeated value counts once, and older dates do not count."""
    data = [(1, 1, 5.0), (1, 2, 7.0), (1, 2, 7.0), (2, 2, 1.0), (2, 2, 3.0), (2, 1, 9.0), (3, 4, None), (3, 3, 2.0), (4, 4, None), (4, 4, 6.0), (None, 1, 1.0)]
    frame = spark.createDataFrame([(k, a, n, n, v) for n, (k, a, v) in enumerate(data)], "k int, available int, accepted int, accession int, value double")
    kinds = pit.latest_values(frame, ("k",))
    assert plain(kinds.select("k", "values", "fact.accession").collect()) == plain([(1, 1, 2), (2, 2, 4), (3, 0, 6), (4, 1, 9), (None, 1, 10)])
    plan = kinds.select("k", "values")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
