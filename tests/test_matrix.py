"""Peer levels, the sensitivity sweep, unlisted facts, coverage of sleeves, mapping continuity, membership and numbering, against plain programs."""

import json
import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintara.operators import contexts, gates, peers, scoring, sensitivity
from vintara.plans import governance, policy, stages
from vintara.sources import variant_facts

D = date


def test_sweep_against_counting(spark):
    r = random.Random(2)
    rows = [(dim, D(2000, 3, 31 - k), float(r.choice([0, 1, 2, 3, 5, 8]))) for dim in ("A", "B") for k in range(3) for _ in range(r.randint(1, 60))] + [("A", D(2001, 1, 1), None), ("B", D(2001, 1, 1), 99.0)]
    cuts = [("A", "two", 2.0, True, True), ("A", "three", 3.0, True, False), ("A", "none", 50.0, True, False), ("A", "same", 2.0, True, False), ("B", "p", 3.0, False, True), ("B", "q", 1.0, False, False), ("B", "all", 100.0, False, False), ("C", "x", 1.0, True, True)]
    values = spark.createDataFrame(rows, "dimension string, q_end date, value double")
    frame = spark.createDataFrame(cuts, "dimension string, alternative string, cut double, at_least boolean, is_primary boolean")
    passes = lambda v, c: v is not None and (v >= c[2] if c[3] else v <= c[2])
    want = {}
    for dim, day in {(x[0], x[1]) for x in rows}:
        mine = [x[2] for x in rows if x[:2] == (dim, day)]
        base = next(c for c in cuts if c[0] == dim and c[4])
        for c in (c for c in cuts if c[0] == dim):
            n, e, d = sum(passes(v, c) for v in mine), sum(passes(v, c) and not passes(v, base) for v in mine), sum(passes(v, base) and not passes(v, c) for v in mine)
            b = sum(passes(v, base) for v in mine)
            want[dim, day, c[1]] = (n, e, d, (e + d) / b if b else None)
    got = {(x["dimension"], x["q_end"], x["alternative"]): (x["passing"], x["entered"], x["dropped"], x["turnover"]) for x in sensitivity.sweep(values, frame).collect()}
    assert got == want
    counted = values.groupBy("dimension", "q_end", "value").agg(F.count("*").alias("n"))
    assert {(x["dimension"], x["q_end"], x["alternative"]): (x["passing"], x["entered"], x["dropped"], x["turnover"]) for x in sensitivity.sweep(counted, frame).collect()} == want
    assert "NestedLoop" not in sensitivity.sweep(values, frame)._jdf.queryExecution().executedPlan().toString()


def test_compare_scores(spark):
    rows = spark.createDataFrame([(D(2000, 1, 1), 70.0, 50.0), (D(2000, 1, 1), 50.0, 70.0), (D(2000, 1, 1), None, 80.0), (D(2000, 1, 1), 65.0, None), (D(2000, 2, 1), 1.0, 2.0)], "q_end date, a double, b double")
    got = {(x["q_end"].month, x["alternative"]): (x["passing"], x["entered"], x["dropped"], x["turnover"]) for x in sensitivity.compare(rows, "S", ("A", "a"), {"B": "b"}, 60.0).collect()}
    assert got == {(1, "A"): (2, 0, 0, 0.0), (1, "B"): (2, 2, 2, 2.0), (2, "A"): (0, 0, 0, None), (2, "B"): (0, 0, 0, None)}


@pytest.mark.parametrize("one_sort", [200_000, 3])
def test_ranks_in_the_narrowest_level(spark, monkeypatch, one_sort):
    monkeypatch.setattr(peers, "ONE_SORT", one_sort)
    r = random.Random(4)
    rows = [(i, r.choice("ab"), f"n{i % 7}", None if i % 11 == 0 else f"r{i % 3}", r.choice([None, 1.0, 2.0, 2.0, r.random()])) for i in range(50)]
    frame = spark.createDataFrame(rows, "issuer int, input_id string, nation string, region string, value double").withColumn("everyone", F.lit("all"))
    levels = (("NATION", "nation", 4), ("REGION", "region", 7), ("ALL", "everyone", 15))
    of = lambda x, k: (x[1], k, {0: x[2], 1: x[3], 2: "all"}[k])
    groups = defaultdict(list)
    for x in rows:
        for k in range(3):
            if of(x, k)[2] is not None and x[4] is not None:
                groups[of(x, k)].append(x[4])
    ranked = peers.ranks_by_level(frame, "value", levels, ("issuer",))
    for broader in (0, 1):
        got = {x["issuer"]: (x["level"], x["level_key"], x["level_peers"], x["percentile"] and round(x["percentile"], 9)) for x in peers.narrowest_ranks(ranked, ("issuer", "input_id"), broader).collect()}
        for x in rows:
            first = next((k for k in range(3) if x[4] is not None and of(x, k)[2] is not None and len(groups[of(x, k)]) >= levels[k][2]), None)
            if first is None:
                assert got[x[0]] == (None,) * 4
                continue
            k = min(first + broader, 2)
            if of(x, k)[2] is None:
                assert got[x[0]] == (None,) * 4
                continue
            g = groups[of(x, k)]
            mid = sum(v < x[4] for v in g) + (sum(v == x[4] for v in g) + 1) / 2
            assert got[x[0]] == (levels[k][0], of(x, k)[2], len(g), round(100 * (mid - 0.5) / len(g), 9))


def test_facts_of_unlisted_concepts(spark):
    good = {"accn": "1", "val": 3.5, "start": "2000-01-01", "end": "2000-03-31", "form": "10-Q", "filed": "2000-05-01"}
    doc = {"facts": {"own": {
        "Odd concept": {"label": "x", "units": {"USD": [good, dict(good, val="4.25", frame="CY"), dict(good, val="many"), dict(good, end="2000-02-30"), {"val": 1}, 7, dict(good, accn="", val=None)], "USD/shares": [dict(good, val=-1)], "pure": []}},
        "NoUnits": {"label": "y"}, "Number": 5, "Empty": {"units": {}}, "BadUnit": {"units": {"USD": {"a": 1}}}}, "flat": [1], "none": {}}}
    rows = [(1, json.dumps(doc)), (2, "{not json"), (3, "[1, 2]"), (4, None), (5, '{"facts": 3}'), (6, '{"facts": {}}'), (7, "")]
    facts, rejects = variant_facts.variant_facts(spark.createDataFrame(rows, "cik int, json string").withColumn("unit", F.lit("clash")), "cik")
    got = {(x["concept"], x["unit"], x["place"]): (x["value"], x["accession"], x["start"], x["end"], x["form"], x["filed"], tuple(x["extra"])) for x in facts.collect()}
    rest = ("1", D(2000, 1, 1), D(2000, 3, 31), "10-Q", D(2000, 5, 1))
    assert got == {("Odd concept", "USD", 0): (Decimal("3.5000"), *rest, ()), ("Odd concept", "USD", 1): (Decimal("4.2500"), *rest, ("frame",)), ("Odd concept", "USD/shares", 0): (Decimal("-1.0000"), *rest, ())}
    assert Counter((x["cik"], x["problem"]) for x in rejects.collect()) == {
        (1, "BAD_VALUE"): 1, (1, "BAD_END"): 1, (1, "NO_ACCESSION"): 2, (1, "NOT_AN_OBSERVATION"): 1, (1, "NOT_AN_OBJECT"): 3, (1, "NOT_A_LIST"): 1, (2, "NOT_JSON"): 1, (3, "NO_FACTS"): 1, (4, "NOT_JSON"): 1, (5, "NOT_AN_OBJECT"): 1, (7, "NOT_JSON"): 1,
    }
    paths = {x["path"] for x in rejects.where("cik = 1").collect()}
    assert "$.facts.own.Odd concept.units.USD.2" in paths and "$.facts.own.NoUnits.units" in paths and "$.facts.flat" in paths
    assert facts.where("false").count() == 0


def test_sleeves_need_enough_inputs(spark):
    inputs = spark.createDataFrame([(1, "revenue_q_yoy", True), (1, "operating_income_q_yoy", True), (2, "revenue_q_yoy", True), (2, "operating_income_q_yoy", False), (3, "unknown", True)], "issuer int, input_id string, present boolean")
    sleeves = spark.createDataFrame(policy.SLEEVES, "factor string, sleeve string, input_id string, weight double, needed int")
    got = {(x["issuer"], x["factor"]): round(x["coverage"], 9) for x in scoring.sleeve_coverage(inputs, sleeves).collect()}
    assert got[1, "F2_QUARTER"] == 1.0 and got[2, "F2_QUARTER"] == 0.45 and got[3, "F2_QUARTER"] == 0.0 and len(got) == 12


def test_mapping_continuity(spark):
    facts = [(1, "a", "USD", "f1", 1.0), (1, "b", "USD", "f1", 2.0), (1, "a", "USD", "f2", 1.0), (1, "b", "EUR", "f2", 5.0), (1, "a", "USD", "late", 1.0), (1, "a", "USD", "f1", 0.5), (2, "a", "USD", "f3", 7.0), (3, "z", "USD", "f4", 1.0)]
    frame = spark.createDataFrame([(i, c, u, f, D(2000, 1, 1), D(2000, 3, 31), v) for i, c, u, f, v in facts], "issuer int, taxonomy_concept string, unit string, accession string, start date, end date, value double")
    rules = spark.createDataFrame([(1, "R1", "capex", "a"), (1, "R1", "capex", "b"), (2, "R2", "capex", "a"), (3, "R3", "capex", "a")], "issuer int, rule_id string, canonical_concept string, component string")
    known = spark.createDataFrame([(1, "f1"), (1, "f2"), (2, "f3"), (3, "f4")], "issuer int, accession string")
    evidence, summary = governance.mapping_continuity(frame, rules, known)
    assert {(x["rule_id"], x["accession"]): (x["canonical_value"], x["missing"], x["present"]) for x in evidence.collect()} == {("R1", "f1"): (3.0, "", 2), ("R1", "f2"): (None, "b", 1), ("R2", "f3"): (7.0, "", 1)}
    assert {x["rule_id"]: (x["components"], x["rows"], x["complete_rows"], x["complete_periods"], x["mapping_status"]) for x in summary.collect()} == {"R1": ("a+b", 2, 1, 1, "REVIEW_REQUIRED"), "R2": ("a", 1, 1, 1, "APPROVED"), "R3": ("a", 0, 0, 0, "REVIEW_REQUIRED")}


def test_membership_against_the_request(spark):
    holdings = spark.createDataFrame([("A", "CANDIDATE"), ("B", "DUPLICATE_SYMBOL"), ("B", "DUPLICATE_SYMBOL"), ("-", "INVALID_SYMBOL")], "symbol string, class string")
    requests = spark.createDataFrame([("A",), ("B",), ("C",), ("C",)], "symbol string")
    got = Counter(tuple(x) for x in contexts.membership_audit(holdings, requests, "2001-06-20", "2001-06-30").collect())
    assert got == {("A", "PEER_CANDIDATE", True): 1, ("B", "DUPLICATE_SYMBOL", True): 2, ("-", "INVALID_SYMBOL", False): 1, ("B", "REQUESTED_NOT_IN_PROXY", True): 1, ("C", "REQUESTED_NOT_IN_PROXY", True): 1}
    for day in ("2001-07-01", "2001-06-15"):
        with pytest.raises(Exception):
            contexts.membership_audit(holdings, requests, day, "2001-06-30").collect()


def test_numbering_in_ranges_and_references_as_rows(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", "x", "x", "y", None]), r.choice([None, *range(40)])) for _ in range(500)]
    out = contexts.batch_slices(spark.createDataFrame(rows, "g string, o int").repartition(9), "g", "o", 7).collect()
    for g in ("x", "y", None):
        mine = sorted((x["position"], -1 if x["o"] is None else x["o"], x["batch"]) for x in out if x["g"] == g)
        assert [p for p, *_ in mine] == list(range(1, len(mine) + 1)) and [o for _, o, _ in mine] == sorted(o for _, o, _ in mine)
        assert all(b == -(-p // 7) for p, _, b in mine)
    cited = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert [tuple(x) for x in gates.unresolved_rows(cited, cited.where("k = 2"), "k").collect()] == [(1,)]


def test_a_scenario_in_which_nothing_passes_keeps_its_cells(spark):
    rows = [(D(2000, 3, 31), i, "m", s, "PASS" if s == "BASELINE" else "PEER_GROUP_INSUFFICIENT", float(i), float(i)) for i in range(4) for s in ("BASELINE", "PEER_MIN_60")]
    frame = spark.createDataFrame(rows, "q_end date, issuer int, input_id string, scenario string, normalization_status string, percentile double, robust double")
    got = {(x["scenario"], x["method"]): (x["n"], x["rho"] and round(x["rho"], 9), x["over_10"]) for x in stages.sensitivity(frame).collect()}
    assert got == {("BASELINE", "percentile"): (4, 1.0, 0), ("BASELINE", "robust"): (4, 1.0, 0), ("PEER_MIN_60", "percentile"): (0, None, 0), ("PEER_MIN_60", "robust"): (0, None, 0)}
