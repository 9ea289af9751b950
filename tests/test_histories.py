"""As-of joins, intervals, keyed streams, lineage, balances, figures per head and metric modules against plain programs, with their odd cases."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from vintara.operators import asof, balances, closure, intervals, productivity
from vintara.plans import modules
from vintara.streaming import intake, vintages

DAY = date(2000, 1, 1)


def d(n):
    return None if n is None else DAY + timedelta(days=n)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("max_age", [None, 25])
def test_asof_against_a_plain_scan(spark, strict, max_age):
    r = random.Random(3)
    left = [(k, r.choice([1, 1, 1, 2, 3, None]), r.choice([r.randint(0, 300), None]) if k % 20 == 0 else r.randint(0, 300)) for k in range(400)]
    right = [(r.choice([1, 1, 2, 4, None]), r.choice([r.randint(0, 300), None]) if k % 15 == 0 else r.randint(0, 300), k) for k in range(120)]
    want = []
    for k, key, at in left:
        known = [x for x in right if None not in (key, at, x[0], x[1]) and x[0] == key and (x[1] < at if strict else x[1] <= at)]
        best = max(known, key=lambda x: (x[1], x[2]), default=None)
        want.append((k, best[2] if best and (max_age is None or at - best[1] <= max_age) else None))
    asked = spark.createDataFrame([(k, key, d(at)) for k, key, at in left], "k int, key int, at date")
    told = spark.createDataFrame([(key, d(at), n) for key, at, n in right], "key int, since date, n int")
    got = asof.merge_asof(asked, told, ("key",), "at", "since", ("n",), order=("n",), max_age=max_age, strict=strict, span_days=17)
    assert sorted((x["k"], x["n"]) for x in got.collect()) == sorted(want)
    assert asof.merge_asof(asked.where("false"), told, ("key",), "at", "since", ("n",)).count() == 0
    assert asof.merge_asof(asked, told.where("false"), ("key",), "at", "since", ("n",)).where("n is null").count() == len(left)
    with pytest.raises(ValueError):
        asof.merge_asof(asked, told.withColumn("at", F.col("since")), ("key",), "at", "since", ("at",))


def test_asof_joins_without_broadcast_or_pairs_and_splits_a_hot_key(spark):
    left = spark.range(20_000).select(F.lit(7).alias("key"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("at"), "id")
    right = spark.range(3_000).select(F.lit(7).alias("key"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("since"), F.col("id").alias("n"))
    met = asof.merge_asof(left, right, ("key",), "at", "since", ("n",), order=("n",), span_days=30)
    plan = plan_of(met)
    assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    assert met.where("n % 900 = date_diff(at, date'2000-01-01') and n >= 2100").count() == 20_000  # the greatest n of the day itself


def brute_overlaps(left, right, last):
    far = last + 1
    out = []
    for k, a, b, x in left:
        for k2, c, e, y in right:
            low, high = max(a, c), min(far if b is None else b, far if e is None else e)
            if k == k2 and low < high:
                out.append((k, x, y, low, None if b is None and e is None else high, high - low))
    return sorted(out, key=repr)


def test_overlap_join_against_all_pairs(spark):
    r = random.Random(9)
    some = lambda n: [(r.choice([1, 1, 1, 2, 3]), a, r.choice([a + r.randint(0, 90)] * 6 + [None]), k) for k in range(n) for a in [r.randint(0, 400)]]
    left, right = some(60), some(50)
    last = max(max(a, a if b is None else b) for _, a, b, _ in left + right)
    frames = [spark.createDataFrame([(k, d(a), d(b), x) for k, a, b, x in rows], f"key int, valid_from date, valid_to date, {n} int") for rows, n in ((left, "x"), (right, "y"))]
    for days in (1, 30, 1000):
        met = intervals.overlap_join(*frames, ("key",), days=days)
        got = [(x["key"], x["x"], x["y"], (x["valid_from"] - DAY).days, x["valid_to"] and (x["valid_to"] - DAY).days, x["shared_days"]) for x in met.collect()]
        assert sorted(got, key=repr) == brute_overlaps(left, right, last)
    assert "NestedLoop" not in plan_of(met) and "Cartesian" not in plan_of(met)
    assert intervals.overlap_join(frames[0].where("false"), frames[1], ("key",)).count() == 0


def test_intervals_from_changes_merged_and_checked(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 5, "b", 3), (1, 9, "a", 4), (1, 9, None, 0), (2, 3, None, 1), (2, 7, "x", 2), (2, None, "y", 3)]
    told = spark.createDataFrame([(k, d(at), s, n) for k, at, s, n in rows], "key int, day date, state string, n int")
    got = {tuple(r) for r in intervals.from_changes(told, ("key",), "day", ("state",), ("n",)).collect()}
    assert got == {(1, "b", d(0), d(9)), (1, "a", d(9), None), (2, None, d(3), d(7)), (2, "x", d(7), None)}
    spans = [(1, 0, 10), (1, 5, 8), (1, 10, 12), (1, 20, 20), (1, 21, 25), (1, 24, None), (1, 30, 31), (2, 4, 6), (2, 4, 6)]
    frame = spark.createDataFrame([(k, d(a), d(b)) for k, a, b in spans], "key int, valid_from date, valid_to date")
    assert {tuple(r) for r in intervals.merge_intervals(frame, ("key",)).collect()} == {(1, d(0), d(12), 3), (1, d(21), None, 3), (2, d(4), d(6), 2)}
    bad = sorted((r["key"], (r["valid_from"] - DAY).days) for r in intervals.conflicts(frame, ("key",)).where("overlaps").collect())
    assert bad == [(1, 5), (1, 24), (1, 30), (2, 4)]


def filings(spark, rows):
    frame = spark.createDataFrame([(i, d(p), d(a), n) for i, p, a, n in rows], "issuer long, report_period date, available date, accession long")
    return frame.withColumn("accepted", F.col("available").cast("timestamp"))


def test_vintages_over_restarts_keep_little_state(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, 90 * p, 90 * p + r.randint(5, 80), 1000 * i + 10 * p + v) for i in range(8) for p in range(12) for v in range(r.randint(1, 3))]
    path, kept = str(tmp_path / "in"), []
    waves = [[x for x in rows if low <= x[2] < low + 90] for low in range(0, 1200, 90)]
    for k, wave in enumerate(w for w in waves if w):
        filings(spark, wave + wave[:2]).coalesce(1).write.mode("append").parquet(path)  # two rows come twice
        stream = spark.readStream.schema(filings(spark, rows[:1]).schema).parquet(path)
        query = vintages.follow_vintages(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay="100 days", close_after=120)  # a restart after every wave
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    latest = {}
    for i, p, a, n in rows:
        latest[i, p] = max(latest.get((i, p), (0, 0)), (a, n))
    mark = max(x[2] for x in rows) - 100
    want = {n: "SUPERSEDED" if latest[i, p][1] != n else "FINAL" if latest[i, p][0] + 120 <= mark else "CURRENT" for i, p, a, n in rows}
    got = vintages.standing(spark, str(tmp_path / "out")).collect()
    assert {x["accession"]: x["standing"] for x in got} == want and len(got) == len(rows)
    assert set(want.values()) == {"SUPERSEDED", "FINAL", "CURRENT"}
    assert max(kept) <= 6 * 8 * 2 and max(kept) < len(latest) * 2  # a value and a timer a key, for the periods of the last 220 days


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["before", "after"])
def test_intake_stores_each_document_once_whatever_fails(spark, tmp_path, step):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    for k in range(4):
        spark.createDataFrame([(f"doc{n}", k, n) for n in range(10 * k, 10 * k + 15)] + [(None, k, 0)], "name string, wave int, n int").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("name string, wave int, n int").option("maxFilesPerTrigger", 1).parquet(path)
    failures = {1: 2, 3: 1}

    def fault(where, number):
        if where == step and failures.get(number, 0):
            failures[number] -= 1
            raise Broken

    for _ in range(3):
        with pytest.raises(Exception):
            intake.take_in(stream, "name", store, hook=fault)
    intake.take_in(stream, "name", store, hook=fault)
    names = [r["name"] for r in intake.documents(spark, store).collect()]
    assert sorted(names) == sorted(f"doc{n}" for n in range(45))
    book = {r["batch_no"]: (r["received"], r["stored"], r["attempts"]) for r in intake.ledger(spark, store).collect()}
    assert sum(b[1] for b in book.values()) == 45 and sorted(b[2] for b in book.values()) == [1, 1, 2, 3] and book[1][2] == 3 and {b[0] for b in book.values()} == {16}


def test_lineage_with_diamonds_cycles_and_missing_parents(spark):
    edges = [("s", "o1"), ("s", "o2"), ("o1", "q1"), ("o1", "q2"), ("o2", "q2"), ("q1", "f1"), ("q2", "f2"), ("q2", "f2"), ("m", "q1"), ("m", "gone"), ("mm", "m"), ("c1", "c2"), ("c2", "c1"), ("c1", "f1"), ("above", "c2"), ("self", "self"), (None, "x"), ("y", None), ("dated", "f1")]
    frame = spark.createDataFrame(edges, "child string, parent string")
    known = spark.createDataFrame([("f1", d(3)), ("f2", d(9)), ("f2", d(8)), ("dated", d(40)), ("unused", d(1))], "node string, available date")
    got = {r["node"]: (r["available"], r["status"], r["height"]) for r in closure.resolve(frame, known).collect()}
    assert got == {
        "f1": (d(3), "RESOLVED", 0), "f2": (d(9), "RESOLVED", 0), "q1": (d(3), "RESOLVED", 1), "q2": (d(9), "RESOLVED", 1), "o1": (d(9), "RESOLVED", 2), "o2": (d(9), "RESOLVED", 2), "s": (d(9), "RESOLVED", 3), "dated": (d(40), "RESOLVED", 1),
        "gone": (None, "MISSING_PARENT", 0), "m": (None, "MISSING_PARENT", 2), "mm": (None, "MISSING_PARENT", 3), "c1": (None, "CYCLE", None), "c2": (None, "CYCLE", None), "above": (None, "CYCLE", None), "self": (None, "CYCLE", None),
    }
    roots = spark.createDataFrame([("s",), ("c1",), ("self",), ("f1",), (None,)], "root string")
    found = defaultdict(dict)
    for r in closure.close_over(frame, roots).collect():
        assert r["node"] not in found[r["root"]]
        found[r["root"]][r["node"]] = r["depth"]
    assert found == {"s": {"o1": 1, "o2": 1, "q1": 2, "q2": 2, "f1": 3, "f2": 3}, "c1": {"c2": 1, "f1": 1, "c1": 2}, "self": {"self": 1}}
    assert closure.close_over(frame.where("false"), roots).count() == 0 == closure.resolve(frame.where("false"), known).count()


def test_balances_and_returns(spark):
    moves = [(1, 0, 100.0), (1, 40, -30.0), (1, 200, 50.0), (1, 500, -120.0), (2, 480, 10.0), (2, None, 5.0), (2, 481, None)]
    held = balances.averaged(balances.balances(spark.createDataFrame([(k, d(n), a) for k, n, a in moves], "issuer int, day date, amount double"), ("issuer",)), ("issuer",))
    rows = sorted((r["issuer"], r["q_end"], r["balance"], r["opened"], r["closed"], r["average"], r["beginning"]) for r in held.collect())
    assert [r[2] for r in rows if r[0] == 1] == [70.0, 70.0, 120.0, 120.0, 120.0, 0.0] and [r[2] for r in rows if r[0] == 2] == [10.0]
    assert [r[5] for r in rows if r[0] == 1] == [None] * 4 + [100.0, 86.0] and rows[5][6] == 70.0
    flows = spark.createDataFrame([(1, r[1], 50.0 * k, 5.0) for k, r in enumerate(rows[:6])], "issuer int, q_end date, revenue double, profit double")
    out = sorted((r["q_end"], r["turnover"], r["return_on_average"], r["incremental_return"]) for r in balances.returns_on(held, flows, ("issuer",)).collect())
    assert out[4][1:] == (2.0, 0.05, None) and out[5][1] == pytest.approx(250 / 86)


def test_counts_are_carried_with_falling_weight(spark):
    told = spark.createDataFrame([(1, d(0), 100, False), (1, d(0), 90, False), (2, d(0), 200, True), (3, d(0), 50, False)], "issuer int, counted_on date, heads int, approximate boolean")
    periods = spark.createDataFrame([(i, d(n), 1000.0, 10.0) for i in (1, 2, 4) for n in (0, 120, 121, 240, 241, 365, 366)], "issuer int, q_end date, revenue double, operating_income double")
    out = sorted((r["issuer"], r["q_end"], r["head_weight"], r["employee_class"], r["heads"]) for r in productivity.carried_counts(periods, told).collect() if r["issuer"] != 4)
    assert [r[2] for r in out[:7]] == [1.0, 1.0, 0.75, 0.75, 0.5, 0.5, 0.0] and [round(r[2], 3) for r in out[7:]] == [0.8, 0.8, 0.6, 0.6, 0.4, 0.4, 0.0]
    assert [r[3][0] for r in out[:7]] == ["O", "O", "C", "C", "C", "C", "N"] and out[0][4] == 100 and out[6][4] is None
    assert productivity.carried_counts(periods, told, max_age=130).where("issuer = 1 and heads is not null").count() == 3
    assert productivity.carried_counts(periods, told).where("issuer = 4 and employee_class = 'NO_EMPLOYEE_SIGNAL' and heads is null").count() == 7


def test_a_metric_needs_all_its_terms(spark):
    values = [(1, "revenue", "ttm", 200.0), (1, "operating_income", "ttm", 50.0), (1, "cash_from_operations", "ttm", 30.0), (2, "revenue", "ttm", 0.0), (2, "returned", "ttm", 5.0), (2, "rebates", "ttm", None), (3, "revenue", "ttm", 100.0), (3, "operating_income", "ttm", 20.0)]
    frame = spark.createDataFrame([(i, d(0), c, b, v) for i, c, b, v in values], "issuer int, q_end date, concept string, basis string, value double")
    members = spark.createDataFrame([(1, "OPERATING"), (2, "INSURER"), (3, "BANK"), (4, None)], "issuer int, module string")
    out = {(r["issuer"], r["metric"]): (r["value"], r["aligned"], r["unit"]) for r in modules.evaluate(frame, members, modules.formulas(spark)).collect()}
    assert out == {(1, "OPERATING_MARGIN"): (25.0, 25.0, "pp"), (3, "EFFICIENCY_RATIO"): (8000.0, -8000.0, "bp")}
    assert len({m for _, m, *_ in modules.TERMS}) == len(modules.METRICS) >= 10


def test_a_settled_table_follows_its_files(spark, tmp_path):
    from vintara.plans.settle import once

    path = str(tmp_path / "t")
    count = lambda: once(spark, ("rows", path), lambda: spark.read.parquet(path)).count()
    spark.range(5).write.parquet(path)
    assert count() == 5 == count()
    spark.range(9).write.mode("overwrite").parquet(path)
    assert count() == 9


def test_weights_of_scores_that_are_there_equal_those_of_the_whole_grid(spark):
    from vintara.operators import scoring
    from vintara.plans import policy

    r = random.Random(1)
    names = sorted({c[1] for c in policy.COMPONENTS})
    rows = [(i, n, r.uniform(0, 100)) for i in range(60) for n in names if r.random() < [0.3, 0.7, 0.95][i % 3]]
    scores = spark.createDataFrame(rows + [(70, names[0], None)], "issuer int, input_id string, score double")
    entities = spark.range(75).select(F.col("id").cast("int").alias("issuer"))
    parts = policy.factor_components(spark)
    want = scoring.factor_scores(scoring.check_cap(scoring.reweight_quarter_factor(scoring.component_table(scores, parts, entities=entities))))
    got = scoring.weighted_scores(scores, parts, entities=entities)
    plain = lambda f: {(x["issuer"], x["factor"]): tuple(round(v, 9) if isinstance(v, float) else v for v in (x["factor_score"], x["original_coverage"], x["applied_coverage"], x["families"], bool(x["floor_met"]))) for x in f.collect()}
    assert plain(got) == plain(want) and len(plain(got)) == 75 * 4


def test_large_groups_are_ranked_in_ranges_with_the_same_numbers(spark, monkeypatch):
    from vintara.operators import peers

    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 700).cast("double").alias("v"))
    one = sorted(map(tuple, peers.distribution(rows, ("g",), "v").collect()))
    named = lambda: sorted(map(tuple, peers.rank_rows(rows, ("g",), "v").select("g", "v", "ties", "before", "peers").distinct().collect()))
    assert named() == one
    monkeypatch.setattr(peers, "ONE_SORT", 10)
    assert sorted(map(tuple, peers.distribution(rows, ("g",), "v").collect())) == one == named()
    assert sorted(map(tuple, peers.distribution(rows, (), "v").collect()))[0][1:] is not None
