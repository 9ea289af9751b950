"""Normalization of each model date and input by itself: its limits, middle and spread from its values alone, then ranks, percentiles and robust scores row by row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from vintara.functions import scalars as S

#: A distribution; its rows are the companies.
GROUP = ("q_end", "input_id")
#: Companies of a date up to which a distribution lies in one task; at 60,000 a task had 369 MB at its peak, several distributions together, and Spark's sort may spill.
ONE_TASK = 1_000_000

_OF_CASE = "peers long, p025 double, p975 double, low double, high double, n_low long, n_high long, center double, mad double, distinct_values long, tied long"
_OF_SCENARIO = "n long, rho double, mean_change double, max_change double, over_10 long"


def _cases(scenarios: list[Row]) -> list[tuple[int, float | None]]:
    """The (age limit, winsor probability) that the scenarios have; each is ranked once."""
    return sorted({(r["excluded_days"], r["winsor"]) for r in scenarios}, key=lambda c: (c[0], c[1] or 0.0))


def _place(ordered: np.ndarray, p: float) -> tuple[float, float, float]:
    """The two values around the place (N - 1) p and the share between them."""
    at = (len(ordered) - 1) * p
    low = int(np.floor(at))
    return float(ordered[low]), float(ordered[min(low + 1, len(ordered) - 1)]), at - low


def _between(low: float, high: float, share: float) -> float:
    return low + (high - low) * share


def _of_case(x: np.ndarray, winsor: float | None) -> tuple:
    """The fields of a case from its values in order."""
    if not len(x):
        return (0, *[None] * 8, 0, 0)
    p025, p975 = _between(*_place(x, 0.025)), _between(*_place(x, 0.975))
    left, right, share = _place(x, 0.5)
    low = high = n_low = n_high = None
    if winsor is not None:
        low, high = _between(*_place(x, winsor)), _between(*_place(x, 1 - winsor))
        n_low, n_high = int(np.searchsorted(x, low, "right")), int(np.searchsorted(x, high, "left"))
        x = np.maximum(np.minimum(x, high), low)
        left, right = (max(min(v, high), low) for v in (left, right))
    center = _between(left, right, share)
    sizes = np.diff(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))))
    return len(x), p025, p975, low, high, n_low, n_high, center, _between(*_place(np.sort(np.abs(x - center)), 0.5)), len(sizes), int(sizes[sizes > 1].sum())


def statistics(usable: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row for each distribution with cases, an array in the order of ``_cases``, and stale, the stale rows of each scenario.

    Only values and ages move, once, each distribution to one task; ``usable`` has GROUP, value and age_days.
    """
    rows = scenarios.collect()  # a policy relation
    cases, ages = _cases(rows), [(r["excluded_days"], r["stale_days"]) for r in rows]
    schema = f"q_end date, input_id string, cases array<struct<{_OF_CASE.replace(' ', ':').replace(',:', ',')}>>, stale array<bigint>"
    names = [part.split()[0] for part in _OF_CASE.split(", ")]

    def one(table: pa.Table) -> pa.Table:
        value, age = table.column("value").to_numpy(), table.column("age_days").to_numpy()
        order = np.argsort(value, kind="stable")
        value, age = value[order], age[order]
        told = [dict(zip(names, _of_case(value[age <= limit], winsor), strict=True)) for limit, winsor in cases]
        kinds = pa.struct([(n, pa.int64() if kind == "long" else pa.float64()) for n, kind in (part.split() for part in _OF_CASE.split(", "))])
        stale = [int(((age <= limit) & (age > old)).sum()) for limit, old in ages]
        return pa.table({"q_end": table.column("q_end").slice(0, 1), "input_id": table.column("input_id").slice(0, 1), "cases": pa.array([told], pa.list_(kinds)), "stale": pa.array([stale], pa.list_(pa.int64()))})

    return usable.select(*GROUP, "value", "age_days").groupBy(*GROUP).applyInArrow(one, schema)


def distributions(usable: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, GROUP, peers, distinct_values, tied, stale_peers and least of every distribution with peers."""
    rows = scenarios.collect()
    cases = _cases(rows)
    each = []
    for k, r in enumerate(rows):
        own = F.col("cases")[cases.index((r["excluded_days"], r["winsor"]))]
        each.append(F.struct(F.lit(r["scenario"]).alias("scenario"), *[own[c].alias(c) for c in ("peers", "distinct_values", "tied")], F.col("stale")[k].alias("stale_peers"), F.lit(r["min_peers"]).alias("least")))
    return statistics(usable, scenarios).select(*GROUP, F.inline(F.array(*each))).where("peers > 0")


def _ranked(usable: DataFrame, scenarios: DataFrame, rows: list[Row]) -> DataFrame:
    """``usable`` with the cases of its distribution and, for every age limit, the smaller and the equal values within it. One exchange by distribution."""
    order = Window.partitionBy(*GROUP).orderBy("value")
    ages = sorted({r["excluded_days"] for r in rows})
    inside = {a: (F.col("age_days") <= a).cast("long") for a in ages}
    upto = [F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for c in inside.values()]
    ties = [F.sum(c).over(order.rangeBetween(Window.currentRow, Window.currentRow)) for c in inside.values()]
    out = usable.where(F.col("age_days") <= ages[-1]).withColumns({f"_{name}_{k}": c for name, all_of in (("upto", upto), ("ties", ties)) for k, c in enumerate(all_of)})
    out = out.select(*usable.columns, *[F.array(*[F.col(f"_{name}_{k}") for k in range(len(ages))]).alias(name) for name in ("upto", "ties")])
    # a row for each date and input: a few thousand
    return out.join(F.broadcast(statistics(usable, scenarios)), list(GROUP))


def _cdf(z: pa.Array) -> pa.Array:
    """``scalars.normal_cdf`` with the same terms in the same order. As a column its code and that of the steps around it are too long for the JVM to compile."""
    x = z.to_numpy(zero_copy_only=False)
    series = np.ones_like(x)
    for k in range(S.SERIES_TERMS, 0, -1):
        series = 1.0 + series * x * x * (1.0 / (2 * k + 1))
    return pa.array(0.5 + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series)


def scored(usable: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row of ``usable`` once for each case, in the order of the cases: GROUP, issuer, value, age_days, approved and what it is there, robust scores too.

    The rows of a distribution lie in one task and follow one another there.
    """
    rows = scenarios.collect()
    ages = sorted({r["excluded_days"] for r in rows})
    cases = F.array(*[F.struct(F.lit(k).alias("case"), F.lit(limit).alias("limit"), F.lit(ages.index(limit)).alias("at")) for k, (limit, _) in enumerate(_cases(rows))])
    each = _ranked(usable, scenarios, rows).select(*usable.columns, "upto", "ties", "cases", F.inline(cases))
    each = each.select(*usable.columns, "case", (F.col("age_days") <= F.col("limit")).alias("inside"), F.col("upto")[F.col("at")].alias("upto"), F.col("ties")[F.col("at")].alias("ties"), F.col("cases")[F.col("case")].alias("own"))
    value, low, high, peers = F.col("value"), F.col("own.low"), F.col("own.high"), F.col("own.peers")
    # clipping keeps the order; all values at or beyond a limit become one tie
    under, over = F.coalesce(value <= low, F.lit(False)), F.coalesce(value >= high, F.lit(False))
    ties = F.when(under & over, peers).when(under, F.col("own.n_low")).when(over, peers - F.col("own.n_high")).otherwise(F.col("ties"))
    before = F.when(under, 0).when(over, F.col("own.n_high")).otherwise(F.col("upto") - F.col("ties"))
    each = each.select(
        *usable.columns, "case", "inside", F.when(low.isNull(), value).otherwise(S.clamp(value, low, high)).alias("sensitivity_value"), ((value < F.col("own.p025")) | (value > F.col("own.p975"))).alias("peer_extreme"),
        ties.cast("long").alias("ties"), before.alias("before"), peers.alias("peer_count"), F.col("own.center").alias("center"), F.col("own.mad").alias("mad"),
    )
    z = S.clamp(F.try_divide(0.6745 * (F.col("sensitivity_value") - F.col("center")), F.col("mad")), -3.0, 3.0)
    each = each.withColumns({"midrank": F.col("before") + (F.col("ties") + 1) / 2.0, "_z": F.when(F.col("mad") > 0, z)})
    each = each.withColumns({"percentile": F.try_divide(100.0 * (F.col("midrank") - 0.5), F.col("peer_count")), "_share": F.arrow_udf(_cdf, "double")(F.coalesce("_z", F.lit(0.0)))})
    return each.withColumn("robust", F.when(F.col("_z").isNotNull(), 100 * F.col("_share"))).drop("before", "center", "mad", "_z", "_share")


def normalize(usable: DataFrame, scenarios: DataFrame) -> DataFrame:
    """See ``stages.normalize``: the way for distributions that one task holds each. Nothing is written, and rows move once."""
    rows = scenarios.collect()
    cases = _cases(rows)
    of_case = F.array(*[F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("scenario", "min_peers", "stale_days")]) for r in rows if (r["excluded_days"], r["winsor"]) == c]) for c in cases])
    every = scored(usable, scenarios).where("inside").select("*", F.inline(of_case[F.col("case")]))
    status = F.when(~F.col("approved"), "COMPANY_COVERAGE_HOLD").when(F.col("peer_count") < F.col("min_peers"), "PEER_GROUP_INSUFFICIENT").otherwise("PASS")
    every = every.withColumn("normalization_status", status)
    masked = [F.when(F.col("normalization_status") == "PASS", F.col(c)).alias(c) for c in ("midrank", "percentile", "robust")]
    return every.select("q_end", "input_id", "scenario", "issuer", "value", "sensitivity_value", "peer_extreme", "ties", *masked, F.when(F.col("age_days") > F.col("stale_days"), "STALE").otherwise("CURRENT").alias("age_class"), "peer_count", "min_peers", "normalization_status")


def _midranks(values: np.ndarray) -> np.ndarray:
    _, at, sizes = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(sizes) - (sizes - 1) / 2.0)[at]


def _compared(reference: np.ndarray, score: np.ndarray) -> tuple:
    """The fields of a scenario and method; the mean of midranks is (n + 1) / 2, so that a constant side has no spread at all."""
    n = len(score)
    if not n:
        return 0, None, None, None, 0
    a, b = (_midranks(x) - (n + 1) / 2 for x in (reference, score))
    spread, move = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean()), np.abs(reference - score)
    return n, float((a * b).mean() / spread) if spread else None, float(move.mean()), float(move.max()), int((move > 10).sum())


def sensitivity(usable: DataFrame, scenarios: DataFrame) -> DataFrame:
    """See ``stages.sensitivity``: q_end, scenario, input_id, method, n, rho, mean_change, max_change, over_10, without a table of all scenarios.

    A company's baseline lies beside its other cases, and a distribution's rows follow one another in the task that ranked them, so nothing moves again.
    """
    rows = scenarios.collect()
    cases = _cases(rows)
    at = {r["scenario"]: cases.index((r["excluded_days"], r["winsor"])) for r in rows}
    least, width = {r["scenario"]: r["min_peers"] for r in rows}, len(cases)
    schema = pa.schema([("q_end", pa.date32()), ("scenario", pa.string()), ("input_id", pa.string()), ("method", pa.string()), *[(n, pa.int64() if kind == "long" else pa.float64()) for n, kind in (part.split() for part in _OF_SCENARIO.split(", "))]])

    def of_group(table: pa.Table) -> pa.RecordBatch:
        wide = lambda c: table.column(c).to_numpy(zero_copy_only=False).reshape(-1, width)
        inside, peers, passed = wide("inside").astype(bool), wide("peer_count"), wide("approved").astype(bool)
        scores = {m: wide(m).astype(np.float64) for m in ("percentile", "robust")}
        date, name = table.column("q_end")[0].as_py(), table.column("input_id")[0].as_py()
        shown = lambda s: inside[:, at[s]] & passed[:, at[s]] & (peers[:, at[s]] >= least[s])
        reference, known, out = scores["percentile"][:, at["BASELINE"]], shown("BASELINE"), []
        for s in at:
            if inside[:, at[s]].any():
                for m in scores:
                    score = scores[m][:, at[s]]
                    both = known & shown(s) & ~np.isnan(score)
                    out.append((date, s, name, m, *_compared(reference[both], score[both])))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            new = batch.column("distribution").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1), len(new)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and held[-1].column("distribution")[0].as_py() != new[a]:
                        yield of_group(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield of_group(pa.Table.from_batches(held))

    # scores that two engines round apart must not break ties
    told = [F.round(m, 6).alias(m) for m in ("percentile", "robust")]
    distribution = F.concat_ws(" ", *GROUP).alias("distribution")
    return scored(usable, scenarios).select(distribution, *GROUP, "inside", "approved", "peer_count", *told).mapInArrow(run, f"q_end date, scenario string, input_id string, method string, {_OF_SCENARIO}")
