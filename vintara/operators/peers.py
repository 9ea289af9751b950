"""Peer statistics with ties: exact midranks and quantiles without sorting a whole peer group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import clamp
from vintara.plans.settle import settle

#: Value ranges that a peer group is cut into; each is ranked on its own.
BUCKETS = 16
#: Distinct values of a group that one task sorts.
ONE_SORT = 200_000


def distribution(rows: DataFrame, group: tuple[str, ...], value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per group and distinct value: ties, before (smaller values) and peers (all values); nulls are left out.

    Equal values are counted before any ordering. Groups of up to ONE_SORT distinct values are each ranked
    by one running sum. If there are larger ones, cut points from a quantile sketch split each group into ranges; running
    counts are taken inside ranges and shifted by the counts of the ranges before, so a group of any
    size is ranked by many tasks. Both give the same numbers; cut points only balance the work.
    """
    counts = settle(rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties")))
    if counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ONE_SORT).isEmpty():
        every = Window.partitionBy(*group)
        smaller = every.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*group, value, "ties", F.coalesce(F.sum("ties").over(smaller), F.lit(0)).alias("before"), F.sum("ties").over(every).alias("peers"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 1000).alias("_cuts"), F.sum("ties").alias("peers"))
    placed = counts.join(cuts, list(group)) if group else counts.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    shift = placed.groupBy(*group, "_range").agg(F.sum("ties").alias("_n"))
    shift = shift.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return placed.join(shift, [*group, "_range"]).select(*group, value, "ties", (F.col("_before") + F.col("_inside")).alias("before"), "peers")


def fits(rows: DataFrame, group: tuple[str, ...], most: int | None = None) -> bool:
    """Whether no group has more than ``most`` rows, ONE_SORT by default."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (ONE_SORT if most is None else most)).isEmpty()


def rank_rows(rows: DataFrame, group: tuple[str, ...], value: str, small: bool | None = None) -> DataFrame:
    """``rows`` with ties, before and peers as in ``distribution``; the value is never null. ``rows`` is read twice.

    While no group has more than ONE_SORT rows, one exchange by group gives all three; otherwise the distribution is joined.
    ``small`` tells whether every group ``fits``, where that is known.
    """
    if not (fits(rows, group) if small is None else small):
        return rows.join(distribution(rows, group, value), [*group, value])
    every = Window.partitionBy(*group)
    one = F.count(F.lit(1))
    return rows.withColumns({"before": F.rank().over(every.orderBy(value)) - 1, "ties": one.over(Window.partitionBy(*group, value)), "peers": one.over(every)})


def midrank_percentiles(rows: DataFrame, group: tuple[str, ...], value: str, ranked: DataFrame | None = None) -> DataFrame:
    """Add ties, peers, midrank (average place of equal values) and percentile, 100 (midrank - 1/2) / peers.

    ``ranked`` is the ``distribution`` of the rows, where it is there already.
    """
    ranked = distribution(rows, group, value) if ranked is None else ranked
    midrank = F.col("before") + (F.col("ties") + 1) / 2.0
    ranked = ranked.select(*group, value, "ties", "peers", midrank.alias("midrank"), (100.0 * (midrank - 0.5) / F.col("peers")).alias("percentile"))
    return rows.join(ranked, [*group, value], "left")


def quantiles(ranked: DataFrame, group: tuple[str, ...], value: str, named: dict[str, float], parts: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles from ``distribution``: linear between the places around (N - 1) p. One aggregation for all.

    For each name in ``parts`` the two values around the place and the share between them come apart, as {name}_lo, {name}_hi and {name}_f.
    """

    def place(k):
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col(value)))

    picks, out = [], []
    for name, p in (named | (parts or {})).items():
        at = (F.col("peers") - 1) * F.lit(float(p))
        low = F.floor(at)
        high = F.least(low + 1, F.col("peers") - 1)
        picks += [place(low).alias(f"{name}_lo"), place(high).alias(f"{name}_hi"), F.max(at - low).alias(f"{name}_f")]
        if name in named:
            out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_f")).alias(name))
        else:
            out += [F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_f")]
    return ranked.groupBy(*group).agg(F.max("peers").alias("peers"), *picks).select(*group, "peers", *out)


def robust_z(rows: DataFrame, group: tuple[str, ...], value: str, ranked: DataFrame | None = None) -> DataFrame:
    """Add center, mad and z: 0.6745 (v - median) / MAD within -3 and 3; null where the MAD is 0. ``ranked`` as above."""
    center = quantiles(distribution(rows, group, value) if ranked is None else ranked, group, value, {"center": 0.5}).drop("peers")
    near = settle(rows.join(center, list(group), "left").withColumn("_off", F.abs(F.col(value) - F.col("center"))))
    mad = quantiles(distribution(near, group, "_off"), group, "_off", {"mad": 0.5}).drop("peers")
    z = clamp(F.try_divide(0.6745 * (F.col(value) - F.col("center")), F.col("mad")), -3.0, 3.0)
    return near.join(mad, list(group), "left").withColumn("z", F.when(F.col("mad") > 0, z)).drop("_off")


def withhold(rows: DataFrame, group: tuple[str, ...], value: str, scores: tuple[str, ...], scenarios: DataFrame, approved: DataFrame | None = None, issuer: tuple[str, ...] = ("issuer",)) -> DataFrame:
    """Scored rows under each scenario: ``scores`` are null for groups below the scenario's min_peers and for held issuers.

    Adds scenario (where ``rows`` have it already, it is part of the group), peer_count, min_peers and
    normalization_status. Scores come from all of a group, held issuers among them, and are masked
    only here. ``approved`` lists the issuers that are not held; without it none is held. Rows with a
    null value are no peers and have no score and no status.
    """
    least = F.broadcast(scenarios.select("scenario", "min_peers"))
    out = rows.join(least, "scenario") if "scenario" in rows.columns else rows.crossJoin(least)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("peer_count"))
    out = out.join(counts, list(group), "left") if group else out.crossJoin(F.broadcast(counts))
    held = F.lit(False)
    if approved is not None:
        out = out.join(approved.select(*issuer, F.lit(True).alias("_approved")).distinct(), list(issuer), "left")
        held = F.col("_approved").isNull()
    status = F.when(F.col(value).isNull(), None).when(held, "COMPANY_COVERAGE_HOLD").when(F.col("peer_count") < F.col("min_peers"), "PEER_GROUP_INSUFFICIENT").otherwise("PASS")
    out = out.withColumn("normalization_status", status)
    out = out.withColumns({s: F.when(F.col("normalization_status") == "PASS", F.col(s)) for s in scores})
    return out.select(*rows.columns, *[c for c in ("scenario",) if c not in rows.columns], "peer_count", "min_peers", "normalization_status")


def winsorize(rows: DataFrame, group: tuple[str, ...], value: str, limits: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Add clipped: the value within its group's limits; a group without limits keeps it."""
    joined = rows.join(limits.select(*group, F.col(low).alias("_l"), F.col(high).alias("_h")), list(group), "left")
    return joined.withColumn("clipped", F.when(F.col("_l").isNull(), F.col(value)).otherwise(clamp(F.col(value), F.col("_l"), F.col("_h")))).drop("_l", "_h")


def spearman(pairs: DataFrame, group: tuple[str, ...], left: str, right: str, also: tuple[Column, ...] = (), small: bool = False) -> DataFrame:
    """(group, n, rho and the aggregates ``also``): Pearson's correlation of midranks; null for fewer than two pairs or a constant side.

    With ``small`` it is known that every group ``fits``: both sides are then ranked and correlated behind one exchange
    by group, and nothing is written.
    """
    rows = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    if small:
        every, one = Window.partitionBy(*group), F.count(F.lit(1))
        rows = rows.withColumns({name: F.rank().over(every.orderBy(c)) + (one.over(Window.partitionBy(*group, c)) - 1) / 2.0 for name, c in (("_a", left), ("_b", right))})
    else:
        rows = settle(rows)
        for name, column in (("_a", left), ("_b", right)):
            ranked = distribution(rows, group, column).select(*group, column, (F.col("before") + (F.col("ties") + 1) / 2.0).alias(name))
            rows = rows.join(ranked, [*group, column])
    parts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_x"), F.stddev_pop("_b").alias("_y"), *also)
    return parts.withColumn("rho", F.try_divide(F.col("_c"), F.col("_x") * F.col("_y"))).drop("_c", "_x", "_y")


def narrowest_peer_group(rows: DataFrame, value: str, levels: tuple[tuple[str, str, int], ...], metric: tuple[str, ...] = ("input_id",)) -> DataFrame:
    """Each row with the narrowest level that has enough peers: level, key and peers, or nulls.

    ``levels`` lists (level, key column, minimum) from narrow to wide. Counts are aggregated per
    level; the level is the first that suffices.
    """
    counted = rows
    for level, key, _ in levels:
        n = rows.where(F.col(value).isNotNull()).groupBy(*metric, key).agg(F.count(F.lit(1)).alias(f"_n_{level}"))
        counted = counted.join(n, [*metric, key], "left")
    enough = [F.when(F.col(f"_n_{level}") >= least, F.struct(F.lit(level).alias("level"), F.col(key).cast("string").alias("key"), F.col(f"_n_{level}").alias("peers"))) for level, key, least in levels]
    return counted.withColumn("_g", F.coalesce(*enough)).select(*rows.columns, F.col("_g.level").alias("level"), F.col("_g.key").alias("level_key"), F.col("_g.peers").alias("level_peers"))


def ranks_by_level(rows: DataFrame, value: str, levels: tuple[tuple[str, str, int], ...], keys: tuple[str, ...], metric: tuple[str, ...] = ("input_id",), small: bool | None = None) -> DataFrame:
    """Every row with its percentile in each level's group, as rows: ``rows``' columns, place, level, level_key, least, level_peers and percentile.

    ``levels`` is as in ``narrowest_peer_group``. All levels are ranked by one ``distribution``, whose groups are
    (metric, level, key); the widest level may be one group of everything and is still not ranked in one task when it is large.
    With ``small`` it is known that every group ``fits`` and no value is null: one exchange then ranks all, and nothing is written.
    """
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(level).alias("level"), F.col(key).cast("string").alias("level_key"), F.lit(least).alias("least")) for k, (level, key, least) in enumerate(levels)])
    long, group = rows.select("*", F.inline(each)).where(F.col("level_key").isNotNull()), (*metric, "level", "level_key")
    if small:
        place = F.col("before") + (F.col("ties") + 1) / 2.0
        return rank_rows(long, group, value, True).withColumn("percentile", 100.0 * (place - 0.5) / F.col("peers")).withColumnRenamed("peers", "level_peers").drop("before", "ties")
    long = settle(long)
    return midrank_percentiles(long, group, value).withColumnRenamed("peers", "level_peers").drop("ties", "midrank")


def narrowest_ranks(ranked: DataFrame, columns: tuple[str, ...], broader: int = 0) -> DataFrame:
    """Of ``ranks_by_level`` each row once (named by ``columns``), with level, level_key, level_peers and percentile of the narrowest group that has enough peers.

    With ``broader`` the level so many places wider is taken where there is one. Rows without any sufficient group have nulls; a missing value has no percentile.
    """
    told = F.struct("level", "level_key", "level_peers", "percentile")
    enough = F.min(F.when(F.col("level_peers") >= F.col("least"), F.col("place")))
    wide = ranked.groupBy(*columns).agg(enough.alias("_first"), F.map_from_entries(F.collect_list(F.struct("place", told.alias("told")))).alias("_all"), F.max("place").alias("_last"))
    chosen = F.try_element_at("_all", F.least(F.col("_first") + broader, F.col("_last")))
    return wide.withColumn("_g", F.when(F.col("_first").isNotNull(), chosen)).select(*columns, *[F.col("_g")[c].alias(c) for c in ("level", "level_key", "level_peers", "percentile")])
