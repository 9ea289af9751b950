"""Validity intervals: built from changes, merged, checked for overlaps, and joined where they overlap.

An interval holds from valid_from (inclusive) to valid_to (exclusive); a null end is open. Dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FROM, TO = "valid_from", "valid_to"
_FAR = "9999-12-31"


def _end():
    return F.coalesce(F.col(TO), F.lit(_FAR).cast("date"))


def from_changes(changes: DataFrame, keys: tuple[str, ...], at: str, states: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """(keys, states, valid_from, valid_to): how long each state held, from rows that tell it at some date.

    Of several rows of one date the greatest by ``order`` counts; a row that tells what holds already
    changes nothing. The last state of a key is open. Rows without a date are left out.
    """
    state = F.struct(*states)
    daily = changes.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("date").alias(FROM)).agg(F.max_by(state, F.struct(*(order or states))).alias("_state"))
    w = Window.partitionBy(*keys).orderBy(FROM)
    news = daily.withColumn("_before", F.lag("_state").over(w)).where(~F.col("_state").eqNullSafe(F.col("_before")))
    return news.select(*keys, *[F.col("_state")[s].alias(s) for s in states], FROM, F.lead(FROM).over(w).alias(TO))


def merge_intervals(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, valid_from, valid_to, parts): overlapping or touching intervals of one key as one. Empty intervals are left out."""
    w = Window.partitionBy(*keys).orderBy(FROM, _end())
    reached = F.max(_end()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(FROM) < _end()).withColumn("_new", F.coalesce((F.col(FROM) > reached).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = numbered.groupBy(*keys, "_island").agg(F.min(FROM).alias(FROM), F.max(_end()).alias("_to"), F.count(F.lit(1)).alias("parts"))
    return merged.select(*keys, FROM, F.when(F.col("_to") < F.lit(_FAR).cast("date"), F.col("_to")).alias(TO), "parts")


def conflicts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with overlaps: whether an interval begins before an earlier one of its key has ended. Ties are in order of their ends."""
    w = Window.partitionBy(*keys).orderBy(FROM, _end()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("overlaps", F.coalesce(F.col(FROM) < F.max(F.when(F.col(FROM) < _end(), _end())).over(w), F.lit(False)) & (F.col(FROM) < _end()))


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], *, days: int = 90) -> DataFrame:
    """Every pair of a left and a right interval of one key that share a day, with the days they share.

    Time is cut into slots of ``days``. An interval stands once in every slot it touches, the sides
    meet by key and slot in an equality join, and a pair is kept in the slot where its common days
    begin, so it comes once without any distinct. A key with very many intervals is shared by its
    slots. An open end lasts to the day after the last date of either table. ``days`` near the usual length of
    an interval keeps the copies few. Columns other than the keys must differ by name. Empty intervals meet nothing.
    """
    ends = [side.agg(F.max(F.greatest(F.col(FROM), F.coalesce(F.col(TO), F.col(FROM)))).alias("d")) for side in (left, right)]
    last = max((d for d in (e.first()["d"] for e in ends) if d is not None), default=None)  # one date a side
    horizon = F.date_add(F.lit(last).cast("date"), 1)

    def slotted(side: DataFrame, name: str) -> DataFrame:
        rest = [c for c in side.columns if c not in (*keys, FROM, TO)]
        held = side.select(*keys, F.col(FROM).alias(f"_{name}_from"), F.col(TO).alias(f"_{name}_to"), F.coalesce(F.col(TO), horizon).alias(f"_{name}_end"), *rest).where(F.col(f"_{name}_from") < F.col(f"_{name}_end"))
        slot = lambda d: F.floor(F.unix_date(d) / F.lit(days)).cast("int")
        return held.withColumn("_slot", F.explode(F.sequence(slot(F.col(f"_{name}_from")), slot(F.date_sub(F.col(f"_{name}_end"), 1)))))

    met = slotted(left, "l").join(slotted(right, "r"), [*keys, "_slot"])
    start, end = F.greatest("_l_from", "_r_from"), F.least("_l_end", "_r_end")
    met = met.where((start < end) & (F.floor(F.unix_date(start) / F.lit(days)) == F.col("_slot")))
    both_open = F.col("_l_to").isNull() & F.col("_r_to").isNull()
    names = [c for c in met.columns if not c.startswith("_")]
    return met.select(*names, start.alias(FROM), F.when(~both_open, end).alias(TO), F.date_diff(end, start).alias("shared_days"))
