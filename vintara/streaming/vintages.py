"""The latest vintage of every period as filings arrive, in keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vintara.operators.pit import VINTAGE

#: What is told of a filing: it became the latest, a later one replaced it, or its period was closed with it.
CURRENT, SUPERSEDED, FINAL = "CURRENT", "SUPERSEDED", "FINAL"
#: Hash groups that keys are kept in.
GROUPS = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestVintage(StatefulProcessor):
    """The latest vintage of each open period of a group of keys, as one value a group, and one timer, set to the first period to be closed.

    A period is closed ``days`` after its latest vintage became known. State is read and written once a group and
    batch, whatever the number of its rows.
    """

    def __init__(self, keys: tuple[str, ...], state: T.StructType, days: int, told: T.StructType):
        self.keys, self.schema, self.days, self.told = keys, state, days, Row(*told.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schema)

    def _expiry(self, vintage: tuple) -> int:
        known = vintage[0]
        known = known if isinstance(known, datetime) else datetime(known.year, known.month, known.day)
        return int((known.replace(tzinfo=timezone.utc) + timedelta(days=self.days)).timestamp() * 1000)

    def _held(self) -> dict[tuple, tuple]:
        n = len(self.keys)
        return {tuple(p)[:n]: tuple(p)[n:] for p in self.open.get()[0]} if self.open.exists() else {}

    def _due(self, held: dict[tuple, tuple]) -> int | None:
        return min(map(self._expiry, held.values()), default=None)

    def _keep(self, held: dict[tuple, tuple], timer: int | None) -> None:
        """Store ``held``; ``timer`` is the time that is set now."""
        if held:
            self.open.update(([(*period, *vintage) for period, vintage in held.items()],))
        else:
            self.open.clear()
        due = self._due(held)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        timer, first = self._due(held), {}
        for row in rows:
            period, vintage = tuple(row[name] for name in self.keys), tuple(row[name] for name in VINTAGE)
            best = held.get(period)
            if vintage == best:
                continue  # a row delivered again
            first.setdefault(period, best)
            older, held[period] = (vintage, best) if best is not None and vintage < best else (best, vintage)
            if older is not None:
                yield self.told(*period, older[2], SUPERSEDED)
        new = [period for period, best in first.items() if held[period] != best]
        for period in new:
            yield self.told(*period, held[period][2], CURRENT)
        if new:
            self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, mark = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        closed = [period for period, vintage in held.items() if self._expiry(vintage) <= mark]
        for period in closed:
            yield self.told(*period, held.pop(period)[2], FINAL)
        if closed:
            self._keep(held, None)  # the timer that went off is gone

    def close(self) -> None:
        pass


def follow_vintages(stream: DataFrame, path: str, checkpoint: str, *, keys: tuple[str, ...] = ("issuer", "report_period"), delay: str = "400 days", close_after: int = 120, groups: int = GROUPS):
    """Run ``stream`` over what is there now and append what becomes of each filing to the table at ``path``.

    State is one vintage an open key, kept by ``groups`` hash groups of keys, each of which is read and written once a
    micro-batch; more groups make each smaller. A key is closed once the watermark is ``close_after`` days past its
    latest vintage, which drops its state, so state follows the filings of the last ``delay`` and
    ``close_after`` days and not all history. Filings older than the watermark when they arrive are left out, so
    ``delay`` has to cover how far arrivals are out of order. The file sink's log makes each
    micro-batch's rows visible once, and a query that is started again goes on from its checkpoint.
    """
    spark = stream.sparkSession
    period = T.StructType([stream.schema[c] for c in (*keys, *VINTAGE)])
    state = T.StructType([T.StructField("periods", T.ArrayType(period))])
    told = T.StructType([*(stream.schema[k] for k in keys), T.StructField("accession", stream.schema["accession"].dataType), T.StructField("event", T.StringType())])
    timed = stream.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), *keys, *VINTAGE, F.col("available").cast("timestamp").alias("known_at")).withWatermark("known_at", delay)
    events = timed.groupBy("_group").transformWithState(LatestVintage(keys, state, close_after, told), told, "Append", "eventTime")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = events.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return query


def standing(spark: SparkSession, path: str, keys: tuple[str, ...] = ("issuer", "report_period")) -> DataFrame:
    """(keys, accession, standing): the last word on every filing that ``follow_vintages`` has told of."""
    rank = F.when(F.col("event") == FINAL, 3).when(F.col("event") == SUPERSEDED, 2).otherwise(1)
    return spark.read.parquet(path).groupBy(*keys, "accession").agg(F.max_by("event", rank).alias("standing"))
