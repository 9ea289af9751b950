"""Documents and filings as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.operators.pit import VINTAGE


def new_documents(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each document once however often it arrives within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def maintain_latest(stream: DataFrame, state_path: str, checkpoint: str, keys: tuple[str, ...] = ("issuer", "report_period")):
    """Run the stream to its end (available now) and keep the latest vintage per key under ``state_path``.

    The latest vintage of each key is kept in Spark's keyed state. A micro-batch writes only the
    keys it changed, to a folder of its own number, so a repeated batch writes the same rows again;
    ``latest`` takes the last change of each key. Late amendments win by vintage order.
    """
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*VINTAGE)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{state_path}/batch={n}")
    query = best.writeStream.outputMode("update").foreachBatch(lambda batch, n: write(batch, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, state_path: str, keys: tuple[str, ...] = ("issuer", "report_period")) -> DataFrame:
    """The latest vintage per key of what ``maintain_latest`` has written."""
    rows = spark.read.parquet(state_path).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*VINTAGE)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def windowed_counts(events: DataFrame, at: str, delay: str, width: str, kind: str) -> DataFrame:
    """Counts by event-time window and kind with a watermark."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("arrivals"))
