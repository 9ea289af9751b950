"""Documents stored once each, whatever is delivered again and whichever batch fails and is repeated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = ("before", "after")


def _fresh(batch: DataFrame, key: str) -> DataFrame:
    """One row a key: the least of the others' values, so a repeated batch picks the same."""
    rest = [c for c in batch.columns if c != key]
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def store_batch(batch: DataFrame, number: int, key: str, store: str, hook: Callable[[str, int], None] | None = None) -> None:
    """Add the documents of one batch that no earlier batch has stored.

    A batch owns one folder of documents, which it overwrites, and is compared with the batches before
    it alone; so it may be repeated at any point, also after it has stored its rows. Each try leaves a
    mark first. The ledger's line of the batch is written last. Rows without a key are not documents.
    """
    spark = batch.sparkSession
    spark.createDataFrame([(number, uuid.uuid4().hex)], "batch long, attempt string").write.mode("append").parquet(f"{store}/attempts")
    if hook:
        hook(_STEP[0], number)
    fresh = _fresh(batch, key)
    if number and _exists(spark, f"{store}/documents"):
        earlier = spark.read.schema(f"`{key}` {fresh.schema[key].dataType.simpleString()}, batch long").parquet(f"{store}/documents").where(F.col("batch") < number)
        fresh = fresh.join(earlier.select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{store}/documents/batch={number}")
    if hook:
        hook(_STEP[1], number)
    received = batch.agg(F.count(F.lit(1)).alias("received"))
    stored = spark.read.schema(fresh.schema).parquet(f"{store}/documents/batch={number}").agg(F.count(F.lit(1)).alias("stored"))
    received.join(stored).select(F.lit(number).cast("long").alias("batch_no"), "received", "stored").coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")


def take_in(stream: DataFrame, key: str, store: str, *, hook: Callable[[str, int], None] | None = None):
    """Run ``stream`` over what is there now into ``store``; started again, it goes on where it failed. ``hook`` is called at each step and may raise."""
    query = stream.writeStream.foreachBatch(lambda batch, n: store_batch(batch, n, key, store, hook)).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def documents(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/documents")


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """(batch_no, received, stored, attempts) of every finished batch."""
    tries = spark.read.parquet(f"{store}/attempts").groupBy(F.col("batch").alias("batch_no")).agg(F.count_distinct("attempt").alias("attempts"))
    return spark.read.parquet(f"{store}/ledger").select("batch_no", "received", "stored").join(tries, "batch_no")
