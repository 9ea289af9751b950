"""Tables out: unions, immutable snapshots by model date, fingerprints, published and held rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Union by name over all columns of all frames, in the order they first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(frame: DataFrame, path: str) -> None:
    """Write Parquet, and fail on an empty result (seen as the rows pass, without a second run)."""
    from pyspark.sql import Observation

    seen = Observation("rows written")
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    if not seen.get["rows"]:
        raise ValueError(f"no rows written to {path}")


def row_digest(*columns: str):
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def fingerprint(frame: DataFrame) -> DataFrame:
    """(rows, fingerprint) that do not depend on row order: sums of two 64-bit hashes, merged by aggregation."""
    columns = sorted(frame.columns)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", total(1).cast("string"), total(2).cast("string")), 256).alias("fingerprint"))


def freeze_snapshot(tables: dict[str, DataFrame], model_date: str, root: str) -> DataFrame:
    """Write the named tables of one model date and their manifest once; an existing date is never overwritten.

    Every table needs rows, and a model_date column must hold this date only.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    manifest = []
    for name, frame in tables.items():
        if "model_date" in frame.columns and not frame.where(~F.col("model_date").cast("string").eqNullSafe(model_date)).isEmpty():
            raise ValueError(f"{name} has rows of another model date")
        path = f"{root}/{name}/model_date={model_date}"
        write_table(frame.drop("model_date"), path)
        mark = fingerprint(spark.read.parquet(path)).first()
        manifest.append((model_date, name, mark["rows"], mark["fingerprint"]))
    out = spark.createDataFrame(manifest, "model_date string, name string, rows long, fingerprint string")
    out.write.mode("errorifexists").parquet(f"{root}/_manifest/{model_date}")
    return out


def verify_snapshot(spark: SparkSession, model_date: str, root: str) -> DataFrame:
    """Names whose data no longer match the manifest."""
    expected = spark.read.parquet(f"{root}/_manifest/{model_date}")
    marks = [(r["name"], fingerprint(spark.read.parquet(f"{root}/{r['name']}/model_date={model_date}")).first()["fingerprint"]) for r in expected.collect()]  # one row per table
    now = spark.createDataFrame(marks, "name string, now string")
    return expected.join(now, "name", "full_outer").where(~F.col("fingerprint").eqNullSafe(F.col("now"))).select("name", "fingerprint", "now")


def distinct_payloads(rows: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, references): each content once under its SHA-256, and the rows with that name in its place."""
    named = rows.withColumn("sha256", F.sha2(F.col(content), 256))
    return named.groupBy("sha256").agg(F.first(content).alias(content)), named.drop(content)


def split_published(rows: DataFrame, published: str = "published") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(published, held, summary) of scored rows."""
    yes = F.coalesce(F.col(published), F.lit(False))
    return rows.where(yes), rows.where(~yes), rows.agg(F.count_if(yes).alias("published"), F.count_if(~yes).alias("held"))


def not_yet_fetched(index: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """Eligible index rows whose document is not there yet, the latest row of a url once."""
    last = index.where("eligible").groupBy(key).agg(F.max_by(F.struct(*[c for c in index.columns if c != key]), "available").alias("_r"))
    return last.join(fetched.select(key), key, "left_anti").select(key, "_r.*")
