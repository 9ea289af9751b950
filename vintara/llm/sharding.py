"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.llm.common import cut, shared_folder

#: The number of virtual slots never changes; the driver handles one number per slot and no more.
SLOTS = 8192
#: Parts of a slot in which its rows are numbered apart, so that a slot with a large group is no single task.
PARTS = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slot(docs: DataFrame, *, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add virtual_slot: a hash of the text, so that equal texts share a slot. Nulls hash as such."""
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(text)), F.lit(slots)).cast("int"))


def spread_heavy(sized: DataFrame, *, group: str, row: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Deal the rows of heavy groups over all slots by their row number; the other rows keep virtual_slot.

    A group (rows equal in ``group``) is heavy when it has more bytes than a shard's even share, so
    that no shard can hold it. Fewer than ``shards`` groups can be, so the list of them is broadcast.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    heavy = sized.groupBy(group).agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards > total).select(F.col(group).alias("__heavy__"))
    both = sized.join(F.broadcast(heavy), F.col(group) == F.col("__heavy__"), "left")
    dealt = F.pmod(F.xxhash64(group, row), F.lit(slots)).cast("int")
    return both.withColumn("virtual_slot", F.when(F.col("__heavy__").isNull(), F.col("virtual_slot")).otherwise(dealt)).drop("__heavy__")


def slot_bytes(sized: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows), pre-aggregated before the shuffle."""
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map, before any bytes are known: slots in turn."""
    return spark.createDataFrame([(0, slot, slot % shards) for slot in range(slots)], MAP_SCHEMA)


def store_map(current: DataFrame, path: str) -> None:
    """Add one version of the map to the map table at ``path``; versions already there stay."""
    current.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map table at ``path``, the latest by default."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def rebalance(spark: SparkSession, current: DataFrame, slot_sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for ``shards`` shards: an edit that moves as few bytes as it can.

    Shards that no longer exist give up all their slots; then the fullest shard gives its best
    fitting slot to the emptiest, while that lowers the larger of the two. Slots that are not moved
    keep their shard. ``current`` is one version of the map.
    """
    size = {r["virtual_slot"]: r["bytes"] for r in slot_sizes.select("virtual_slot", "bytes").collect()}
    old = current.collect()
    version = max((r["version"] for r in old), default=-1) + 1
    place = {r["virtual_slot"]: r["shard"] for r in old}
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    homeless = []
    for slot, shard in place.items():
        if shard < shards:
            held[shard].add(slot)
            load[shard] += size.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
        to = min(range(shards), key=lambda k: (load[k], k))
        held[to].add(slot)
        load[to] += size.get(slot, 0)
    for _ in range(len(place)):
        high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        fits = [s for s in held[high] if 0 < size.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - size[s]), s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= size[slot]
        load[low] += size[slot]
    return spark.createDataFrame([(version, slot, k) for k in range(shards) for slot in sorted(held[k])], MAP_SCHEMA)


def assign(docs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard from one version of the map (at most SLOTS rows, so it is broadcast). A column named shard is replaced."""
    return docs.drop("shard").join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")


def shard_documents(docs: DataFrame, *, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row's shard under the law ``bytes``, and its gapless place there.

    size is the UTF-8 bytes of the text (null: none) plus 8, text_crc32 the unsigned CRC of those
    bytes (0 for none). A group is a set of equal texts (null and empty are equal): its rows share a
    slot and so a shard, unless the group is heavy (see ``spread_heavy``), which the law ``bytes``
    forbids to keep together. The map is a table at ``map_path`` (by default a new folder in the
    checkpoint folder): version 0 deals the slots in turn, ``rebalance`` edits it by the bytes of the
    slots, and rows are placed by the latest version as it is read back; map_version says which. A
    map that is already there is edited and gets one version more.

    slot counts the rows of a shard from 0 without gaps: the PARTS of its virtual slots are laid one
    after another (a prefix sum over their fixed number) and rows are numbered inside their own part, so neither a shard
    nor a large group is ever sorted in one task. grown_shard is null under this law. Null keys, empty texts and repeated rows
    are ordinary rows; an empty table gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hashed = with_slot(base, text="_text", slots=slots)
    sized = cut(hashed.select("_key", "virtual_slot", F.xxhash64("_text").alias("_group"), F.monotonically_increasing_id().alias("_row"), (F.octet_length("_text") + F.lit(8)).cast("long").alias("size"), F.crc32(F.col("_text").cast("binary")).alias("crc")))
    sized = spread_heavy(sized, group="_group", row="_row", shards=shards, slots=slots)
    parted = sized.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit("part")), F.lit(PARTS)).cast("int"))
    counts = cut(parted.groupBy("virtual_slot", "_part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    if not map_path or not _exists(spark, path):
        store_map(first_map(spark, shards, slots), path)
    store_map(rebalance(spark, read_map(spark, path), slot_bytes(counts), shards), path)
    placed = read_map(spark, path).join(counts, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("virtual_slot", "_part", "shard", "start", "version")
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "_part").orderBy("_key", "crc", "size", "_row"))
    rows = parted.withColumn("place", inside - 1).join(F.broadcast(placed), ["virtual_slot", "_part"])  # slots * PARTS rows at most
    return rows.select(
        F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


__all__ = ["SLOTS", "assign", "first_map", "read_map", "rebalance", "shard_documents", "slot_bytes", "spread_heavy", "store_map", "with_slot"]
