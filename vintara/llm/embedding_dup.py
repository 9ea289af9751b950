"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact cosines only where they can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import cut
from vintara.llm.graph import components

#: Vectors of one block; a tile is a pair of blocks.
BLOCK = 4096
#: Rows of a block that are multiplied at a time, which bounds the product held in memory.
STRIP = 512
#: Room for the rounding of the bound's own arithmetic.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 with a scale each: (codes, scale, length of the decoded vector, length of the error)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


def possible(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose true cosine may reach ``threshold``, for two results of ``quantise``.

    x . y = x' . y' + x' . e_y + e_x . y' + e_x . e_y, so by Cauchy and Schwarz the true product
    exceeds the decoded one by |x'||e_y| + |e_x||y'| + |e_x||e_y| at most. Products of int8 codes
    are exact in float32 below 1,000 dimensions; longer vectors are summed in float64.
    """
    kind = np.float32 if a[0].shape[1] <= 1000 else np.float64
    product = a[0].astype(kind) @ b[0].astype(kind).T
    reach = product * a[1][:, None].astype(np.float32)
    reach *= b[1][None, :].astype(np.float32)
    # float32 scaling and bounds err by less than 4e-6 together for unit vectors
    reach += np.outer(a[2] + a[3], b[3]).astype(np.float32) + np.outer(a[3], b[2]).astype(np.float32)  # each pair's own bound
    rows, cols = np.nonzero(reach >= np.float32(threshold - SLACK - 4e-6))
    return rows, cols


def _vectors(key: str, kind: str):
    """(key, values) to (key, raw little-endian numbers of type ``kind``) with null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            for value in column:
                values = value.values
                ok = values is not None and len(values) and not values.null_count
                raw = values.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                ok = ok and np.isfinite(raw).all() and raw.any()
                out.append((raw + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "raw"])

    return run


def _tiles(threshold: float, kind: str):
    """Rows in order of their tile to (class a, class b, weight b): the links of a, summed, and a forest over linked classes.

    Output rows: (id, links, other): ``links`` counts vectors of other classes that ``id`` is linked
    with in this tile; ``other`` is not null in rows that are edges of the forest instead.
    """

    def unit_rows(raw: list[bytes]) -> np.ndarray:
        values = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
        values = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow in the norm
        return values / np.linalg.norm(values, axis=1, keepdims=True)

    def judge(rows: pa.Table) -> pa.RecordBatch:
        dims = rows.column("dims").to_numpy()
        ids, side, weight = (rows.column(c).to_numpy() for c in ("id", "side", "weight"))
        raw = rows.column("raw").to_pylist()
        same = rows.column("same")[0].as_py()
        links, edges = np.zeros(len(ids), np.int64), []
        labels = np.arange(len(ids))
        for d in np.unique(dims):
            mine = np.flatnonzero(dims == d)
            sides = np.unique(side[mine])
            left = mine if same else mine[side[mine] == sides[0]]
            right = mine if same else mine[side[mine] != sides[0]]
            if not len(left) or not len(right):
                continue
            x = unit_rows([raw[i] for i in left])
            y = x if same else unit_rows([raw[i] for i in right])
            qx = quantise(x)
            qy = qx if same else quantise(y)
            for low in range(0, len(left), STRIP):
                for at in range(low if same else 0, len(right), STRIP):
                    i, j = possible(tuple(v[low : low + STRIP] for v in qx), tuple(v[at : at + STRIP] for v in qy), threshold)
                    i, j = i + low, j + at
                    if same:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    close = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= threshold
                    i, j = left[i[close]], right[j[close]]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    while len(i):  # a forest: join labels until every link is inside one
                        apart = labels[i] != labels[j]
                        i, j = i[apart], j[apart]
                        if not len(i):
                            break
                        _, first = np.unique(np.maximum(labels[i], labels[j]), return_index=True)
                        for k in first:
                            a, b = labels[i[k]], labels[j[k]]
                            if a != b:
                                edges.append((ids[i[k]], ids[j[k]]))
                                labels[labels == max(a, b)] = min(a, b)
        some = np.flatnonzero(links)
        a = np.concatenate((ids[some], np.array([e[0] for e in edges], np.int64)))
        n = np.concatenate((links[some], np.zeros(len(edges), np.int64)))
        other = pa.array([None] * len(some) + [int(e[1]) for e in edges], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), other], names=["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tiles = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), len(tiles)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != tiles[a]:
                        yield judge(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def embedding_duplicates(vectors: DataFrame, *, key: str = "vec_id", value: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Two vectors of the same length are linked when their cosine in double precision is at least
    ``threshold`` (above 0). Equal vectors fall into one class first. Classes are dealt into blocks
    of about ``block``, every two blocks meet in one tile, and a tile multiplies int8 codes; only
    pairs that the quantisation bound leaves open are computed in full precision. A tile returns
    one count for each vector and a forest of links, never its pairs, so a large group of
    near-equal vectors does not square the output. All pairs are compared: the work grows with the
    square of the classes and each class is sent to classes / ``block`` tiles.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    n_links is 0 and component_id their key. Null keys are allowed and never the smallest of a
    component that has another. Rows repeated with one key count as vectors of their own. Other
    columns are ignored; an empty table gives no rows.
    """
    base = vectors.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    kind = base.schema["_key"].dataType.simpleString()
    single = base.schema["_value"].dataType.elementType.typeName() == "float"
    number = "<f4" if single else "<f8"  # single-precision values travel as such; cosines are of doubles either way
    told = cut(base.mapInArrow(_vectors("_key", number), f"_key {kind}, raw binary"))
    classes = told.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("weight"), F.min("_key").alias("owner"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    blocks = max(1, -(-classes.count() // block))
    dealt = classes.select("id", "weight", "raw", (F.octet_length("raw") / (4 if single else 8)).cast("int").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("side"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tile = F.least("side", "other") * F.lit(blocks).cast("long") + F.greatest("side", "other")
    tiles = dealt.select(tile.alias("tile"), "id", "side", (F.col("side") == F.col("other")).alias("same"), "weight", "dims", "raw")
    spread = tiles.repartition(max(1, min(blocks * (blocks + 1) // 2, 20_000)), "tile").sortWithinPartitions("tile")
    found = cut(spread.mapInArrow(_tiles(threshold, number), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.select("raw", "id", "weight", "owner").join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("owner").alias("lowest"))
    named = named.join(lowest, "component").select("raw", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "lowest")
    alone = told.where("raw is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("lowest"))  # they meet no one, least of all in one task of a join
    out = told.where("raw is not null").join(named, "raw").select("_key", F.col("n_links").cast("long").alias("n_links"), "lowest").unionByName(alone)
    return out.select(F.col("_key").alias(key), "n_links", F.col("lowest").alias("component_id"), F.coalesce(F.col("_key") == F.col("lowest"), F.lit(False)).alias("kept"))
