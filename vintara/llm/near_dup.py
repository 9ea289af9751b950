"""MinHash near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut, null_safe
from vintara.llm.graph import components

BANDS, ROWS = 36, 5
#: A pair at the threshold of 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 36, about 6e-7.
BINS = BANDS * ROWS
#: Members of open buckets meet in blocks of about so many, by their signatures.
BLOCK = 4096
#: Members of groups that signatures leave open meet in blocks of about so many, by their full sets.
SET_BLOCK = 1000


def probe_order(bins: int = BINS) -> np.ndarray:
    """For each bin, the order in which an empty bin looks for a full one: an independent random permutation.

    Every document uses the same orders, so two documents borrow from the same bin whenever that
    bin is the first full one for both (optimal densification)."""
    random = np.random.default_rng(20_240_601)
    return np.stack([random.permutation(bins) for _ in range(bins)])


def signature(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted array of distinct hashes (not empty)."""
    bins = order.shape[0]
    where = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    full, low = np.zeros(bins, bool), np.zeros(bins, np.uint64)
    slots = where[first].astype(np.int64)
    full[slots], low[slots] = True, hashes[first]
    gaps = np.flatnonzero(~full)
    if len(gaps):
        probes = order[gaps]
        donor = probes[np.arange(len(gaps)), full[probes].argmax(axis=1)]
        low[gaps] = low[donor] + (gaps.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return textvec.mix(low)


def _describe(width: int, bands: int, rows: int):
    order = probe_order(bands * rows)
    lane = np.arange(bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(2))
            for a, b in textvec.chunks(offsets):
                at = offsets[a : b + 1]
                sets = textvec.shingle_sets(data[at[0] : at[-1]], at - at[0], width)
                size, name, band, low = [], [], [], []
                for s in sets:
                    size.append(len(s))
                    if not len(s):
                        name.append(None), band.append(None), low.append(None)
                        continue
                    name.append(_class_name(s))
                    sig = signature(s, order)
                    keys = lane.copy()
                    for column in sig.reshape(bands, rows).T:
                        keys = textvec.combine(keys, column)
                    band.append(keys.view(np.int64))
                    low.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    names=["_key", "tkey", "n_shingles", "class", "bands", "low"],
                )

    return run


def _class_name(s: np.ndarray) -> bytes:
    """128-bit name of a set of shingles."""
    return int(textvec.mix(s).sum()).to_bytes(8, "big") + int(textvec.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()).to_bytes(8, "big")


def _sets(width: int):
    """(id, class, text) to (id, shingles); rows whose text is not of that class go (a key may stand for several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(2))
            for a, b in textvec.chunks(offsets):
                at = offsets[a : b + 1]
                sets = textvec.shingle_sets(data[at[0] : at[-1]], at - at[0], width)
                names = batch.column(1).slice(a, b - a).to_pylist()
                good = [i for i, s in enumerate(sets) if len(s) and _class_name(s) == names[i]]
                if not good:
                    continue
                flat = np.concatenate([sets[i] for i in good])
                ends = np.concatenate(([0], np.cumsum([len(sets[i]) for i in good]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["id", "shingles"])

    return run


def _by_cell(judge):
    """Run ``judge`` on the rows of each cell; the input is in order of its first column, the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != cells[a]:
                        yield judge(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    return run


def _forest(near, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that join different labels, one for each join; ``near(i)`` gives the rows after i that i is near."""
    labels, found = labels.copy(), []
    for i in range(len(labels)):
        js = near(i)
        for label, j in zip(*np.unique(labels[js], return_index=True), strict=True) if len(js) else ():
            if label != labels[i]:
                found.append((i, js[j]))
                labels[labels == label] = labels[i]
    return found


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def _residual_forest(least: float, threshold: int):
    """In a cell of one bucket: a forest over the members of different components whose sizes and signatures allow a link."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        ids, comp, side, size = (rows.column(c).to_numpy() for c in ("id", "component", "side", "n"))
        sig = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
        same = rows.column("same")[0].as_py()

        def near(i):
            js = np.flatnonzero((comp[i + 1 :] != comp[i]) & (same | (side[i + 1 :] != side[i])) & (100 * np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i]))) + i + 1
            return js[(sig[js] == sig[i]).mean(axis=1) >= least] if len(js) else js

        return _edges(ids, _forest(near, np.arange(len(ids))))

    return _by_cell(judge)


def _residual_links(threshold: int):
    """In a cell of one group: links by the full sets that join different components, enough of them to join all they can."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
        comp = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        same = rows.column("same")[0].as_py()
        sets = rows.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ids)), size)
        _, word, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        shared = count[word] > 1
        owner, word = owner[shared], column[word[shared]]
        order = np.argsort(word, kind="stable")
        owner, word = owner[order], word[order]
        inner = np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
            a, b = np.searchsorted(word, (low, low + 4096))
            has = np.zeros((len(ids), 4096), np.float32)
            has[owner[a:b], word[a:b] - low] = 1
            inner += has @ has.T

        def near(i):
            union = size[i] + size[i + 1 :] - inner[i, i + 1 :]
            return np.flatnonzero((100 * inner[i, i + 1 :] >= threshold * union) & (same | (side[i + 1 :] != side[i]))) + i + 1

        return _edges(ids, _forest(near, comp))

    return _by_cell(judge)


def _in_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """Deal the members of each group into blocks and give pairs of blocks a cell, so that each two of different components meet in one.

    Members of a group's largest component never need to meet each other. So a block of them has
    cells only with the blocks of the other members: a member of the largest component gets a row
    for each block of the others, and one of the others a row for each block of either kind.
    """
    sizes = members.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n_same"))
    largest = sizes.groupBy(group).agg(F.max(F.struct("n_same", "component")).alias("top"), F.sum("n_same").alias("n_all"))
    rest = F.ceil((F.col("n_all") - F.col("top.n_same")) / block).cast("int")
    dealt = members.join(largest.select(group, F.col("top.component").alias("main"), rest.alias("rest"), F.ceil(F.col("top.n_same") / block).cast("int").alias("mains")), group)
    spread, main = F.xxhash64("id", group), F.col("component") == F.col("main")
    dealt = dealt.withColumn("side", F.when(main, F.col("rest") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "rest")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))
    return dealt.withColumn("cell", F.xxhash64(group, F.least("side", "other"), F.greatest("side", "other"))).withColumn("same", F.col("side") == F.col("other"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A & B| >= threshold * |A | B| for their sets of distinct
    ``width``-word shingles (words between white space, A-Z lower-cased; a shorter text is one
    shingle). component_id is the smallest key reachable by links, kept marks the row that has it.

    * Equal sets collapse into one class first, so copies are never paired with each other.
    * Each class gets one key per band; in each bucket only the star around its most central class
      (the one that meets most others over all bands; ties: the smallest) is a candidate, so a
      bucket of n classes gives n - 1 pairs. An original thus becomes the hub of its variants, even
      where these differ too much from each other. Hubs are found by pre-aggregated counts.
    * Every candidate is confirmed on the full sets, and links become components.
    * Stars alone could lose a link between two outer members. So buckets whose members ended in
      different components are visited again: the members outside a bucket's largest component meet
      each other and all of that component, in blocks of bounded size. Members of different
      components whose 8-bit signatures do not rule the threshold out by six standard deviations
      form groups, and each group is compared on the full sets, block by block. A cell returns only
      a forest, so rows stay in proportion to members. No member is capped or dropped.

    Null or empty texts and texts without words have no shingles and link with nothing; their
    component_id is their key. Null keys are allowed (a group with only null keys has a null
    component); texts are found again by key and text, so many null keys cost no more. Rows repeated with one key are nodes by their text, and each gives a row.
    Other columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("tkey"), F.col(text).alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    told = cut(base.mapInArrow(_describe(width, bands, rows), f"_key {kind}, tkey long, n_shingles long, class binary, bands array<long>, low binary"))
    classes = told.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.min("_key").alias("owner"), F.min(F.struct("_key", "tkey")).alias("one"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    member = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).where("members > 1")
    in_bucket = cut(member.join(buckets, "bucket"))
    wide = in_bucket.where("members > 2")
    central = wide.join(wide.groupBy("id").agg(F.sum("members").alias("met")), "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("central"))
    in_bucket = in_bucket.join(central, "bucket", "left").select("bucket", "id", "members", F.coalesce("central", "hub").alias("hub"))
    size = classes.select("id", "n")

    def full_sets(needed: DataFrame) -> DataFrame:
        """(id, shingles) of the classes in ``needed``, computed anew from one text of each."""
        wanted = classes.join(needed, "id", "left_semi").select("id", "class", "one._key", "one.tkey")
        texts = base.join(wanted, null_safe(base, wanted, "_key", "tkey")).select("id", "class", "_text")
        return cut(texts.mapInArrow(_sets(width), "id long, shingles array<long>").dropDuplicates(["id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of the candidate pairs (a, b), those linked by their full sets; sizes are compared first."""
        pairs = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        pairs = cut(pairs.where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b"))
        sets = full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return cut(both.where(100 * shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct())

    links = confirmed(in_bucket.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    final = components(links)

    placed = in_bucket.where("members > 2").join(final.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    spare = 6 * (threshold / 100 * (1 - threshold / 100) / (bands * rows)) ** 0.5
    inside = _in_blocks(placed.join(open_buckets, "bucket"), "bucket", BLOCK).join(classes.select("id", "low", "n"), "id").select("cell", "side", "same", "id", "component", "low", "n")
    near = inside.repartition("cell").sortWithinPartitions("cell").mapInArrow(_residual_forest(max(threshold / 100 - spare, 0.0), threshold), "a long, b long")
    near = cut(near.distinct())
    if not near.isEmpty():
        groups = cut(components(near).select(F.col("node").alias("id"), F.col("component").alias("bucket")))
        groups = groups.join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        inside = _in_blocks(groups, "bucket", SET_BLOCK).join(full_sets(groups.select("id")), "id").select("cell", "side", "same", "id", "component", "shingles")
        more = cut(inside.repartition("cell").sortWithinPartitions("cell").mapInArrow(_residual_links(threshold), "a long, b long"))
        final = components(links.union(more))

    named = classes.select("class", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    lowest = classes.select("class", "owner").join(named, "class").groupBy("component").agg(F.min("owner").alias("lowest"))
    named = named.join(lowest, "component").select("class", "lowest")
    alone = told.where("class is null").select("_key", "n_shingles", F.col("_key").alias("lowest"))  # texts without words meet no one, least of all in one task of a join
    out = told.where("class is not null").select("_key", "n_shingles", "class").join(named, "class").select("_key", "n_shingles", "lowest").unionByName(alone)
    return out.select(F.col("_key").alias(key), "n_shingles", F.col("lowest").alias("component_id"), F.coalesce(F.col("_key") == F.col("lowest"), F.lit(False)).alias("kept"))
