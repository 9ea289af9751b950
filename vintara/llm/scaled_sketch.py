"""Document fingerprints: threshold-scaled sketches of word shingles, their merging, and containment between unequal texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut

#: Hashes have so many bits; those below 2**BITS / SCALE are retained.
BITS = 48
SCALE = 16
#: At least so many of a text's smallest hashes are retained, so a short text has a sketch too.
FLOOR = 16
WIDTH = 5
_ALL = 1 << 62

_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, resemblance_edited double, resemblance_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def retained(hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of a set given by its sorted distinct hashes: all below the fraction, and at least the ``floor`` smallest."""
    return hashes[: max(int(np.searchsorted(hashes, (1 << BITS) // scale)), floor)]


def reach(sketch: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> int:
    """Up to where a sketch holds every hash of its set: anywhere for a set below ``floor``, else its largest hash or the fraction."""
    return _ALL if len(sketch) < floor else max(int(sketch[-1]), (1 << BITS) // scale - 1)


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> tuple[float, float]:
    """(containment, resemblance) of two sets, from the hashes in the range that both sketches cover.

    Containment is the share of the smaller side that the other one holds, resemblance that of the
    union. Equal sketches are alike by 1 (two empty ones too), an empty and another one by 0, and so
    are sketches of which one has no hash in the common range.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0, 1.0
    common = min(reach(a, scale, floor), reach(b, scale, floor))
    a, b = (x[: np.searchsorted(x, common, side="right")] for x in (a, b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (shared / min(len(a), len(b)), shared / (len(a) + len(b) - shared)) if shared else (0.0, 0.0)


def sketches_of(texts: list[bytes], width: int, scale: int, floor: int) -> list[np.ndarray]:
    """Sketches of several texts, hashed in stretches of about a megabyte."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    out: list[np.ndarray] = []
    for a, b in textvec.chunks(offsets):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        sets = textvec.shingle_sets(data, offsets[a : b + 1] - offsets[a], width)
        out += [retained(np.unique(s >> np.uint64(64 - BITS)).astype(np.int64), scale, floor) for s in sets]
    return out


def encode(sketch: np.ndarray) -> str:
    """A sketch as text: eight base64 characters a hash, in order."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6).astype(np.int64)
    return raw @ (np.int64(1) << np.arange(40, -1, -8, dtype=np.int64))


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """(key, sketch): the sorted retained hashes of each text's distinct ``width``-word shingles, one row per row of ``docs``.

    Words lie between white space, A-Z count as a-z, a shorter text is one shingle; null, empty and
    blank texts have an empty sketch. Null keys and repeated rows stay as they are, other columns go.
    """
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches_of([(t or "").encode() for t in batch.column(1).to_pylist()], width, scale, floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_key", "sketch"])

    return base.mapInArrow(run, f"_key {base.schema['_key'].dataType.simpleString()}, sketch array<long>").withColumnRenamed("_key", key)


def merged(frame: DataFrame, by: str, *, sketch: str = "sketch", scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """(by, hash) of the sketch of each group's union, in long form: what the members' sketches hold decides it alone.

    Hashes below the fraction are made distinct by a partial aggregation; of the others each group
    needs the ``floor`` smallest, which a ranking limited before its shuffle finds. A group of any
    size is thus never gathered.
    """
    from pyspark.sql import Window

    rows = frame.select(by, F.explode(sketch).alias("hash")).distinct()
    below = rows.where(F.col("hash") < (1 << BITS) // scale)
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("hash"))).where(F.col("_place") <= floor).drop("_place")
    return below.union(first).distinct()


def contained(a: Column, b: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """Share of ``a`` that ``b`` holds, from two sketch columns and in built-in columns alone; null where ``a`` has no hash in the common range."""

    def end(s: Column) -> Column:
        return F.when(F.size(s) < floor, F.lit(_ALL)).otherwise(F.greatest(F.array_max(s), F.lit((1 << BITS) // scale - 1)))

    common = F.least(end(a), end(b))
    mine = F.filter(a, lambda h: h <= common)
    return F.try_divide(F.size(F.array_intersect(mine, b)).cast("double"), F.size(mine))


def _finish(texts: list[str], following: list[str], width: int, scale: int, floor: int, own: list[np.ndarray] | None = None) -> list[list]:
    """The result columns of ``texts``, each with the text that follows it."""
    size = [len(t) for t in texts]
    edited = [(t[: n - n // 3] + f[: n // 3]).encode() for t, f, n in zip(texts, following, size, strict=True)]
    if own is None:
        both = sketches_of([t.encode() for t in texts + following], width, scale, floor)
        mine, later = both[: len(texts)], both[len(texts) :]
    else:
        mine, later = own[:-1], own[1:]
    changed = sketches_of(edited, width, scale, floor)
    near, next_near = ([likeness(x, y, scale, floor) for x, y in zip(mine, other, strict=True)] for other in (changed, later))
    sums = [hashlib.sha256(e).hexdigest() for e in edited]
    return [size, sums, [encode(s) for s in mine], [encode(s) for s in changed], [x[0] for x in near], [x[0] for x in next_near], [x[1] for x in near], [x[1] for x in next_near]]


def _batch(key, kind: pa.DataType, part: int, role: int, texts: list, columns: list[list] | None) -> pa.RecordBatch:
    n = len(texts)
    columns = columns or [[None] * n for _ in _NAMES]
    types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    arrays = [pa.array(key, kind), pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_key", "part", "role", "_text", *_NAMES])


def _in_order(width: int, scale: int, floor: int):
    """Rows of one range, in order, to finished rows (role 0), the last row, whose next one is elsewhere (1), and the first one (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, kept, kind = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            sketches = sketches_of([t.encode() for t in texts], width, scale, floor)
            if kept is None:
                yield _batch([None], kind, part, 2, texts[:1], None)
            else:
                keys, texts, sketches = [kept[0], *keys], [kept[1], *texts], [kept[2], *sketches]
            if len(texts) > 1:
                yield _batch(keys[:-1], kind, part, 0, [None] * (len(texts) - 1), _finish(texts[:-1], texts[1:], width, scale, floor, sketches))
            kept = keys[-1], texts[-1], sketches[-1]
        if kept is not None:
            yield _batch([kept[0]], kind, part, 1, [kept[1]], None)

    return run


def _at_ends(width: int, scale: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, following = (batch.column(k).to_pylist() for k in range(3))
            yield _batch(keys, batch.column(0).type, 0, 0, [None] * len(keys), _finish(texts, following, width, scale, floor))

    return run


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """Fingerprints of every text and of its edited text: a row per row of ``docs``.

    Columns: key, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (containment of the smaller in the larger sketch), resemblance_edited,
    resemblance_next. The edited text has its last floor(n_chars / 3) code points replaced by as many
    of the first ones of the next document (all, if it has fewer).

    The next document is that of the next smaller key; after the last comes the first. Null keys come
    after all others, and rows with one key are in order of a hash of their texts. Texts move once, into ranges of that
    order; a range is read as a stream, and only its first and last row meet those of other ranges.

    Null texts are empty: their fingerprints are empty strings, alike by 1 with another empty one and by 0 with
    others. A single row is its own next one; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    order = (F.col("_key").desc_nulls_last(), F.xxhash64("_text"))
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"_key {kind}, part int, role int, _text string, {_RESULT}"
    told = cut(ranged.mapInArrow(_in_order(width, scale, floor), schema))
    parts = sorted(r["part"] for r in told.where("role = 2").select("part").collect())  # as many as there are ranges
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    first = told.where("role = 2").select(F.col("part").alias("after"), F.col("_text").alias("_following"))
    ends = told.where("role = 1").join(follows, "part").join(first, "after").select("_key", "_text", "_following")
    out = told.where("role = 0").unionByName(ends.mapInArrow(_at_ends(width, scale, floor), schema))
    return out.select(F.col("_key").alias(key), *_NAMES)
