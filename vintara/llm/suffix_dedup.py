"""Repeated-substring removal with suffix order and longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut

#: Length of the substring that anchors a window; longer ones meet fewer accidental repeats, shorter ones are rarer.
GRAM = 128
#: An anchor with more distinct surroundings than this is split by longer shared cores before it is gathered.
HOT = 256
#: Window starts that share one core when an anchor is split.
CORE_STARTS = 34
#: Bytes of text whose suffixes are ordered at a time.
BATCH_BYTES = 1 << 20


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks from 1) of integer keys."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, rank


def suffix_order(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``length`` bytes, ties by place; and the rank of that prefix for each place.

    ``ends`` gives, for each place, where its text stops: a suffix that stops early sorts before its
    extensions and never equals a prefix of another text's end. Ranks of 8 bytes are tripled to
    ranks of 24 bytes and so on (doubled where three ranks do not fit one key); the last step
    overlaps to make exactly ``length``.
    """
    n = len(data)
    place = np.arange(n)
    known = min(8, length)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        at = place + k
        key = (key << np.uint64(8)) | np.where(at < ends, data[np.minimum(at, n - 1)].astype(np.uint64), np.uint64(0))
    rank = _rank(key)[1]
    while known < length:
        parts = 3 if n < 1 << 20 and length > 2 * known else 2
        key = rank
        for k in range(1, parts):
            at = place + min(k * known, length - known)
            key = key * (n + 2) + np.where(at < ends, rank[np.minimum(at, n - 1)], 0)
        rank = _rank(key)[1]
        known = min(length, parts * known)
    return np.argsort(rank, kind="stable"), rank


def longest_previous_factors(order: np.ndarray, common: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the length and source of its longest match that starts earlier (0, -1: none); with ``later``, that starts later.

    ``order`` are the places in suffix order and ``common[r]`` the prefix that the suffixes at ranks
    r - 1 and r share (it may be cut at a length of interest). The longest earlier match of a place
    is with the previous or the next smaller position in suffix order; both are found for all ranks
    at once, by jumping over positions that are not smaller and keeping the least common prefix on
    the way.
    """
    n = len(order)
    place = -order if later else order
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    rank = np.arange(n)
    for side in (-1, 1):
        at = rank + side
        shared = common.copy() if side < 0 else np.concatenate((common[1:], [0]))
        shared[(at < 0) | (at >= n)] = 0
        live = np.flatnonzero(shared > 0)
        while len(live):
            live = live[place[at[live]] > place[live]]
            via = at[live]
            shared[live], at[live] = np.minimum(shared[live], shared[via]), at[via]
            live = live[shared[live] > 0]
        better = np.flatnonzero(shared > length[order])
        length[order[better]], source[order[better]] = shared[better], order[at[better]]
    return length, source


def common_prefixes(text: bytes, order: np.ndarray) -> np.ndarray:
    """Prefixes shared by neighbours in the suffix order of one short text (0 for the first rank)."""
    n = len(text)
    rank, common, h = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    rank[order] = np.arange(n)
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        common[rank[i]] = h
        h = max(h - 1, 0)
    return common


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int, powers: textvec.Powers):
    """Runs of window starts that share an anchor: (anchor place, first start, last start, gram hash).

    ``ends`` gives, for each place, where its text stops; windows never cross it. Every window of
    ``length`` bytes is answered for by its leftmost gram with the least hash, which depends on the
    window's bytes alone; equal windows have equal anchors at equal distances.
    """
    none = np.zeros(0, np.int64)
    n, span = len(data), length - gram + 1
    starts = n - length + 1
    good = np.flatnonzero(np.arange(length, n + 1) <= ends[: max(starts, 0)])
    if not len(good):
        return none, none, none, none.view(np.uint64)
    g = textvec.Rolling(data, powers).windows(gram)
    # upper half: the hash; lower half: the place, so that the least is the leftmost of equal ones
    pad = -len(g) % span
    ranked = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    full = np.concatenate((ranked, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, span)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    where = (np.minimum(right[:starts], left[span - 1 : span - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (where[good[1:]] != where[good[:-1]]) | (good[1:] != good[:-1] + 1))))
    lo, hi = good[new], good[np.concatenate((new[1:], [len(good)])) - 1]
    return where[lo], lo, hi, g[where[lo]]


def _stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of about a megabyte each: some rows, or a part of one long row with the bytes that its windows reach into."""
    for a, b in textvec.chunks(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - begin <= textvec.CHUNK_BYTES:
            yield a, b, begin, end
        else:
            for at in range(begin, end, textvec.CHUNK_BYTES):
                yield a, b, at, min(end, at + textvec.CHUNK_BYTES + length - 1)


def _scan(length: int, gram: int, key: str):
    """(key, text hash, text) to one row per distinct (anchor, surroundings) of a text, with the window starts it covers.

    Surroundings (all bytes of the windows that share an anchor) are named by BLAKE2, so equal names
    are equal bytes. Those that a stretch of text has twice repeat by themselves; they come as rows
    with n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textvec.Powers()
        for batch in batches:
            texts, offsets = textvec.text_buffer(batch.column(2))
            for a, b, first, last in _stretches(offsets, length):
                data = texts[first:last]
                here = np.clip(offsets[a : b + 1], first, last) - first
                at, lo, hi, h = _anchors(data, np.repeat(here[1:], np.diff(here)), length, gram, powers)
                if not len(at):
                    continue
                raw = memoryview(data.tobytes())
                names = b"".join([hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
                around = textvec.combine(np.frombuffer(names, np.uint64), (at - lo).astype(np.uint64))
                row = np.searchsorted(here, lo, side="right") - 1
                pair = textvec.combine(textvec.combine(h, around), row.astype(np.uint64))
                _, one, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(count[inverse] > 1)  # neighbours join into one row
                breaks = np.flatnonzero(np.concatenate(([True], (lo[again][1:] != hi[again][:-1] + 1) | (row[again][1:] != row[again][:-1])))) if len(again) else again
                pick = np.concatenate((one, again[breaks]))
                ends = np.concatenate((one, again[np.concatenate((breaks[1:], [len(again)])) - 1] if len(again) else again))
                n = np.concatenate((count, np.zeros(len(breaks), np.int64)))
                shift = first - offsets[a + row[pick]]  # from places in the stretch to places in the text
                take = pa.array(a + row[pick])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.where(n > 0, x[pick].view(np.int64), 0)) for x in (h, around)),
                        *(pa.array((x + shift).astype(np.int32)) for x in (at[pick], lo[pick], hi[ends])), pa.array(n.astype(np.int32)),
                    ],
                    names=[key, "tkey", "h", "c", "anchor", "lo", "hi", "n"],
                )

    return run


def _excerpts(length: int, gram: int, starts: int):
    """(tkey list of anchors, text) to the surroundings of each anchor; those of hot anchors in pieces keyed by their core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textvec.Powers()
        for batch in batches:
            texts, offsets = textvec.text_buffer(batch.column(0))
            out, held = [[] for _ in range(5)], 0
            for row, anchors in enumerate(batch.column(1)):
                data = texts[offsets[row] : offsets[row + 1]]
                raw, rolling = data.tobytes(), None
                for x in anchors.as_py():
                    h, c, at, lo, hi = x["h"], x["c"], x["anchor"], x["lo"], x["hi"]
                    if not x["hot"]:
                        pieces = [(h, lo, hi)]
                    else:
                        rolling = rolling or textvec.Rolling(data, powers)
                        pieces = []
                        for d in range((at - hi) // starts, (at - lo) // starts + 1):
                            core = rolling.of(np.array([at - d * starts]), np.array([at - (d + 1) * starts + 1 + length]))
                            cell = textvec.combine(textvec.combine(np.array([h], np.int64).view(np.uint64), np.array([d], np.uint64)), core)
                            pieces.append((int(cell.view(np.int64)[0]), max(lo, at - (d + 1) * starts + 1), min(hi, at - d * starts)))
                    for cell, a, b in pieces:
                        for column, value in zip(out, (cell, h, c, at - a, raw[a : b + length]), strict=True):
                            column.append(value)
                        held += b + length - a
                    if held > 8 << 20:
                        yield _piece_batch(out)
                        out, held = [[] for _ in range(5)], 0
            if out[0]:
                yield _piece_batch(out)

    return run


def _piece_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["cell", "h", "c", "back", "piece"])


def _repeats(length: int):
    """Pieces in order of ``cell`` to runs of repeated starts: (h, c, distance of the first before the anchor, starts).

    Pieces of many cells are laid end to end. Equal strings have equal anchors at equal distances,
    so a stretch of starts whose core (the bytes that all its strings share) is unique is left out;
    the rest go into suffix order, and their longest-previous-factor arrays, of earlier and of later
    matches, tell which starts repeat.
    """
    powers = textvec.Powers()

    def judge(rows) -> Iterator[pa.RecordBatch]:
        h, c, back = (np.array(x, np.int64) for x in rows[1:4])
        sizes = np.array([len(x) for x in rows[4]], np.int64)
        data = np.frombuffer(b"".join(rows[4]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        # the starts of a piece in stretches by their distance before the anchor, each with its core
        low, high = (back - (sizes - length)) // CORE_STARTS, back // CORE_STARTS
        owner = np.repeat(np.arange(len(h)), high - low + 1)
        stretch = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[owner]
        first = np.maximum(back[owner] - (stretch + 1) * CORE_STARTS + 1, 0)
        last = np.minimum(back[owner] - stretch * CORE_STARTS, sizes[owner] - length)
        core = begin[owner] + back[owner] - stretch * CORE_STARTS
        rolling = textvec.Rolling(data, powers)
        name = textvec.combine(rolling.of(core, core - CORE_STARTS + 1 + length), stretch.view(np.uint64))
        name = textvec.combine(name, h[owner].view(np.uint64))
        _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(count[inverse] > 1)
        if not len(kept):
            return
        # stretches that meet become one span of text (their places fall as the distance grows)
        new = np.concatenate(([True], (owner[kept][1:] != owner[kept][:-1]) | (stretch[kept][1:] != stretch[kept][:-1] + 1)))
        top = kept[np.flatnonzero(new)]
        low_end = kept[np.concatenate((np.flatnonzero(new)[1:], [len(kept)])) - 1]
        piece, first, last = owner[top], first[low_end], last[top]
        span = last - first + length
        offset = np.cumsum(span) - span
        at = np.arange(span.sum()) - np.repeat(offset, span)
        order, rank = suffix_order(data[at + np.repeat(begin[piece] + first, span)], np.repeat(offset + span, span), length)
        order = order[(at + length <= np.repeat(span, span))[order]]  # the window starts alone, in suffix order
        common = np.concatenate(([0], np.where(rank[order][1:] == rank[order][:-1], length, 0)))
        numbered = np.flatnonzero(at + length <= np.repeat(span, span))
        dense = np.empty(len(at), np.int64)
        dense[numbered] = np.arange(len(numbered))
        repeated = np.zeros(len(at), bool)
        for later in (False, True):
            repeated[numbered] |= longest_previous_factors(dense[order], common, later)[0] >= length
        edge = np.diff(np.concatenate(([0], repeated.astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        which = np.searchsorted(offset, start, side="right") - 1
        away = back[piece[which]] - first[which] - (start - offset[which])
        yield pa.RecordBatch.from_arrays([pa.array(h[piece[which]]), pa.array(c[piece[which]]), pa.array(away.astype(np.int32)), pa.array((stop - start).astype(np.int32))], names=["h", "c", "back", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [[] for _ in range(5)], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for values in zip(*columns, strict=True):
                if held >= BATCH_BYTES and values[0] != rows[0][-1]:
                    yield from judge(rows)
                    rows, held = [[] for _ in range(5)], 0
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                held += len(values[4])
        if rows[0]:
            yield from judge(rows)

    return run


def _remove(length: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = textvec.text_buffer(batch.column(1))
            size, gone, spans, sha, kept = [], [], [], [], []
            for row, found in enumerate(batch.column(2)):
                data = texts[offsets[row] : offsets[row + 1]]
                runs = sorted((x["lo"], x["hi"]) for x in found.as_py() or ())
                joined: list[list[int]] = []
                for lo, hi in runs:
                    if joined and lo <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], hi + length)
                    else:
                        joined.append([lo, hi + length])
                raw, parts, at = data.tobytes(), [], 0
                for lo, hi in joined:
                    parts.append(raw[at:lo])
                    at = hi
                left = b"".join([*parts, raw[at:]])
                size.append(len(raw)), gone.append(len(raw) - len(left)), spans.append(len(joined)), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_starts(base: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(_key, tkey, lo, hi): runs of places in a text where a ``length``-byte string starts that also starts elsewhere.

    ``base`` has _key, _text and tkey, a hash of the text.
    """
    kind = base.schema["_key"].dataType.simpleString()
    found = cut(base.select("_key", "tkey", "_text").mapInArrow(_scan(length, gram, "_key"), f"_key {kind}, tkey long, h long, c long, anchor int, lo int, hi int, n int"))
    inside = found.where("n = 0").select("_key", "tkey", "lo", "hi")
    found = found.where("n > 0")
    shared = found.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    rows = cut(found.join(shared, "h"))
    around = rows.groupBy("h", "c").agg(F.sum("n").alias("total"), F.min(F.struct("_key", "tkey", "anchor", "lo", "hi")).alias("one"))
    around = cut(around)
    several = around.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("total").alias("rarest")).where("kinds > 1 and rarest = 1")
    whole = around.where("total > 1").select("h", "c")
    texts = (
        around.join(several, "h")
        .select("one._key", "one.tkey", F.struct("h", "c", "one.anchor", "one.lo", "one.hi", (F.col("kinds") > HOT).alias("hot")).alias("x"))
        .groupBy("_key", "tkey")
        .agg(F.collect_list("x").alias("anchors"))
        .select(F.col("_key").alias("k"), F.col("tkey").alias("t"), "anchors")
    )
    texts = base.join(texts, base["_key"].eqNullSafe(texts["k"]) & (base["tkey"] == texts["t"])).select("_text", "anchors")
    pieces = texts.mapInArrow(_excerpts(length, gram, CORE_STARTS), "cell long, h long, c long, back int, piece binary")
    # a fixed count: the pieces are few bytes and much work, so small partitions must not be joined
    parts = cut(pieces.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell").mapInArrow(_repeats(length), "h long, c long, back int, starts int"))
    full = rows.join(whole, ["h", "c"]).select("_key", "tkey", "lo", "hi")
    part = rows.join(parts, ["h", "c"]).select("_key", "tkey", (F.col("anchor") - F.col("back")).alias("lo"), (F.col("anchor") - F.col("back") + F.col("starts") - 1).alias("hi"))
    return full.union(part).union(inside)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the table.

    Returns key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), a row for
    each row of ``docs``. All copies go, the first included; strings are judged on the input.

    * Each window is answered for by one anchor, a substring chosen by the window's bytes alone,
      so equal windows meet at equal anchors. Anchors are about 1 in 140 bytes.
    * Anchors that occur once go. Equal surroundings that occur twice settle all their windows.
    * The other surroundings are gathered by anchor, one text of each kind, and put in suffix
      order. Their longest-previous-factor arrays, from the previous and the next smaller position
      of each place, and the same arrays of later matches mark the repeats. An anchor with very
      many different surroundings is first split by longer shared cores.

    A null text counts as empty; texts shorter than ``length`` bytes lose nothing. Null or repeated
    keys are told apart by the text's hash; identical rows are copies of each other. Other columns
    are ignored; an empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("tkey", F.xxhash64("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    runs = repeated_starts(base, length).groupBy("_key", "tkey").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).select(F.col("_key").alias("k"), F.col("tkey").alias("t"), "runs")
    both = base.join(runs, base["_key"].eqNullSafe(runs["k"]) & (base["tkey"] == runs["t"]), "left").select("_key", "_text", "runs")
    out = both.mapInArrow(_remove(length, "_key"), f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_key", key)
