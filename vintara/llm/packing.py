"""Packing token sequences as vector bins: tokens, segments and loss-bearing tokens are limited at once."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut

#: Pieces that are placed together; a group is one call of the heuristic.
GROUP = 4096
#: Sequences filled whole by one piece are numbered from here, so they never meet the packed ones.
WHOLE = 1 << 62
_CACHE = 300_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: First bytes of white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def added_tokens(json_path: str) -> re.Pattern | None:
    """A pattern of the strings of a tokenizer's added tokens; of the file only that list is parsed."""
    with open(json_path, encoding="utf-8") as file:
        text = file.read()
    name = re.search(r'"added_tokens"\s*:\s*', text)
    added = [t["content"] for t in json.JSONDecoder().raw_decode(text, name.end())[0] or ()] if name else []
    return re.compile("|".join(map(re.escape, added))) if added else None


class ByteBpe:
    """Ids of a byte-level BPE vocabulary given twice: as a tokenizer's JSON, which decides, and as merge ranks, which are faster.

    The ranks (tiktoken's file format) have no added tokens, so a text that holds the string of one
    goes through the JSON's tokenizer. In all others a single space before a word always begins a
    new pre-token, so a text can be cut there and each distinct unit encoded once (``units``). Texts
    with other white space beside a space, or at their end, are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path, self.tokenizer = json_path, None  # loaded when a text needs it
        self.added = added_tokens(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.mixed_space = re.compile(r" \s|\s ")
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]
        self.forget()

    def forget(self) -> None:
        """Units known so far: their hashes in order, and where the ids of each stand in the pool."""
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def plain(self, text: str) -> bool:
        """Whether every space of a text is one space before a word, so that the text may be cut there."""
        return not (self.mixed_space.search(text) or text[-1:].isspace())

    def units(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, pool): where the ids of each of several distinct units stand in the pool; ``hashes`` are in order.

        Units that are not known yet are encoded in one call where they begin with a space; the
        bytes of the ids tell where each unit ends.
        """
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[where] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            joined = np.array([raw[k] == 0x20 for k in start[new].tolist()], bool)
            lot, single = new[joined], new[~joined]
            pieces = [raw[a:b] for a, b in zip(start[lot].tolist(), stop[lot].tolist(), strict=True)]
            ids = np.array(self.encoding.encode_ordinary(b"".join(pieces).decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(stop[lot] - start[lot]), side="right")
            alone = [np.array(self.encoding.encode_ordinary(raw[a:b].decode()), np.uint32) for a, b in zip(start[single].tolist(), stop[single].tolist(), strict=True)]
            size = np.concatenate((np.diff(ends, prepend=0), [len(x) for x in alone])).astype(np.int64)
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate((self.pool, ids, *alone))
            every = np.concatenate((self.hashes, hashes[lot], hashes[single]))
            order = np.argsort(every)
            self.hashes, self.at, self.size = every[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
            where = np.searchsorted(self.hashes, hashes)
        got = self.at[where], self.size[where], self.pool
        if len(self.hashes) > _CACHE:
            self.forget()
        return got

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, in the same form."""
        if self.added and self.added.search(text):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.json_path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


def _near_space(data: np.ndarray) -> np.ndarray:
    """Places of spaces that stand, or may stand, beside other white space; the Unicode kinds have two or three bytes."""
    n = len(data)
    wide = np.zeros(n + 6, np.uint8)
    wide[3 : n + 3] = data
    space = np.flatnonzero(data == 0x20)
    after, before, two, three = (wide[space + 3 + k] for k in (1, -1, -2, -3))
    return space[_WHITE[after] | _WHITE[before] | _LEAD[after] | (two == 0xC2) | (_LEAD[three] & (three != 0xC2))]


def _encode(bpe: ByteBpe, texts: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of several texts, each with the end id: all ids in a row, and where each text's begin and stop.

    Texts in which every space begins a pre-token are cut at their spaces, and each distinct unit of
    the stretch is encoded once. Other texts are encoded whole.
    """
    rows = len(offsets) - 1
    raw = texts.tobytes()
    part = lambda k: raw[offsets[k] : offsets[k + 1]].decode()
    odd = np.zeros(rows, bool)
    odd[np.searchsorted(offsets, _near_space(texts), side="right") - 1] = True
    some = np.flatnonzero(np.diff(offsets) > 0)
    odd[some[_WHITE[texts[offsets[some + 1] - 1]] | (texts[offsets[some + 1] - 1] >= 0x80)]] = True
    odd = np.array([o and not bpe.plain(part(k)) for k, o in enumerate(odd)])
    if bpe.added is not None and bpe.added.search(raw.decode()):
        odd |= np.array([bool(bpe.added.search(part(k))) for k in range(rows)])
    first = texts == 0x20
    first[offsets[:-1][offsets[:-1] < len(texts)]] = True
    start = np.flatnonzero(first)
    stop = np.concatenate((start[1:], [len(texts)])) if len(start) else start
    row = np.searchsorted(offsets, start, side="right") - 1
    used = ~odd[row]
    start, stop, row = start[used], stop[used], row[used]
    hashes, one, which = np.unique(textvec.hash_spans(texts, start, stop), return_index=True, return_inverse=True)
    at, size, pool = bpe.units(hashes, raw, start[one], stop[one])
    whole = {k: bpe.ids(part(k)) for k in np.flatnonzero(odd).tolist()}
    each = size[which]
    count = np.bincount(row, weights=each, minlength=rows).astype(np.int64)
    for k, ids in whole.items():
        count[k] = len(ids) >> 2
    bounds = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.full(int(bounds[-1]), end, "<u4")
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    before = np.cumsum(each) - each  # units of a text follow one another
    base = bounds[row] + before - before[np.searchsorted(row, row)] if len(row) else before
    out[np.repeat(base, each) + inner] = pool[np.repeat(at[which], each) + inner]
    for k, ids in whole.items():
        out[bounds[k] : bounds[k] + count[k]] = np.frombuffer(ids, "<u4")
    return out, bounds


def _pieces(paths: tuple[str, str, str] | None, end_id: int, size: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = ByteBpe(*(paths or (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)))
        for batch in batches:
            texts, offsets = textvec.text_buffer(batch.column(1))
            for a, b in textvec.chunks(offsets):
                here = offsets[a : b + 1] - offsets[a]
                ids, bounds = _encode(bpe, texts[offsets[a] : offsets[b]], here, end_id)
                total = np.diff(bounds)
                pieces = -(-total // size)
                row = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(total[row] - start, size)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[x:y]) for x, y in zip((4 * (bounds[row] + start)).tolist(), (4 * (bounds[row] + start + length)).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Cut each document's ids (its byte-level BPE ids, then ``end_id``) every ``size`` ids.

    Returns key, start, length, ids_crc32 and doc_tokens for each piece; the ids themselves are not
    moved. Ids are those of the ``tokenizers`` library with its defaults and without special tokens
    of its own, so a special token's string in a text is that token. A null text is empty and gives
    the end id alone. The default vocabulary is the public one with 50,257 ids; another is given by
    ``tokenizer``, the paths of its JSON and of its ranks, and its pre-token pattern.
    """
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    return base.mapInArrow(_pieces(tokenizer, end_id, size, "_key"), f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("_key", key)


#: What closed a sequence: its items ran out, or for all that remained the first of these limits that leaves none room.
CLOSED_BY = ("end", "tokens", "segments", "loss")


def place(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins for items with several sizes each (rows of ``sizes``) under several limits: (bin, order within it, which limit closed it).

    One bin is open at a time. Of the items that still fit, the one whose sizes have the greatest
    weighted dot product with the room left is taken (ties: the larger one, then the earlier one); a
    dimension weighs as much as the items need of it together. When none fits the next bin opens. Every item must fit
    an empty bin.
    """
    kinds, kind_of, left_of_kind = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kinds, left_of_kind = kinds[::-1], left_of_kind[::-1].copy()  # items of one size are alike: largest first
    order = np.argsort(len(kinds) - 1 - kind_of.ravel(), kind="stable")
    taken = np.cumsum(left_of_kind) - left_of_kind
    share = kinds / limits
    scaled = share * (share * left_of_kind[:, None]).sum(axis=0)
    first = -kinds[:, 0]
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    at, left, filled = 0, limits.astype(np.float64), 0
    closed = np.zeros(len(sizes), np.int8)
    for _ in range(len(sizes)):
        while True:
            low = np.searchsorted(first, -left[0])  # kinds before have too many tokens
            fits = left_of_kind[low:] > 0
            for k in range(1, sizes.shape[1]):
                fits &= kinds[low:, k] <= left[k]
            score = np.where(fits, scaled[low:] @ (left / limits), -1.0)
            best = low + int(score.argmax()) if len(score) else 0
            if len(score) and score[best - low] >= 0:
                break
            if not filled:
                raise ValueError("an item exceeds the limits of an empty bin")
            room = left_of_kind > 0
            for k in range(sizes.shape[1]):
                room &= kinds[:, k] <= left[k]
                if not room.any():
                    closed[at] = 1 + k
                    break
            at, left, filled = at + 1, limits.astype(np.float64), 0
        item = order[taken[best]]
        taken[best] += 1
        left_of_kind[best] -= 1
        bins[item], places[item] = at, filled
        left = left - kinds[best]
        filled += 1
    return bins, places, closed[bins]


def _pack(limits: tuple[int, ...], columns: int):
    """Rows in order of their group to (everything but the group, sequence_id, offset, closed_by)."""
    caps = np.array(limits, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            group = whole.column("__group__")[0].as_py()
            sizes = np.stack([whole.column(c).to_numpy() for c in ("__tokens__", "__segments__", "__loss__")], axis=1)
            bins, places, closed = place(sizes, caps)
            order = np.lexsort((places, bins))
            length = sizes[order, 0]
            run_up = np.cumsum(length) - length
            first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
            offset = run_up - np.repeat(run_up[first], np.diff(np.concatenate((np.flatnonzero(first), [len(order)]))))
            kept = whole.drop_columns(["__group__"]).take(pa.array(order))
            kept = kept.append_column("sequence_id", pa.array(group * (1 << 20) + bins[order])).append_column("offset", pa.array(offset)).append_column("closed_by", pa.array([CLOSED_BY[k] for k in closed[order].tolist()], pa.string()))
            return kept.combine_chunks().to_batches()[0]

        for batch in batches:
            groups = batch.column(batch.schema.get_field_index("__group__")).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)])) if len(groups) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and held[-1].column("__group__")[0].as_py() != groups[a]:
                    yield finish(held)
                    held = []
                held.append(part)
        if held:
            yield finish(held)

    return run


def pack(items: DataFrame, *, tokens: str = "tokens", segments: str | None = None, loss: str | None = None, max_tokens: int = 2048, max_segments: int = 128, max_loss: int = 2048) -> DataFrame:
    """Give every row of ``items`` a sequence_id, an offset there and what closed the sequence, under three limits at once.

    ``tokens``, ``segments`` (default one a row) and ``loss`` (loss-bearing tokens, default all) are
    integer columns; nulls count as 0. Rows are dealt at random (by a hash of all columns and their
    place, so copies spread) into groups of about GROUP and each group is packed on its own, a few
    to a task, so the work is linear and no group grows with the data; a group leaves at most its last bins part
    empty. A row that exceeds a limit alone raises an error rather than being cut or dropped. Other
    columns pass through. An empty table gives no rows.
    """
    one = F.lit(1).cast("long")
    fixed = items.select(
        *items.columns,
        F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__tokens__"),
        (F.coalesce(F.col(segments).cast("long"), F.lit(0)) if segments else one).alias("__segments__"),
        (F.coalesce(F.col(loss).cast("long"), F.lit(0)) if loss else F.coalesce(F.col(tokens).cast("long"), F.lit(0))).alias("__loss__"),
        F.monotonically_increasing_id().alias("__row__"),
    )
    fixed = cut(fixed)
    groups = max(1, -(-fixed.count() // GROUP))
    dealt = fixed.withColumn("__group__", F.pmod(F.xxhash64("__row__"), F.lit(groups))).drop("__row__")
    names = [c for c in dealt.columns if c != "__group__"]
    schema = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long, closed_by string"
    packed = dealt.repartition(max(1, min(20_000, -(-groups // 4))), "__group__").sortWithinPartitions("__group__", F.desc("__tokens__")).mapInArrow(_pack((max_tokens, max_segments, max_loss), len(names)), schema)
    return packed.select(*items.columns, "sequence_id", "offset", "closed_by")


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 2048, max_segments: int | None = None, max_loss: int | None = None, end_id: int = 1, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Tokenise, cut and pack documents: key, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, closed_by a piece.

    A token bears loss if something stands before it in its sequence's piece of the document, so a
    piece has one loss-bearing token less than tokens. ``max_segments`` and ``max_loss`` limit the
    pieces and the loss-bearing tokens of a sequence beside its tokens; by default both are ``size``, which
    leaves it to the tokens alone, as a corpus of very short documents needs. Below that they act: documents are cut so that
    each piece obeys the loss limit, and a piece that reaches it is a sequence of its own. closed_by tells what ended a sequence (see
    CLOSED_BY). Null keys, repeated rows and extra columns are as in ``token_pieces``.
    """
    max_loss = size if max_loss is None else max_loss
    max_segments = size if max_segments is None else max_segments
    cut_at = min(size, max_loss + 1)
    pieces = token_pieces(docs, key=key, text=text, size=cut_at, end_id=end_id, tokenizer=tokenizer).withColumn("loss_tokens", F.col("length") - 1)
    pieces = cut(pieces)
    alone = F.col("length") == cut_at
    whole = pieces.where(alone).withColumn("sequence_id", F.lit(WHOLE) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("closed_by", F.lit("loss" if cut_at < size else "tokens"))
    rest = pack(pieces.where(~alone), tokens="length", loss="loss_tokens", max_tokens=size, max_segments=max_segments, max_loss=max_loss)
    return whole.unionByName(rest)
