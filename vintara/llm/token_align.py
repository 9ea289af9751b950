"""Aligning the tokens of two tokenizers: components of overlapping byte ranges by pointer jumping, and corpus-wide link counts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut

#: Bytes of text whose links are counted together; a longer text is a stretch of its own.
STRETCH = 8 << 20
#: Distinct units kept aligned between stretches, and their links.
_CACHE, _POOL = 200_000, 4_000_000
_SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteVocabulary:
    """Side A: the byte-level BPE vocabulary of a tokenizer's JSON (ids are in order of merging), and the bytes of every id."""

    def __init__(self, json_path: str, pattern: str):
        import tiktoken

        with open(json_path, encoding="utf-8") as file:
            told = json.load(file)
        added, alphabet = {t["id"] for t in told.get("added_tokens") or ()}, byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, entry)): k for entry, k in told["model"]["vocab"].items() if k not in added}
        self.encoding = tiktoken.Encoding("side_a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, how many each has). Ids stand for bytes as they are, so they always join to the text."""
        found = [self.encoding.encode_ordinary(u) for u in units]
        return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)


class PieceVocabulary:
    """Side B: a sentence-piece model; a piece stands for its text, with U+2581 as space and <0xHH> as one byte."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(n)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        #: Whether units may be encoded apart: no piece goes on behind a space that follows something else.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each unit has, whether its bytes join to the unit); the model itself puts the first space."""
        found = self.model.encode([u[1:] for u in units], num_threads=1)
        true = np.array([b"".join(map(self.bytes_of.__getitem__, f)) == u.encode() for f, u in zip(found, units, strict=True)], bool)
        return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64), true


def label_groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of two tokenizations of the same bytes, given where the tokens end.

    Every token points to the overlapping token that ends farthest to the right (of two that end
    together, that of the first side). Following pointers leads to the last token of a component;
    doubling all pointers at once finds it in as many rounds as the longest chain has binary digits.
    """
    n, m = len(end_a), len(end_b)
    over_a = np.searchsorted(end_b, end_a)  # the token of b that holds the last byte of each token of a
    successor = np.concatenate((np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)), np.searchsorted(end_a, end_b))) if n and m else np.arange(n + m)
    while True:
        further = successor[successor]
        if (further == successor).all():
            break
        successor = further
    _, group = np.unique(successor, return_inverse=True)  # terminal tokens are of side a, in order
    return group[:n], group[n:]


class Aligner:
    """Distinct units of texts, aligned once each: counts, the groups as text, and links as pair codes in a pool."""

    def __init__(self, a: ByteVocabulary, b: PieceVocabulary):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.n = np.zeros((0, 4), np.int64)  # tokens of a, tokens of b, groups, links; no tokens where the bytes differ
        self.first = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int64)
        self.named = np.zeros(0, object)

    def align(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(counts, links of all units in a row, groups of each as text)."""
        ids_b, many_b, true = self.b.ids(units)
        ids_b = ids_b[np.repeat(true, many_b)]
        good = [u for u, t in zip(units, true.tolist(), strict=True) if t]
        ids_a, many_a = self.a.ids(good)
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        group_a, group_b = label_groups(end_a, end_b)
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        at_a, at_b = (np.searchsorted(g, np.arange(groups + 1)).tolist() for g in (group_a, group_b))
        named = [f"{','.join(text_a[at_a[g] : at_a[g + 1]])}|{','.join(text_b[at_b[g] : at_b[g + 1]])}" for g in range(groups)]
        stops = np.union1d(end_a, end_b)  # between two stops lie the bytes that one pair of tokens shares
        links = (ids_a[np.searchsorted(end_a, stops)] << _SHIFT) | ids_b[np.searchsorted(end_b, stops)] if len(stops) else np.zeros(0, np.int64)
        edge = np.cumsum([len(u.encode()) for u in good], dtype=np.int64)  # where units end, all tokens end
        last_group = group_a[np.searchsorted(end_a, edge)] + 1 if len(edge) else edge
        last_link = np.searchsorted(stops, edge, side="right")
        counts = np.zeros((len(units), 4), np.int64)
        counts[true] = np.stack((many_a, many_b[true], np.diff(last_group, prepend=0), np.diff(last_link, prepend=0)), axis=1)
        bounds = [0, *last_group.tolist()]
        texts = iter([";".join(named[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
        return counts, links, [next(texts) if t else "" for t in true.tolist()]

    def known(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of several distinct units (``hashes`` in order), the new ones aligned in one go."""
        if len(self.hashes) > _CACHE or len(self.pool) > _POOL:
            self.forget()
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[where] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            counts, links, named = self.align([raw[x:y].decode() for x, y in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            first = len(self.pool) + np.cumsum(counts[:, 3]) - counts[:, 3]
            every = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(every)
            names = np.empty(len(named), object)
            names[:] = named
            self.hashes, self.n, self.first = every[order], np.concatenate((self.n, counts))[order], np.concatenate((self.first, first))[order]
            self.named, self.pool = np.concatenate((self.named, names))[order], np.concatenate((self.pool, links))
            where = np.searchsorted(self.hashes, hashes)
        return where


_MIXED = r" \s|\s "


def _units(texts: list[str], apart: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Units of several texts, each with a space before it: (bytes, start, stop, row). Empty texts have none.

    A space between two characters that are not white space begins a token on both sides, so texts
    with such spaces alone are cut at each; others are one unit.
    """
    import re

    mixed = re.compile(_MIXED)
    spaced = [" " + t if t else "" for t in texts]
    raw = [t.encode() for t in spaced]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    joined = b"".join(raw)
    whole = np.array([not apart or t[-1:].isspace() or bool(mixed.search(t)) for t in spaced], bool)
    first = np.frombuffer(joined, np.uint8) == 0x20
    start = np.flatnonzero(first)
    row = np.searchsorted(ends, start, side="right")
    opens = np.concatenate(([0], ends[:-1]))[row] == start
    used = opens | ~whole[row]
    start, row = start[used], row[used]
    stop = np.concatenate((start[1:], [len(joined)])) if len(start) else start
    return joined, start, stop, row


def _stretch(aligner: Aligner, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
    """(counts of each text, digest of its groups, its distinct linked pairs as (row, pair, occurrences))."""
    rows = len(texts)
    joined, start, stop, row = _units(texts, aligner.b.apart)
    data = np.frombuffer(joined, np.uint8)
    hashes, one, which = np.unique(textvec.hash_spans(data, start, stop), return_index=True, return_inverse=True)
    where = aligner.known(hashes, joined, start[one], stop[one])
    bad = np.zeros(rows, bool)
    np.logical_or.at(bad, row, (aligner.n[where, 0] == 0)[which])
    counts = np.stack([np.bincount(row, weights=aligner.n[where, k][which], minlength=rows) for k in range(4)], axis=1).astype(np.int64)
    counts[bad] = 0
    names = aligner.named[where][which]
    bounds = np.searchsorted(row, np.arange(rows + 1)).tolist()
    digests = [hashlib.sha256(";".join(names[x:y].tolist()).encode()).hexdigest() if y > x and not b else "" for x, y, b in zip(bounds[:-1], bounds[1:], bad.tolist(), strict=True)]
    # distinct units of each text first, then their links
    units = len(hashes)
    code, times = np.unique((row * units + which)[~bad[row]], return_counts=True)
    text_of, unit = code // max(units, 1), where[code % max(units, 1)]
    each = aligner.n[unit, 3]
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    pairs, local = np.unique(aligner.pool[np.repeat(aligner.first[unit], each) + inner], return_inverse=True)
    code, back = np.unique(np.repeat(text_of, each) * len(pairs) + local, return_inverse=True)
    total = np.bincount(back, weights=np.repeat(times, each), minlength=len(code)).astype(np.int64)
    return counts, digests, (code // max(len(pairs), 1), code % max(len(pairs), 1), total, pairs)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_TOLD = "stretch long, {} n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs binary, docs binary"


def _describe(paths: tuple[str, str, str] | None, size: int):
    """(key, text) to a row for each text, and one for each stretch with its distinct pairs and in how many of its texts each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public
        from pyspark import TaskContext

        a_json, a_pattern, b_model = paths or (public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
        aligner = Aligner(ByteVocabulary(a_json, a_pattern), PieceVocabulary(b_model))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = textvec.text_buffer(batch.column(1))
            for low, high in textvec.chunks(offsets, size):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                counts, digests, (row, place, total, pairs) = _stretch(aligner, texts)
                n = len(texts)
                cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
                places, times = place.astype("<u4").tobytes(), total.astype("<u4").tobytes()
                parts = [[blob[4 * x : 4 * y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)] for blob in (places, times)]
                docs = np.bincount(place, minlength=len(pairs)).astype("<u4").tobytes()
                keys = pa.concat_arrays([batch.column(0).slice(low, n), pa.nulls(1, batch.column(0).type)])
                columns = [pa.array([number] * (n + 1), pa.int64()), keys, *(pa.array([*counts[:, k].tolist(), None], pa.int64()) for k in range(4)), pa.array([*digests, None], pa.string())]
                columns += [pa.array([*p, None], pa.binary()) for p in parts] + [pa.array([None] * n + [x], pa.binary()) for x in (pairs.astype("<i8").tobytes(), docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["stretch", "_key", *_COUNTS, "groups_sha256", "places", "times", "pairs", "docs"])
                number += 1

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stretch, pairs, docs) to (stretch, place, pair, docs)."""
    for batch in batches:
        for stretch, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair, many = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), stretch)), pa.array(np.arange(len(pair))), pa.array(pair), pa.array(many)], names=["stretch", "place", "pair", "docs"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches in order, first the pairs of each by place (count, best), then its texts: (key, counts, n_best, count_sum, digest)."""
    at, counts, bests = None, [], []
    table = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        stretch, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(stretch) != 0) | (np.diff(is_text) != 0)) + 1), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high == low:
                continue
            part = batch.slice(low, high - low)
            if stretch[low] != at:
                at, counts, bests = stretch[low], [], []
                table = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not is_text[low]:
                counts.append(part.column(3).to_numpy())
                bests.append(part.column(4).to_numpy())
                continue
            if counts:
                table, counts, bests = (np.concatenate(counts), np.concatenate(bests)), [], []
            sums = [[], []]
            for places, times in zip(part.column("places").to_pylist(), part.column("times").to_pylist(), strict=True):
                place, time = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
                sums[0].append(int(time @ table[1][place]))
                sums[1].append(int(time @ table[0][place]))
            columns = [part.column("_key"), *(part.column(c) for c in _COUNTS), *(pa.array(s, pa.int64()) for s in sums), part.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(occurrences: DataFrame) -> DataFrame:
    """(pair, count, best) of (pair, docs) rows: documents that hold each pair, and whether no other pair of its first id has more."""
    counted = cut(occurrences.groupBy("pair").agg(F.sum("docs").alias("count")))
    first = F.shiftright("pair", _SHIFT)
    most = counted.groupBy(first.alias("first")).agg(F.max("count").alias("most"))
    return counted.join(most, first == F.col("first")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str, str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text is encoded with a space before it, on side A by a byte-level BPE vocabulary (special
    tokens are plain text) and on side B by a sentence-piece model. Tokens of the two sides whose
    byte ranges overlap are linked; a group is a run of bytes at whose ends both sides end a token,
    found by pointer jumping (``label_groups``). A pair of ids counts the documents of the whole table that
    hold it linked; n_best are the links whose pair has the highest count of its A id (ties included),
    count_sum is the sum of counts over links. groups_sha256 digests ``a1,a2|b1;a3|b2,b3``.

    Each distinct unit of a stretch of text is aligned once. A stretch (``stretch`` bytes, or one
    longer text) sends each of its distinct pairs once to be counted and once to fetch the count, so a pair that
    stands in every document costs a row a stretch and no task gathers it. Then the texts of a
    stretch, as sparse rows of places and numbers, meet the counts of its pairs.

    Null or empty texts, and texts whose tokens do not join to their bytes (U+2581 in them), have no
    tokens: numbers are 0 and the digest is ''. Null keys and repeated rows stay, each a document
    of its own; other columns are ignored; an empty table gives no rows. ``tokenizers`` names the
    JSON of A, its pre-token pattern and the model of B.
    """
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = f"_key {base.schema['_key'].dataType.simpleString()},"
    told = cut(base.mapInArrow(_describe(tokenizers, stretch), _TOLD.format(kind)))
    occurrences = told.where("pairs is not null").select("stretch", "pairs", "docs").mapInArrow(_listed, "stretch long, place long, pair long, docs long")
    fetched = occurrences.join(pair_counts(occurrences.select("pair", "docs")), "pair").select("stretch", F.lit(0).alias("is_text"), "place", "count", "best")
    texts = told.where("pairs is null").drop("pairs", "docs").withColumn("is_text", F.lit(1))
    both = fetched.unionByName(texts, allowMissingColumns=True).select("stretch", "is_text", "place", "count", "best", "_key", *_COUNTS, "groups_sha256", "places", "times")
    met = both.repartition("stretch").sortWithinPartitions("stretch", "is_text", "place")
    out = met.mapInArrow(_summed, f"{kind} n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("_key", key)
