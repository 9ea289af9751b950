"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vintara.llm.common import cut

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 12
#: Items shorter than this (after folding) are found unchanged and as whole words alone: with an edit they would match ordinary prose.
MIN_CHARS = 24
#: Items go to the tasks in blocks of at most so many characters, whatever the size of the benchmark.
BLOCK_CHARS = 4 << 20


def fold(text: str | None) -> str:
    """Lower case, and one space for each run of white space."""
    return " ".join((text or "").lower().split())


def split_item(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece): the item in ``budget`` + 1 pieces of nearly equal length. ``budget`` edits leave one whole."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """Myers' bit vectors for one item: the least edit distance to any substring of a text."""

    def __init__(self, item: str):
        self.size = len(item)
        self.mask = (1 << self.size) - 1
        self.at: dict[str, int] = {}
        for i, ch in enumerate(item):
            self.at[ch] = self.at.get(ch, 0) | 1 << i

    def distance(self, text: str) -> int:
        mask, top = self.mask, 1 << (self.size - 1)
        pv, mv, score = mask, 0, self.size
        least, find = score, self.at.get
        for ch in text:
            eq = find(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least = score
                    if not least:
                        break
            ph = (ph << 1) & mask  # a match may begin anywhere, so no carry comes in
            pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
            mv = ph & xv
        return least


def widen(spans: list[tuple[int, int]], lo: int, hi: int) -> None:
    """Add a span to spans that are in order and apart, and join those it meets. Hits come in order of their ends, so only the last few can be met."""
    after = []
    while spans and spans[-1][1] >= lo:
        a, b = spans.pop()
        if a > hi:
            after.append((a, b))
        else:
            lo, hi = min(a, lo), max(b, hi)
    spans.append((lo, hi))
    spans.extend(reversed(after))


def allowed(item: str, per_edit: int, min_chars: int) -> int:
    """The edits allowed in a folded item."""
    return len(item) // per_edit if len(item) >= min_chars else 0


def _matches(items: list[tuple], per_edit: int, min_chars: int, key_type: pa.DataType, with_text: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        pieces: dict[str, list[tuple[int, int, int]]] = {}
        patterns: dict[int, Pattern] = {}
        for n, (_, item) in enumerate(items):
            for at, piece in split_item(item, allowed(item, per_edit, min_chars)):
                pieces.setdefault(piece, []).append((n, at, len(piece)))
        search = ahocorasick.Automaton()
        for piece, where in pieces.items():
            search.add_word(piece, where)
        search.make_automaton()
        for batch in batches:
            index, found = [], []
            for row, text in enumerate(batch.column(1)):
                folded = fold(text.as_py())
                best: dict[int, int] = {}
                spans: dict[int, list[tuple[int, int]]] = {}
                for end, where in search.iter(folded) if pieces else ():
                    for n, at, size in where:
                        if best.get(n) == 0:
                            continue
                        item = items[n][1]
                        budget = allowed(item, per_edit, min_chars)
                        start = end - size + 1 - at
                        if len(item) < min_chars:
                            if folded[start - 1 : start] in ("", " ") and folded[end + 1 : end + 2] in ("", " "):
                                best[n] = 0
                        elif start >= 0 and folded.startswith(item, start):
                            best[n] = 0
                        elif start >= -budget:  # a match further to the left would begin before the text
                            widen(spans.setdefault(n, []), max(0, start - budget), start + len(item) + budget)
                for n, places in spans.items():
                    if best.get(n) == 0:
                        continue
                    item = items[n][1]
                    pattern = patterns.get(n)
                    if pattern is None:
                        pattern = patterns[n] = Pattern(item)
                    distance = min(pattern.distance(folded[a:b]) for a, b in places)
                    if distance <= allowed(item, per_edit, min_chars):
                        best[n] = distance
                index.append(row)
                found.append([{"item_id": items[n][0], "distance": d} for n, d in sorted(best.items())])
            kind = pa.list_(pa.struct([("item_id", key_type), ("distance", pa.int32())]))
            passed = [k for k in range(batch.num_columns) if with_text or k != 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), pa.array(found, kind)], names=[*(batch.schema.names[k] for k in passed), "matches"])

    return run


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items that are not empty, folded, in blocks of bounded size, fetched by and by; one empty block if there are none."""
    held, size, none = [], 0, True
    for row in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(key, text).toLocalIterator():
        item = fold(row[1])
        if not item:
            continue
        if held and size + len(item) > BLOCK_CHARS:
            yield held
            held, size, none = [], 0, False
        held.append((row[0], item))
        size += len(item)
    if held or none:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with a column matches: the items found in each text, as (item_id, distance) by item_id.

    Texts and items are folded (lower case, white space runs to one space). An item of n characters
    is found when some substring of the text is within n // ``per_edit`` edits of it. By the
    pigeonhole principle one of its n // ``per_edit`` + 1 pieces then occurs unchanged, so exact
    hits of pieces are all the candidates. Each hit has a window that holds any such match (its place
    differs from the piece's by at most the budget); an item's windows that meet are joined, and each
    of the joined windows is verified once with Myers' distance, so no hit is passed over.
    With one block of items (BLOCK_CHARS) documents are never shuffled or written. A larger benchmark
    is worked off block by block: documents are numbered and written once, each block is one pass over
    number and text that returns the matches alone, and these meet the documents in one join at the end. The driver holds a block at a time
    and one partition of the items that are still to come.

    An item shorter than ``min_chars`` is found where it stands unchanged between spaces or the ends
    of the text, with no edits. Null texts and empty texts match nothing; null and empty items and
    items without a key are left out; repeated items count once, with each of their keys. Keys of
    items may be of any type that can be ordered. Rows repeated in
    ``docs`` each get their matches. A column named matches in ``docs`` is replaced.
    """
    keep = [c for c in docs.columns if c != "matches"]
    kind = items.schema[item_key].dataType
    found = f"matches array<struct<item_id:{kind.simpleString()},distance:int>>"
    blocks = _blocks(items, item_key, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        columns = [c for c in keep if c != text]
        slim = docs.select(F.col(columns[0]) if columns else F.lit(1).alias("__one__"), text, *columns[1:])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
        return slim.mapInArrow(_matches(first, per_edit, min_chars, to_arrow_type(kind)), f"{schema}, {found}").select(*keep, "matches")
    whole = cut(docs.select(F.monotonically_increasing_id().alias("__row__"), F.struct(*keep).alias("__kept__")))
    texts = whole.select("__row__", F.col("__kept__")[text].alias("__text__"))
    hits = None
    for block in itertools.chain([first, second], blocks):
        some = cut(texts.mapInArrow(_matches(block, per_edit, min_chars, to_arrow_type(kind), with_text=False), f"__row__ long, {found}").where(F.size("matches") > 0))
        hits = some if hits is None else hits.unionByName(some)
    every = hits.groupBy("__row__").agg(F.sort_array(F.flatten(F.collect_list("matches"))).alias("matches"))
    none = F.array().cast(every.schema["matches"].dataType)
    return whole.join(every, "__row__", "left").select(*[F.col("__kept__")[c].alias(c) for c in keep], F.coalesce("matches", none).alias("matches"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found (see ``find_leaks``), with their columns unchanged."""
    return find_leaks(docs, items, **options).where(F.size("matches") == 0).select(*[c for c in docs.columns])
