"""Chat transcripts: a hidden Markov model over speaker markers and line features finds the roles, then turns are rendered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import cut

ROLES = ("system", "user", "assistant")
#: Names that mark a speaker at the start of a line.
MARKER_NAMES = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "prompter"),
    "assistant": ("assistant", "bot", "ai", "model", "answer", "a", "agent"),
}
#: States: the first line of a turn of each role, then a further line of each role.
STATES = 2 * len(ROLES)
LENGTHS = 10
#: Shapes of a line: plain, a question, an item of a list or a line of code, blank.
SHAPES = 4
#: A conversation with more lines than this is cut into chunks that are solved apart.
CHUNK_LINES = 4096
CHUNK_TURNS = 64

_NAMES = "|".join(n for names in MARKER_NAMES.values() for n in sorted(names, key=len, reverse=True))
#: A marker: optional #, *, < or [ signs, a name, and a colon or the closing signs.
MARKER = rf"^\s*(?:#+\s*|\*\*\s*|<\|?|\[)?(?i:({_NAMES}))\s*(?:\*\*\s*:|:\s*\*\*|\|?>:?|\]:?|:)\s*"
#: A heading such as "### User" alone on its line marks a speaker too.
HEADING = rf"^\s*#+\s*(?i:({_NAMES}))\s*$"


def observe(text: str = "text"):
    """(lines, codes): each line as it is, and its features as one number.

    The features are the kind of marker, a size class (log2 of the characters) and the shape of the
    line; the code is (kind * LENGTHS + size) * SHAPES + shape.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def code(line):
        name = F.lower(F.concat(F.regexp_extract(line, MARKER, 1), F.regexp_extract(line, HEADING, 1)))
        kind = F.lit(0)
        for k, role in enumerate(ROLES, 1):
            kind = F.when(name.isin(*MARKER_NAMES[role]), F.lit(k)).otherwise(kind)
        size = F.least(F.floor(F.log2(F.char_length(line) + F.lit(1))), F.lit(LENGTHS - 1))
        shape = F.when(F.trim(line) == "", 3).when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"^\s*(?:[-*•]\s|\d+[.)]\s|```|\t| {4})"), 2).otherwise(0)
        return ((kind * LENGTHS + size) * SHAPES + shape).cast("int")

    return lines, F.transform(lines, code)


def without_marker(line):
    """A line that opens a turn, less the marker it may have."""
    return F.regexp_replace(F.regexp_replace(line, MARKER, ""), HEADING, "")


def fit(messages: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> np.ndarray:
    """Log probabilities from labelled messages: rows of [start | transition | emission], all counts plus one half.

    Counting is aggregation only. Who follows whom is counted from the roles of each (key, turn),
    joined with the turn before as one pre-aggregated row each, so a turn with very many rows is no
    product. Roles other than the three and null roles are left out. No rows give even odds.
    """
    known = messages.where(F.col(role).isin(*ROLES)).select(F.col(key).alias("k"), F.col(turn).cast("long").alias("t"), F.col(role).alias("role"), observe(text)[1].alias("codes"))
    seen = known.select("role", F.posexplode("codes").alias("pos", "code")).groupBy("role", (F.col("pos") > 0).alias("more"), "code").count().collect()  # at most 6 * 160 rows
    shape = known.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size("codes") > 1).alias("longer"), F.sum(F.size("codes") - 1).alias("further")).collect()
    each = known.groupBy("k", "t").agg(*[F.avg((F.col("role") == r).cast("double")).alias(r) for r in ROLES])
    before = each.select("k", (F.col("t") + 1).alias("t"), *[F.col(r).alias(f"was_{r}") for r in ROLES])
    pairs = each.join(before, ["k", "t"]).agg(*[F.sum(F.col(f"was_{a}") * F.col(b)).alias(f"{a}_{b}") for a in ROLES for b in ROLES]).first()
    openers = each.join(each.groupBy("k").agg(F.min("t").alias("t")), ["k", "t"]).agg(*[F.sum(r).alias(r) for r in ROLES]).first()
    n = len(ROLES)
    follow = np.array([[(pairs[f"{a}_{b}"] or 0.0) + 0.5 for b in ROLES] for a in ROLES])
    follow /= follow.sum(axis=1, keepdims=True)
    start = np.array([(openers[r] or 0.0) + 0.5 for r in ROLES])
    stay = np.full((2, n), 0.5)
    for row in shape:
        k = ROLES.index(row["role"])
        stay[0, k] = (row["longer"] + 0.5) / (row["turns"] + 1)
        stay[1, k] = (row["further"] - row["longer"] + 0.5) / (row["further"] + 1)
    counts = np.zeros((STATES, (n + 1) * LENGTHS * SHAPES))
    for row in seen:
        counts[ROLES.index(row["role"]) + n * row["more"], row["code"]] += row["count"]
    counts = counts.reshape(STATES, n + 1, LENGTHS, SHAPES)

    def share(*others: int) -> np.ndarray:
        one = counts.sum(axis=others) + 0.5
        return one / one.sum(axis=1, keepdims=True)

    by_kind, by_size, by_shape = share(2, 3), share(1, 3), share(1, 2)
    emit = by_kind[:, :, None, None] * by_size[:, None, :, None] * by_shape[:, None, None, :]  # features are taken as independent
    step = np.full((STATES, STATES), 1e-12)
    for late in range(2):
        for k in range(n):
            step[k + n * late, :n] = (1 - stay[late, k]) * follow[k]
            step[k + n * late, n + k] = stay[late, k]
    first = np.full(STATES, 1e-12)
    first[:n] = start / start.sum()
    return np.log(np.concatenate((first[None, :], step, emit.reshape(STATES, -1).T)))


def viterbi(model: np.ndarray, codes: np.ndarray, entry: int = -1, leave: int = -1) -> np.ndarray:
    """The likeliest states for one chunk of lines; ``entry`` is the state before it (-1: a transcript begins), ``leave`` the state it must end in (-1: any)."""
    step, emit = model[1 : 1 + STATES], model[1 + STATES :]
    score = (model[0] if entry < 0 else step[entry]) + emit[codes[0]]
    back = np.empty((len(codes), STATES), np.int8)
    for i, code in enumerate(codes[1:], 1):
        ways = score[:, None] + step
        back[i] = ways.argmax(axis=0)
        score = ways[back[i], np.arange(STATES)] + emit[code]
    states = np.empty(len(codes), np.int8)
    states[-1] = score.argmax() if leave < 0 else leave
    for i in range(len(codes) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def passage(model: np.ndarray, codes: np.ndarray, opens: bool) -> np.ndarray:
    """Best score of a chunk from each state before it (rows; the start stands in every row where the chunk opens a transcript) to each last state."""
    step, emit = model[1 : 1 + STATES], model[1 + STATES :]
    best = (np.repeat(model[:1], STATES, axis=0) if opens else step) + emit[codes[0]]
    for code in codes[1:]:
        best = (best[:, :, None] + step[None, :, :]).max(axis=1) + emit[code]
    return best


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first ``by`` columns."""
    held, name = [], None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(by)), strict=True))
        low = 0
        for i in range(len(names)):
            if names[i] != name:
                if i > low:
                    held.append(batch.slice(low, i - low))
                if held:
                    yield pa.Table.from_batches(held)
                held, low, name = [], i, names[i]
        if len(names) > low:
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _solve(model: np.ndarray, key: str):
    """Rows (key, c1, c2, uid, lines, codes, entry, leave) to the same with states for codes, and each line's turn, counted from the chunk's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            codes = [np.asarray(c, np.int64) for c in rows.column("codes").to_pylist()]
            states = viterbi(model, np.concatenate(codes), rows.column("entry")[0].as_py(), rows.column("leave")[0].as_py())
            ends = np.cumsum([len(c) for c in codes])[:-1]
            parts, turns = (np.split(x.astype(np.int32), ends) for x in (states, np.cumsum(states < len(ROLES))))
            out = rows.drop_columns(["codes", "entry", "leave"])
            for name, lists in (("states", parts), ("turns", turns)):
                out = out.append_column(name, pa.array(lists, pa.list_(pa.int32())))
            yield from out.combine_chunks().to_batches()

    return run


def _passages(model: np.ndarray, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            codes = np.concatenate([np.asarray(c, np.int64) for c in rows.column("codes").to_pylist()])
            scores = passage(model, codes, bool(rows.column("opens")[0].as_py()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().slice(0, 1) for c in (key, "c1", "c2")), pa.array([scores.ravel()], pa.list_(pa.float64()))], names=[key, "c1", "c2", "scores"])

    return run


def _borders(key: str):
    """Chunks of a conversation in order, with their scores, to the states before and at the end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            scores = np.array(rows.column("scores").to_pylist()).reshape(-1, STATES, STATES)
            best, back = scores[0][0], []
            for chunk in scores[1:]:
                ways = best[:, None] + chunk
                back.append(ways.argmax(axis=0))
                best = ways.max(axis=0)
            leave = [int(best.argmax())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave.reverse()
            table = rows.drop_columns(["scores"]).append_column("entry", pa.array([-1, *leave[:-1]], pa.int32())).append_column("leave", pa.array(leave, pa.int32()))
            yield from table.combine_chunks().to_batches()

    return run


def parse(messages: DataFrame, model: np.ndarray, *, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Turns of each transcript: key, turn_no, role, n_lines, body and rendered, from blocks of lines in ``order``.

    A transcript is all lines of all blocks with one key (null: a transcript of its own), in order;
    where a block begins says nothing. Each line's state is the likeliest by Viterbi. A line whose
    state opens a turn starts the next one and loses its marker, if it has one; all other lines are
    kept as they are. rendered is the turn in canonical form. Blocks that tie in order (repeated rows too) keep the order they are read in; null orders
    come first; a null or empty text is one empty line. Other columns are ignored.

    A transcript with more than CHUNK_LINES lines is cut into chunks. Each chunk is first reduced,
    in parallel, to its best score from every state before it to every state at its end; these few
    numbers are chained along the transcript, and the chunks are then solved between the states so
    found, which gives the path of the whole.
    """
    lines, codes = observe("_text")
    base = messages.select(F.col(key).alias("_key"), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))).alias("turn"), F.col(text).alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    rows = cut(base.select("_key", "turn", F.monotonically_increasing_id().alias("uid"), lines.alias("lines"), codes.alias("codes")))
    slot = F.floor(F.col("turn") / CHUNK_TURNS).cast("long")
    counts = rows.groupBy("_key", slot.alias("slot")).agg(F.sum(F.size("codes")).alias("n_lines")).select(F.col("_key").alias("k"), "slot", "n_lines")
    totals = counts.groupBy("k").agg(F.sum("n_lines").alias("all_lines")).where(f"all_lines > {CHUNK_LINES}")
    big = counts.join(totals.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).select("k", "slot", "n_lines")
    placed = rows.join(big, rows["_key"].eqNullSafe(big["k"]) & (slot == big["slot"]), "left")
    full = F.col("n_lines") > CHUNK_LINES
    c1 = F.when(F.col("n_lines").isNull(), F.lit(0)).when(full, F.col("turn")).otherwise(F.col("slot") * CHUNK_TURNS)
    c2 = F.when(full, F.floor(F.col("uid") / CHUNK_TURNS)).otherwise(F.lit(0))
    placed = placed.select("_key", c1.cast("long").alias("c1"), c2.cast("long").alias("c2"), "turn", "uid", "lines", "codes", F.col("n_lines").isNotNull().alias("cut"))
    whole, parts = placed.where("not cut"), placed.where("cut")

    def in_order(frame: DataFrame) -> DataFrame:
        return frame.repartition("_key", "c1", "c2").sortWithinPartitions("_key", "c1", "c2", "turn", "uid")

    heads = parts.groupBy("_key").agg(F.min(F.struct("c1", "c2")).alias("head")).select(F.col("_key").alias("k"), "head")
    marked = parts.join(heads, parts["_key"].eqNullSafe(heads["k"])).withColumn("opens", (F.col("c1") == F.col("head.c1")) & (F.col("c2") == F.col("head.c2")))
    scores = in_order(marked.select("_key", "c1", "c2", "turn", "uid", "codes", "opens")).mapInArrow(_passages(model, "_key"), f"_key {kind}, c1 long, c2 long, scores array<double>")
    borders = scores.repartition("_key").sortWithinPartitions("_key", "c1", "c2").mapInArrow(_borders("_key"), f"_key {kind}, c1 long, c2 long, entry int, leave int")
    borders = borders.select(F.col("_key").alias("k"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), "entry", "leave")
    parts = parts.join(borders, parts["_key"].eqNullSafe(borders["k"]) & (F.col("c1") == F.col("b1")) & (F.col("c2") == F.col("b2")))
    columns = ["_key", "c1", "c2", "turn", "uid", "lines", "codes", "entry", "leave"]
    whole = whole.withColumn("entry", F.lit(-1)).withColumn("leave", F.lit(-1)).select(*columns)
    solved = cut(in_order(whole.unionByName(parts.select(*columns))).mapInArrow(_solve(model, "_key"), f"_key {kind}, c1 long, c2 long, turn long, uid long, lines array<string>, states array<int>, turns array<int>"))

    n = len(ROLES)
    starts = F.size(F.filter("states", lambda s: s < n)).cast("long")
    chunk = solved.groupBy("_key", "c1", "c2").agg(F.sum(starts).alias("starts"))
    chunk = chunk.withColumn("before", F.coalesce(F.sum("starts").over(Window.partitionBy("_key").orderBy("c1", "c2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chunk = chunk.select(F.col("_key").alias("k"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), "before")
    each = solved.select("_key", "c1", "c2", "turn", "uid", F.posexplode(F.arrays_zip("lines", "states", "turns")).alias("pos", "line"))
    each = each.join(chunk, each["_key"].eqNullSafe(chunk["k"]) & (F.col("c1") == F.col("b1")) & (F.col("c2") == F.col("b2")))
    body = F.when(F.col("line.states") < n, without_marker(F.col("line.lines"))).otherwise(F.col("line.lines"))
    each = each.select("_key", (F.col("before") + F.col("line.turns") - 1).cast("long").alias("turn_no"), F.struct("c1", "c2", "turn", "uid", "pos", body.alias("body")).alias("line"), (F.col("line.states") % n).alias("role"))
    turns = each.groupBy("_key", "turn_no").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["body"]), "\n").alias("body"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("role") + 1)
    return turns.select(F.col("_key").alias(key), "turn_no", role.alias("role"), "n_lines", "body", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim("body"), F.lit("\n<|end|>")).alias("rendered"))


def as_transcripts(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcript blocks from conversations with known roles: key, turn, role, text.

    Each conversation has one of six marker styles (by a hash of its key), and one turn in five (by
    a hash of key and turn) has lost its marker. Null keys, turns and texts are kept; a null role
    gets no marker.
    """
    style = F.pmod(F.xxhash64(F.col(key)), F.lit(6))
    bare = (F.pmod(F.xxhash64(F.col(key), F.col(turn), F.lit("marker")), F.lit(5)) == 0) | F.col(role).isNull()
    name = F.initcap(F.col(role))
    short = F.when(F.col(role) == "user", "Q").when(F.col(role) == "assistant", "A").otherwise(name)
    human = F.when(F.col(role) == "user", "Human").when(F.col(role) == "assistant", "AI").otherwise(name)
    mark = (
        F.when(style == 0, F.concat(name, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("["), F.upper(role), F.lit("] ")))
        .when(style == 2, F.concat(short, F.lit(": ")))
        .when(style == 3, F.concat(F.lit("<|"), F.col(role), F.lit("|>")))
        .when(style == 4, F.concat(F.lit("**"), human, F.lit("**: ")))
        .otherwise(F.concat(F.lit("### "), name, F.lit("\n")))
    )
    return conversations.select(key, turn, role, F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce(F.col(text), F.lit(""))).alias(text))
