"""Hard negatives by inner product: STR-packed R-trees over ranges of rows, searched best box first within score windows, for many anchors at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import cut

#: Rows of one range, and anchors of one block; a task searches the trees of one range for one block.
ROWS, ANCHORS = 65_536, 65_536
#: Rows of a leaf and children of a node.
LEAF = FAN = 32
#: Coordinates by which rows are tiled, those of the greatest spread.
AXES = 4
#: Rows from which the slabs of the ranges are fitted; every row is indexed.
SAMPLE = 20_000
#: Anchors that are searched for together.
TOGETHER = 256
_SMALL, _EXACT = 1 << 24, 1 << 53


def tile_order(points: np.ndarray, size: int, axes: list[int]) -> np.ndarray:
    """Sort-tile-recursive order: slabs by the first axis, within each by the next, so that runs of ``size`` rows are compact."""
    n = len(points)
    if n <= size or not axes:
        return np.arange(n)
    leaves = -(-n // size)
    slabs = int(np.ceil(leaves ** (1 / len(axes))))
    step = size * -(-leaves // slabs)
    order = np.argsort(points[:, axes[0]], kind="stable")
    return np.concatenate([part[tile_order(points[part], size, axes[1:])] for part in (order[k : k + step] for k in range(0, n, step))])


class Tree:
    """A packed R-tree: rows in tile order, and for each level the corners of the boxes around FAN of the level below.

    ``labels`` are numbers of the rows' labels; ``label`` is the one that all rows have, or -1.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, labels: np.ndarray | None = None):
        spread = points.astype(np.float64).var(axis=0)
        order = tile_order(points, LEAF, np.argsort(-spread, kind="stable")[:AXES].tolist())
        self.ids, self.points = ids[order], points[order]
        self.labels = np.zeros(len(ids), np.int64) if labels is None else labels[order]
        self.label = int(self.labels[0]) if (self.labels == self.labels[0]).all() else -1
        low = high = self.points
        self.levels: list[np.ndarray] = []
        step = LEAF
        while True:
            starts = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            # for anchors split into their positive and negative parts, one product gives the upper ends of their scores and the lower ends
            self.levels.append(np.stack((np.hstack((high, low)), np.hstack((low, high)))))
            if len(low) == 1:
                break
            step = FAN


class Search:
    """Best-first search for anchors together: of each anchor and window [low, high] the first ``k`` rows, higher scores and then smaller ids first.

    ``low`` and ``high`` have a row an anchor; a window that begins beyond its end holds nothing. With ``alike`` rows of an anchor's own label count, without it
    those of other labels. The box that may hold the highest score of any anchor is opened first. It waits only while for some
    anchor a window overlaps its interval of scores and its upper end is not strictly below that window's k-th score so far.
    Only anchors that still need a box take part in its product, so what no box rules out costs one product a box and not one an anchor.
    """

    def __init__(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, alike: bool):
        self.anchors, self.own, self.labels, self.high, self.k, self.alike = anchors, own, labels, high, k, alike
        self.parts = np.hstack((np.maximum(anchors, 0), np.minimum(anchors, 0)))
        self.floor = np.where(low > high, np.inf, low).astype(low.dtype)
        shape = (low.size, k)
        self.count, self.scores, self.ids = np.zeros(low.size, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.leaves = 0

    def needed(self, upper: np.ndarray, lower: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which anchors ``at`` need a box with these ends; the ends may have a further, leading axis of boxes."""
        out = np.zeros(upper.shape, bool)
        for w in range(self.floor.shape[1]):
            out |= (upper >= self.floor[at, w]) & (lower <= self.high[at, w])
        return out

    def run(self, trees: list[Tree]) -> None:
        waiting: list[tuple] = []
        tick = 0

        def wait(t: int, level: int, first: int, last: int, at: np.ndarray) -> None:
            nonlocal tick
            upper, lower = trees[t].levels[level][:, first:last] @ self.parts[at].T
            useful = self.needed(upper, lower, at)
            for j in np.flatnonzero(useful.any(axis=1)).tolist():
                mine = useful[j]
                tick += 1
                heapq.heappush(waiting, (-upper[j][mine].max(), tick, t, level, first + j, at[mine], upper[j][mine], lower[j][mine]))

        for t, tree in enumerate(trees):
            at = np.arange(len(self.anchors)) if tree.label < 0 else np.flatnonzero((self.labels == tree.label) == self.alike)
            if len(at):
                wait(t, len(tree.levels) - 1, 0, 1, at)
        while waiting:
            _, _, t, level, node, at, upper, lower = heapq.heappop(waiting)
            at = at[self.needed(upper, lower, at)]
            if not len(at):
                continue
            tree = trees[t]
            if level > 1:
                wait(t, level - 1, node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][0])), at)
            else:
                self.read(tree, *((node * FAN, min((node + 1) * FAN, len(tree.levels[0][0]))) if level else (node, node + 1)), at)

    def read(self, tree: Tree, first: int, last: int, at: np.ndarray) -> None:
        """Leaves of one box: the best of each anchor first, then those that are needed after them."""
        upper, lower = tree.levels[0][:, first:last] @ self.parts[at].T
        best = np.unique(np.where(self.needed(upper, lower, at), upper, -np.inf).argmax(axis=0))
        for leaves in (best, np.setdiff1d(np.arange(last - first), best)):
            useful = self.needed(upper[leaves], lower[leaves], at)
            leaves, mine = leaves[useful.any(axis=1)], useful.any(axis=0)
            if len(leaves):
                self.leaves += len(leaves)
                rows = ((first + leaves)[:, None] * LEAF + np.arange(LEAF)).ravel()
                self.score(tree, rows[rows < len(tree.ids)], at[mine])

    def score(self, tree: Tree, rows: np.ndarray, at: np.ndarray) -> None:
        scores = tree.points[rows] @ self.anchors[at].T
        windows = self.floor.shape[1]
        if windows == 1 and len(rows) > 4 * self.k + 1 and tree.label >= 0:
            # where all scores count, no more than the first few of these rows can: one place more, as an anchor may be among them
            least = np.partition(scores, len(rows) - self.k - 1, axis=0)[len(rows) - self.k - 1] if scores.dtype != object else self.floor[at, 0]
            least = np.where(np.isposinf(self.high[at, 0].astype(np.float64)), np.maximum(self.floor[at, 0], least), self.floor[at, 0])
        else:
            least = self.floor[at].min(axis=1)
        met = (scores >= least) & (scores <= self.high[at].max(axis=1))
        if tree.label < 0:
            met &= (tree.labels[rows][:, None] == self.labels[at]) == self.alike
        r, a = np.nonzero(met)
        score, ids, a = scores[r, a], tree.ids[rows[r]], at[a]
        other = ids != self.own[a]
        score, ids, a = score[other], ids[other], a[other]
        if windows > 1:
            c, w = np.nonzero((score[:, None] >= self.floor[a]) & (score[:, None] <= self.high[a]))
            score, ids, group = score[c], ids[c], a[c] * windows + w
        else:
            group = a
        score = score.astype(np.int64)
        last = self.k - 1
        enters = (self.count[group] < self.k) | (score > self.scores[group, last]) | ((score == self.scores[group, last]) & (ids < self.ids[group, last]))
        score, ids, group = score[enters], ids[enters], group[enters]
        if not len(group):
            return
        touched = np.unique(group)
        held = np.arange(self.k) < self.count[touched][:, None]
        group = np.concatenate((group, np.repeat(touched, self.count[touched])))
        score, ids = np.concatenate((score, self.scores[touched][held])), np.concatenate((ids, self.ids[touched][held]))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
        kept = place < self.k
        self.scores[group[kept], place[kept]], self.ids[group[kept], place[kept]] = score[kept], ids[kept]
        self.count[touched] = np.bincount(np.searchsorted(touched, group[kept]), minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        self.floor[full // windows, full % windows] = self.scores[full, last]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, window, score, id) of what was found, in order of anchor, window and rank."""
        held = np.arange(self.k) < self.count[:, None]
        group = np.repeat(np.arange(len(self.count)), self.count)
        return group // self.floor.shape[1], group % self.floor.shape[1], self.scores[held], self.ids[held]


def best_first(trees: list[Tree], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: int) -> tuple[list[list[tuple[int, int]]], int]:
    """``Search`` for one anchor over rows of any label: for each window the first ``k`` (score, id); and the leaves read."""
    none = np.array([-2])  # no row's label
    search = Search(anchor[None], np.array([own]), none, low[None], high[None], k, False)
    search.run(trees)
    found: list[list[tuple[int, int]]] = [[] for _ in low]
    for _, w, score, i in zip(*(x.tolist() for x in search.found()), strict=True):
        found[w].append((score, i))
    return found, search.leaves


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _padded(column: pa.Array, name: str, fill: int) -> np.ndarray:
    """A field of a list column of structs as a matrix, filled up to the longest list."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), int(sizes.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().field(name).to_numpy()
    return out


def _search(positives: bool, k: int, low: int, high: int):
    """Rows of cells in order, anchors (role 0) before rows (role 1), to the local first ``k`` of each anchor and window."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        role, ids, dims = (rows.column(c).to_numpy() for c in ("role", "id", "dims"))
        labels = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        codes, targets = rows.column("codes").combine_chunks(), rows.column("positives").combine_chunks()
        for d in np.unique(dims[role == 0]):
            mine = np.flatnonzero((dims == d) & (role == 1))
            asked = np.flatnonzero((dims == d) & (role == 0))
            if not len(mine):
                continue
            points, anchors = (_matrix(codes.take(pa.array(at))) for at in (mine, asked))
            top = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (points, anchors)]
            most = top[0] * top[1] * max(int(d), 1)
            # whole numbers are exact in all three, and so is every sum on the way
            kind = np.float32 if most < _SMALL else np.float64 if most < _EXACT else object
            points, anchors = points.astype(kind), anchors.astype(kind)
            # labels of enough rows have a tree of their own, the others share one
            number = np.bincount(labels[mine])
            of_label = np.where(number[labels[mine]] >= LEAF * FAN, labels[mine], -1)
            trees = []
            for name in np.unique(of_label).tolist():
                at = np.flatnonzero(of_label == name)
                trees.append(Tree(ids[mine[at]], points[at], labels[mine[at]]))
            # anchors that lie together and have one label are asked together
            near = tile_order(anchors, TOGETHER, np.argsort(-anchors.astype(np.float64).var(axis=0), kind="stable")[:AXES].tolist())
            near = near[np.argsort(labels[asked[near]], kind="stable")]
            for group in (near[j : j + TOGETHER] for j in range(0, len(near), TOGETHER)):
                at = asked[group]
                if positives:
                    starts, ends = np.full((len(at), 1), -np.inf), np.full((len(at), 1), np.inf)
                else:
                    of = targets.take(pa.array(at))
                    there, to, whole = np.diff(of.offsets.to_numpy()), _padded(of, "id", 0), _padded(of, "score", 0)
                    ends = whole.astype(object)
                    starts = -(-low * ends // high)  # the least whole n with high * n >= low * s
                    if kind is not object:
                        limit = int(_SMALL if kind is np.float32 else _EXACT)  # beyond every score
                        starts, ends = np.clip(starts, -limit, limit), np.clip(ends, -limit, limit)
                    starts = np.where(np.arange(ends.shape[1]) < there[:, None], starts, np.inf)
                if not starts.shape[1]:
                    continue
                search = Search(anchors[group], ids[at], labels[at], starts.astype(kind), ends.astype(kind), k, positives)
                search.run(trees)
                a, w, score, other = search.found()
                none = pa.nulls(len(a), pa.int64())
                told = [none, none] if positives else [pa.array(to[a, w]), pa.array(whole[a, w])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[a]]), *told, pa.array(other), pa.array(score)], names=["anchor", "positive", "positive_score", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != cells[a]:
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _ranges(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with a column ``shard``: ranges of about ``size`` rows by length, label, two slabs of coordinates and id; and their number.

    The slabs are fitted on a bounded sample. The id comes last, so neither a frequent label nor
    equal vectors make a range larger than others.
    """
    n = rows.count()
    shards = max(1, -(-n // size))
    fitted = rows.sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=11).select("codes").limit(SAMPLE).collect() if shards > 1 else []
    widths = np.array([len(r["codes"]) for r in fitted], np.int64)
    slabs = []
    if len(widths) and (d := int(np.bincount(widths).argmax())):
        points = np.array([r["codes"] for r in fitted if len(r["codes"]) == d], np.float64)
        cuts = np.linspace(0, 1, min(64, int(np.ceil(shards**0.5))) + 1)[1:-1]
        for axis in np.argsort(-points.var(axis=0), kind="stable")[:2].tolist():
            bounds = F.array(*[F.lit(int(x)) for x in np.unique(np.quantile(points[:, axis], cuts).astype(np.int64))]) if len(cuts) else F.array().cast("array<long>")
            here = F.try_element_at("codes", F.lit(axis + 1))
            slabs.append(F.size(F.filter(bounds, lambda b, here=here: b < here)))
    ranged = rows.repartitionByRange(shards, "dims", "label", *slabs, "id") if shards > 1 else rows.repartition(1)
    return cut(ranged.withColumn("shard", F.spark_partition_id())), shards


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, key: str = "vec_id", codes: str = "codes", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, rows: int = ROWS, block: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    ``codes`` holds whole numbers (array of long), the score of two rows is their inner product.
    ``anchors`` is a condition on the columns of ``vectors``. An anchor's positives are its first
    ``positives`` other rows of the same label, higher scores first and smaller keys (whole numbers) first among
    equal ones. For each positive, the first ``negatives`` rows of other labels with
    low * positive_score <= high * score <= high * positive_score are returned. A negative score of a positive
    leaves an empty window. All counts are exact: boxes only rule rows out.

    Rows are cut into ranges, anchors into blocks, and a task searches one range for one block, first
    for positives and, when these are known over all ranges, for negatives; only the first few of
    each anchor leave a task. So every row is sent to anchors / ``block`` tasks and every anchor to rows / ``rows``.

    Rows whose key, label or codes are null, or whose codes hold a null, take no part. Only rows of
    one length are compared. Of rows repeated with one key that with the smallest (label, codes) stands. Scores
    must fit a long. Other columns are ignored; without anchors or rows there are no results.
    """
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(codes).isNotNull()).where(F.forall(codes, lambda c: c.isNotNull()))
    named = kept.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).alias("label"), F.col(codes).alias("codes"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).alias("row"))
    told = named.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*", F.size("row.codes").alias("dims"))
    indexed, shards = _ranges(cut(told), rows)
    asked = cut(indexed.where("is_anchor").select("id", "label", "codes", "dims"))
    blocks = max(1, -(-asked.count() // block))
    cell = F.col("_block") * F.lit(shards).cast("long") + F.col("shard")
    targets = "array<struct<score: long, id: long>>"
    base = indexed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", cell).withColumn("positives", F.lit(None).cast(targets))
    names = ["cell", "role", "id", "label", "dims", "codes", "positives"]
    schema = "anchor long, positive long, positive_score long, other long, score long"

    def meet(queries: DataFrame, for_positives: bool, k: int) -> DataFrame:
        spread = queries.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("cell", cell)
        both = spread.withColumn("role", F.lit(0)).select(*names).unionByName(base.withColumn("role", F.lit(1)).select(*names))
        dealt = both.repartition(max(1, min(shards * blocks, 20_000)), "cell").sortWithinPartitions("cell", "role", "label", "id")
        return dealt.mapInArrow(_search(for_positives, k, low, high), schema)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = first(meet(asked.withColumn("positives", F.lit(None).cast(targets)), True, positives), positives, "anchor")
    windows = near.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("score", F.col("other").alias("id"))).alias("positives"))
    found = first(meet(cut(asked.join(windows, "id")), False, negatives), negatives, "anchor", "positive")
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
