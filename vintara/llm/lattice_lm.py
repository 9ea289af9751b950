"""Language-model scores: a lattice of subword pieces and words, marginal over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.llm import textvec
from vintara.llm.common import cut

#: The most frequent words travel to every task; the rest are joined.
FREQUENT = 65_536
#: Mixture classes: the most frequent values of a class column, and one for all others.
CLASSES = 8
DISCOUNT = 0.75
#: Probability that a word ends after a piece.
STOP = 0.4
#: A rank r of the vocabulary's list stands for the probability 1 / (RANK_SHIFT + r); byte pieces share BYTE_MASS.
RANK_SHIFT, BYTE_MASS = 10, 0.01
#: Share of the pieces' weights that comes from the corpus; the rest is the vocabulary's own.
CORPUS_SHARE = 0.5
#: Scores from here down mark pieces that the file's own tokenizer never scores.
NEVER = -1e8
#: Hash that stands for the end of a text among the word hashes.
END = -(1 << 63) + 1
#: The vocabulary's sign for the start of a word; a word's lattice runs over this sign and its bytes.
SIGN = "▁".encode()
_WORD_CHUNK = 8_000


def read_vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces of an existing vocabulary and the natural logs of their probabilities, from its own scores.

    Scores that are log probabilities are taken as they are. The default file's scores are ranks: it
    lists merged pieces and then single characters, each from frequent to rare. A rank r in either
    list stands for 1 / (RANK_SHIFT + r), and the two lists have equal mass; byte pieces share
    BYTE_MASS. Letters A-Z are lower-cased, as those of the texts are, and pieces that then agree
    add up. Control pieces, and merged ones that the file marks as never to be scored, are left out.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    every = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))]
    score = {k: model.get_score(k) for k in every}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    weight: dict[bytes, float] = {bytes([k]): BYTE_MASS / 256 for k in range(256)}
    lists: list[list[int]] = [every]
    if all(s == round(s) for s in score.values()):
        lists = [sorted((k for k in every if (len(model.id_to_piece(k)) == 1) == single and (single or score[k] > NEVER)), key=lambda k: (-score[k] if score[k] > NEVER else 0.0, k)) for single in (False, True)]
    for one in lists:
        p = np.exp([score[k] for k in one]) if len(lists) == 1 else 1 / (RANK_SHIFT + np.arange(len(one)))
        for k, share in zip(one, (1 - BYTE_MASS) / len(lists) * p / p.sum(), strict=True):
            piece = model.id_to_piece(k).encode().translate(lower)
            weight[piece] = weight.get(piece, 0.0) + float(share)
    pieces = sorted(weight)
    return pieces, np.log(np.array([weight[x] for x in pieces]))


class Lattice:
    """Piece lookups by hash, and the forward recursion over the lattices of many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.powers = textvec.Powers()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(x) for x in pieces])
        ends = np.cumsum(size)
        h = textvec.Rolling(data, self.powers).of(ends - size, ends)
        order = np.argsort(h)
        self.hashes, self.index, self.logp = h[order], order, logp
        self.longest = int(size.max())
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def arcs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """(from, to, piece) over nodes numbered start + place, one more node than bytes for each word."""
        rolling = textvec.Rolling(data, self.powers)
        froms, tos, found = [], [], []
        at = np.arange(int(size.sum()))
        word = np.repeat(np.arange(len(size)), size)
        room = (start + size)[word] - at
        for length in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            ok = room >= length
            at, room, word = at[ok], room[ok], word[ok]
            h = rolling.of(at, at + length)
            maybe = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            where = np.searchsorted(self.hashes, h[maybe])
            where[where == len(self.hashes)] = 0
            hit = self.hashes[where] == h[maybe]
            node = (at + word)[maybe[hit]]
            froms.append(node), tos.append(node + length), found.append(self.index[where[hit]])
        return tuple(np.concatenate(x) for x in (froms, tos, found))

    @staticmethod
    def _reduce(target: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        """target[k] = log of the sum of exp of the values with key k."""
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        top = np.maximum.reduceat(values, first)
        count = np.diff(np.concatenate((first, [len(keys)])))
        target[keys[first]] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, count)), first))

    def forward(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, expect: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's probability over all segmentations into pieces.

        ``start`` and ``size`` place the words in ``data``. A word of m pieces has the pieces'
        probabilities, m - 1 times "go on" and once "stop". ``expect`` (a number for each piece) gets
        the expected counts of pieces added, by the backward recursion; every word counts once.
        """
        if not len(size):
            return np.zeros(0)
        mark = len(SIGN)
        whole = size + mark
        begin = np.cumsum(whole) - whole
        packed = np.empty(int(whole.sum()), np.uint8)
        packed[(begin[:, None] + np.arange(mark)).ravel()] = np.tile(np.frombuffer(SIGN, np.uint8), len(size))
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        packed[np.repeat(begin + mark, size) + inner] = data[np.repeat(start, size) + inner]
        f, t, piece = self.arcs(packed, begin, whole)
        go = np.log(1 - STOP)
        w = self.logp[piece] + go
        node = begin + np.arange(len(size))
        depth = np.arange(len(packed) + len(size)) - np.repeat(node, whole + 1)
        steps = np.arange(int(whole.max()) + 2)

        def recursion(at: np.ndarray, to: np.ndarray, first: np.ndarray, order) -> np.ndarray:
            """Log sums at all nodes, from the ``first`` ones over the arcs from ``at`` to ``to``, by the depth of ``to`` in ``order``."""
            total = np.full(len(depth), -np.inf)
            total[first] = 0.0
            by = np.argsort(depth[to], kind="stable")
            bounds = np.searchsorted(depth[to][by], steps)
            for d in order(range(len(steps) - 1)):
                arc = by[bounds[d] : bounds[d + 1]]
                if len(arc):
                    self._reduce(total, to[arc], total[at[arc]] + w[arc])
            return total

        last = node + whole
        alpha = recursion(f, t, node, iter)
        if expect is not None:
            beta = recursion(t, f, last, reversed)
            word = np.repeat(np.arange(len(size)), whole + 1)[f]
            expect += np.bincount(piece, weights=np.exp(alpha[f] + w + beta[t] - alpha[last][word]), minlength=len(expect))
        return alpha[last] - go + np.log(STOP)


def _expect(sent):
    """Lexicon rows (h, n, m, word, ...) to (piece, n): expected counts of pieces over the distinct training words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        expect = np.zeros(len(lattice.logp))
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(3))
            size = np.diff(offsets)
            rows = np.flatnonzero((batch.column(1).to_numpy() > 0) & (size > 0))
            for low in range(0, len(rows), _WORD_CHUNK):
                pick = rows[low : low + _WORD_CHUNK]
                lattice.forward(data, offsets[:-1][pick], size[pick], expect)
        some = np.flatnonzero(expect)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(expect[some])], names=["piece", "n"])

    return run


def adapt(lexicon: DataFrame, pieces: list[bytes], logp: np.ndarray, sent) -> np.ndarray:
    """Weights of the pieces for words that training has not seen: the vocabulary's, and as much from the corpus.

    The vocabulary's own scores weigh all segmentations of every distinct training word; the pieces
    so expected, as shares, are averaged with the vocabulary's probabilities. Each task returns at
    most one row for a piece. Without training words the vocabulary's weights stay.
    """
    got = lexicon.mapInArrow(_expect(sent), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return logp
    own = np.zeros(len(pieces))
    own[got["piece"].to_numpy()] = got["n"]
    return np.log((1 - CORPUS_SHARE) * np.exp(logp) + CORPUS_SHARE * own / own.sum())


def _lower(column: pa.Array, a: int, b: int):
    data, offsets = textvec.text_buffer(column)
    at = offsets[a : b + 1]
    part = data[at[0] : at[-1]]
    lower = part.copy()
    lower[(part >= 65) & (part <= 90)] += 32
    return lower, at - at[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (word hash, class, count, word), summed over a batch; the end of each text counts as a word. Class -1: not learned from."""
    for batch in batches:
        mixed = batch.column(0).to_numpy().astype(np.int64)
        _, offsets = textvec.text_buffer(batch.column(1))
        held, parts, before = [], [], 0
        for a, b in textvec.chunks(offsets, 2 << 20):
            data, at = _lower(batch.column(1), a, b)
            row, start, end, h = textvec.words(data, at)
            group = mixed[a:b][row]
            code = textvec.combine(h, group.view(np.uint64))
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            held.append((code[first], h[first], group[first], count, start[first] + before, end[first] + before))
            parts.append(data.tobytes())
            before += len(data)
        kinds, ends = np.unique(mixed, return_counts=True)
        if held:
            code, h, group, count, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=count).astype(np.int64)
            raw = b"".join(parts)
            words = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((h[first].view(np.int64), np.full(len(kinds), END)))),
                    pa.array(np.concatenate((group[first], kinds)).astype(np.int32)),
                    pa.array(np.concatenate((total, ends)).astype(np.int64)),
                    pa.array(words + [b""] * len(kinds), pa.binary()),
                ],
                names=["h", "class", "n", "word"],
            )


def _word_scores(sent, n_all: int, spare_all: float, n_class: list[int], spare: list[float]):
    """Lexicon rows (h, n, m, word, n0, n1, ...) to (h, n, m, logs): log10 of the word's probability in each class.

    A word's lattice has its pieces and, for a word seen in training, one arc over the whole word.
    In a class that arc weighs the word's discounted share of the class and, of the mass so freed,
    its discounted share of all training words; what both leave goes to the pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, classes = Lattice(*sent.value), len(n_class)
        for batch in batches:
            for low in range(0, batch.num_rows, _WORD_CHUNK):
                part = batch.slice(low, _WORD_CHUNK)
                data, offsets = textvec.text_buffer(part.column(3))
                counts = np.stack([part.column(4 + k).to_numpy() for k in range(classes)], axis=1)
                pieces = lattice.forward(data, offsets[:-1], np.diff(offsets))
                pieces[np.diff(offsets) == 0] = -np.inf  # the end has no bytes and no pieces
                wide = np.maximum(part.column(1).to_numpy() - DISCOUNT, 0) / n_all
                own = np.maximum(counts - DISCOUNT, 0) / np.maximum(n_class, 1)
                with np.errstate(divide="ignore"):
                    whole = np.log(own + np.array(spare) * wide[:, None])
                    logs = np.logaddexp(whole, np.log(np.array(spare) * spare_all) + pieces[:, None]) / np.log(10)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * classes)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.ListArray.from_arrays(ends, pa.array(logs.astype(np.float32).ravel()))], names=["h", "n", "m", "logs"])

    return run


def _lookup(frequent, classes: int):
    """Rows (rid, key, text) to counts, the sums over frequent words, and the hashes of the other words in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, base, known = frequent.value
        for batch in batches:
            _, offsets = textvec.text_buffer(batch.column(2))
            for a, b in textvec.chunks(offsets, 2 << 20):
                data, at = _lower(batch.column(2), a, b)
                row, _, _, h = textvec.words(data, at)
                signed = h.view(np.int64)
                where = np.minimum(np.searchsorted(hashes, signed), max(len(hashes) - 1, 0))
                often = hashes[where] == signed if len(hashes) else np.zeros(len(h), bool)
                rows, place, rare = b - a, where[often], np.flatnonzero(~often)
                total = lambda weights: np.bincount(row[often], weights=weights, minlength=rows)
                sums = np.stack([total(table[place, k]) for k in range(classes)], axis=1) if len(hashes) else np.zeros((rows, classes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, rows),
                        batch.column(1).slice(a, rows),
                        pa.array((np.bincount(row, minlength=rows) + 1).astype(np.int64)),
                        pa.array((total(known[place]) if len(hashes) else np.zeros(rows)).astype(np.int64)),
                        pa.array((total(base[place]) if len(hashes) else np.zeros(rows)).astype(np.float64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * classes), pa.array(sums.astype(np.float64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rare], np.arange(rows + 1)).astype(np.int32)), pa.array(signed[rare])),
                    ],
                    names=["rid", "_key", "n_tokens", "n_known", "base", "sums", "words"],
                )

    return run


def _least_frequent(scores: DataFrame) -> int:
    """A number of occurrences that at most FREQUENT words reach, from a histogram on a log scale (some 300 bars at most)."""
    bar = F.floor(F.log2("m") * 8).cast("int")
    total, least = 0, 1 << 62
    for row in scores.where(F.col("h") != END).groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("words"), F.min("m").alias("least")).orderBy(F.desc("bar")).collect():
        total += row["words"]
        if total > FREQUENT:
            break
        least = row["least"]
    return least


def score_texts(docs: DataFrame, train, *, key: str = "doc_id", text: str = "text", group: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    ``train`` is a boolean column: the rows to learn from (null: no). Tokens are words between white
    space with A-Z lower-cased, then one end. score is the log10 probability of the text, summed
    over all its segmentations by a forward recursion in log space; no arc of the lattice crosses
    white space, so the recursion runs word by word:

    * The pieces of an existing vocabulary are arcs, weighted by the vocabulary's own scores and, by
      half, by how often those scores lead to them in training words (see ``adapt``).
    * A training word has one more arc, over the whole word, weighted by its discounted count; the
      mass so set free goes to the pieces.
    * With ``group``, a text comes from one of up to CLASSES classes (its most frequent values in
      training, and the rest), which change the weights of whole-word arcs alone: the counts of a
      class are discounted against those of all training rows, and the text's probability sums over
      classes. The column itself is never used to score.

    base_score is the add-one unigram score. Each distinct word's lattice is worked out once for the
    whole table. Word counts are aggregated and stay distributed; only the FREQUENT most frequent
    words at most, the pieces and a few totals are sent to tasks, all of fixed size. A null text is
    empty and has the end alone. Rows repeated with one key each give a row; without training rows
    every word is scored by its pieces alone and the end costs nothing. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"), (F.col(group) if group else F.lit(None)).cast("string").alias("_group"))
    names: list[str] = []
    if group:
        names = [r["_group"] for r in base.where("_train and _group is not null").groupBy("_group").count().orderBy(F.desc("count"), "_group").limit(CLASSES - 1).collect()]
    classes = len(names) + 1
    mixed = F.lit(len(names))
    for k, name in enumerate(names):
        mixed = F.when(F.col("_group").eqNullSafe(F.lit(name)), F.lit(k)).otherwise(mixed)

    counted = base.select(F.when(F.col("_train"), mixed).otherwise(-1).alias("class"), "_text").mapInArrow(_count, "h long, class int, n long, word binary")
    in_class = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(classes)]
    learned = F.coalesce(F.sum(F.when(F.col("class") >= 0, F.col("n"))), F.lit(0)).alias("n")
    lexicon = cut(counted.groupBy("h", "word").agg(learned, F.sum("n").alias("m"), *in_class))
    totals = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), *[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(classes)], *[F.count_if(F.col(f"n{k}") > 0) for k in range(classes)]).first()
    n_all, v_all, n_class, v_class = totals[0], totals[1], list(totals[2 : 2 + classes]), list(totals[2 + classes :])

    spare_all = DISCOUNT * v_all / n_all if n_all else 1.0
    spare = [DISCOUNT * v / n if n else 1.0 for n, v in zip(n_class, v_class, strict=True)]
    pieces, logp = read_vocabulary(vocabulary)
    counts = lexicon.select("h", "n", "m", "word", *[f"n{k}" for k in range(classes)])
    logp = adapt(counts, pieces, logp, spark.sparkContext.broadcast((pieces, logp)))
    sent = spark.sparkContext.broadcast((pieces, logp))
    scores = cut(counts.mapInArrow(_word_scores(sent, max(n_all, 1), spare_all, n_class, spare), "h long, n long, m long, logs array<float>"))
    top = scores.where((F.col("h") != END) & (F.col("m") >= _least_frequent(scores))).toPandas().sort_values("h")  # at most FREQUENT rows
    whole = n_all + v_all + 1
    table = np.stack(top["logs"].to_list()).astype(np.float64) if len(top) else np.zeros((0, classes))
    seen = top["n"].to_numpy(np.float64)
    frequent = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), table, np.log10((seen + 1) / whole), (seen > 0).astype(np.float64)))

    kind = base.schema["_key"].dataType.simpleString()
    numbered = base.select(F.monotonically_increasing_id().alias("rid"), "_key", "_text")  # numbers and keys are settled together, so the input may come from a shuffle
    scored = cut(numbered.mapInArrow(_lookup(frequent, classes), f"rid long, _key {kind}, n_tokens long, n_known long, base double, sums array<double>, words array<long>"))
    rare = scored.select("rid", F.explode("words").alias("h")).join(scores, "h")
    logs, zero = F.col("logs"), F.lit(0.0)
    rare = rare.groupBy("rid").agg(F.sum((F.col("n") > 0).cast("long")).alias("known"), F.sum(F.log10((F.col("n") + 1) / float(whole))).alias("base_rare"), *[F.sum(logs[k].cast("double")).alias(f"l{k}") for k in range(classes)])
    ends = lexicon.where(F.col("h") == END).first()
    end_n = ends["n"] if ends else 0
    end_base = float(np.log10((end_n + 1) / whole))

    def end_log(k: int) -> float:
        if not end_n:
            return 0.0
        return float(np.log10(max(ends[f"n{k}"] - DISCOUNT, 0) / max(n_class[k], 1) + spare[k] * (end_n - DISCOUNT) / n_all))

    both = scored.drop("words").join(rare, "rid", "left")
    docs_all = sum(ends[f"n{k}"] for k in range(classes)) if ends else 0
    prior = [float(np.log10(((ends[f"n{k}"] if ends else 0) + 0.5) / (docs_all + 0.5 * classes))) for k in range(classes)]
    parts = F.array(*[F.col("sums")[k] + F.coalesce(F.col(f"l{k}"), zero) + end_log(k) + prior[k] for k in range(classes)])
    both = both.withColumn("parts", parts).withColumn("most", F.array_max("parts"))
    score = F.col("most") + F.log10(F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.col("most"))))
    return both.select(
        F.col("_key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + (1 if end_n else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_rare", zero) + end_base).alias("base_score"), score.alias("score"),
    )
