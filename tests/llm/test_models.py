"""Language model, classifier, transcripts: totals by brute force, held-out accuracy, odd inputs."""

import math
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import lattice_lm, quality, queries, transcripts

SF = "/root/testdata/sf0.001"


def tokens(text):
    import re

    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x] + [None]


def readings(word, weight):
    """Probability of each number of pieces, over all segmentations of the bytes, by recursion."""
    longest, memo = max(map(len, weight)), {len(word): {0: 1.0}}
    for i in range(len(word) - 1, -1, -1):
        memo[i] = Counter()
        for j in range(i + 1, min(i + longest, len(word)) + 1):
            if word[i:j] in weight:
                for n, v in memo[j].items():
                    memo[i][n + 1] += weight[word[i:j]] * v
    return memo[0]


def by_pieces(word, weight):
    stop = lattice_lm.STOP
    return sum(v * (1 - stop) ** (n - 1) * stop for n, v in readings(lattice_lm.SIGN + word, weight).items())


def test_lattice_sums_all_segmentations():
    sign = lattice_lm.SIGN
    weight = {b"a": 0.2, b"ab": 0.1, b"b": 0.1, b"ba": 0.1, b"c": 0.1, sign: 0.2, sign + b"a": 0.1, sign + b"ab": 0.1}
    lattice = lattice_lm.Lattice(list(weight), np.log(list(weight.values())))
    words = [b"ab", b"aba", b"abba", b"cab", b"c"]
    data = np.frombuffer(b"-".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    expect = np.zeros(len(weight))
    got = lattice.forward(data, np.cumsum(size + 1) - size - 1, size, expect)
    assert got == pytest.approx([math.log(by_pieces(w, weight)) for w in words])
    assert dict(zip(weight, expect)) == pytest.approx(plain_expectation(words, weight))


def plain_expectation(words, weight):
    """Expected counts of pieces over all segmentations of each word, one path at a time."""
    out = Counter({p: 0.0 for p in weight})
    longest, go = max(map(len, weight)), 1 - lattice_lm.STOP

    def paths(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, min(longest, len(rest)) + 1):
            if rest[:n] in weight:
                for more, p in paths(rest[n:]):
                    yield (rest[:n], *more), p * go * weight[rest[:n]]

    for w in words:
        every = list(paths(lattice_lm.SIGN + w))
        total = sum(p for _, p in every)
        for path, p in every:
            for piece in path:
                out[piece] += p / total
    return out


def test_vocabulary_keeps_its_own_scores():
    """Merged pieces and characters keep the order of the file; all weights make one."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces, logp = lattice_lm.read_vocabulary()
    weight = {p: math.exp(w) for p, w in zip(pieces, logp)}
    assert math.fsum(weight.values()) == pytest.approx(1.0)
    assert all(bytes([k]) in weight for k in range(256))
    known = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) and model.get_score(k) > -1e8]
    caseless = [k for k in known if not any(c in string.ascii_letters for c in model.id_to_piece(k))]
    for single in (False, True):
        ranked = sorted((k for k in caseless if (len(model.id_to_piece(k)) == 1) == single and len(model.id_to_piece(k).encode()) > 1), key=lambda k: -model.get_score(k))
        found = [weight[model.id_to_piece(k).encode()] for k in ranked]
        assert len(found) > 50 and found == sorted(found, reverse=True)
    assert weight["\u2581".encode()] == max(w for p, w in weight.items() if len(p.decode("utf-8", "replace")) == 1 and p not in (b"e", b"t"))


def test_language_model_score_by_brute_force(spark):
    """The whole score of every text, held out or not, in two classes, by a plain program that enumerates segmentations."""
    texts = ["the cat sat", "the dog sat on the mat", "ein Hund und ein Haus", "das Haus the end", "", None, "unseen words here the", "das Tor " * 3]
    group = ["en", "en", "de", "de", "en", "de", "de", None]
    train = [1, 1, 1, 1, 1, 0, 0, 0]
    rows = [(k, *x) for k, x in enumerate(zip(texts, group, train, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, t int")
    got = {r["doc_id"]: r for r in lattice_lm.score_texts(docs, F.col("t") == 1, group="lang").collect()}
    weight = {p: math.exp(w) for p, w in zip(*lattice_lm.read_vocabulary())}
    counts = {c: Counter(w for t, g, on in zip(texts, group, train) if on and g == c for w in tokens(t)) for c in ("de", "en", None)}
    every = counts["de"] + counts["en"]
    own = plain_expectation([w.encode() for w in every if w is not None], weight)
    weight = {p: 0.5 * w + 0.5 * own[p] / sum(own.values()) for p, w in weight.items()}
    n, v, d = sum(every.values()), len(every), lattice_lm.DISCOUNT
    starts = {c: counts[c][None] for c in counts}
    for k, t in enumerate(texts):
        total = 0.0
        for c, own in counts.items():
            nc = sum(own.values())
            free = d * len(own) / nc if nc else 1.0
            p = (starts[c] + 0.5) / (sum(starts.values()) + 0.5 * 3)
            for w in tokens(t):
                spell = 0.0 if w is None else by_pieces(w.encode(), weight)
                wide = max(every[w] - d, 0) / n + (d * v / n) * spell
                p *= (max(own[w] - d, 0) / nc if nc else 0.0) + free * wide
            total += p
        assert got[k]["score"] == pytest.approx(math.log10(total), abs=1e-4), t


def test_language_model_totals(spark):
    rows = {r["doc_id"]: r for r in queries.op4_lattice_lm(spark, SF).collect()}
    texts = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    count = Counter(w for k, t in texts.items() if not rows[k]["held_out"] for w in t)
    n, v = sum(count.values()), len(count)
    for k, t in texts.items():
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0


def test_language_model_odd_rows(spark):
    data = [(1, "a b b", "x"), (2, None, None), (2, "", "y"), (None, "zzz " + "q" * 900, "x"), (3, "A B", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, rid string")
    out = lattice_lm.score_texts(docs, F.col("doc_id") < 3, group="rid").collect()
    assert len(out) == 5 and all(math.isfinite(r["score"]) for r in out)
    assert sorted(r["n_tokens"] for r in out) == [1, 1, 3, 3, 4]
    none = lattice_lm.score_texts(docs, F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert lattice_lm.score_texts(docs.where("false"), F.lit(True)).count() == 0


def plain_features(text, bits=quality.BITS):
    """Hashed tokens and pairs of a text, token by token."""
    import re

    from vintara.llm import textvec

    one = [textvec.hash_spans(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)])) for t in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    two = [textvec.combine(a, b) for a, b in zip(one, one[1:])]
    return sorted({int(h[0]) >> (64 - bits) for h in one + two})


def plain_ftrl(rows, epochs=4, alpha=2.0, beta=0.03, l1=0.002, l2=0.02):
    """Weights by the textbook rule, one number at a time; rows are (label, features) in training order."""
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, found = rows[k]
            x = {f: 1 / math.sqrt(max(len(found), 1)) for f in found} | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * x[f] for f in x)))
            for f in x:
                g = (p - label) * x[f]
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in n}


def plain_score(text, w):
    found = plain_features(text)
    margin = w.get("bias", 0.0) + (sum(w.get(f, 0.0) for f in found) / math.sqrt(len(found)) if found else 0.0)
    return 1 / (1 + math.exp(-margin))


def training_order(spark, labelled):
    """Rows (key, text, label) in the order of the sample: by the hash of the key."""
    turn = {r["k"]: r["t"] for r in spark.createDataFrame([(k,) for k, _, _ in labelled], "k long").distinct().select("k", F.xxhash64("k").alias("t")).collect()}
    return [(label, plain_features(text)) for k, text, label in sorted(labelled, key=lambda r: (turn[r[0]], r[2], plain_features(r[1])))]


def test_classifier_by_plain_ftrl(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in text and len(text[r["doc_id"]] or "") < 3000][:40]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    want = plain_ftrl(training_order(spark, [(k, text[k], label) for k, label in marks]), epochs=2)
    weights = quality.train_quality(docs, labels, epochs=2)
    assert weights[-1] == pytest.approx(want["bias"], abs=1e-5)
    assert all(weights[f] == pytest.approx(w, abs=1e-5) for f, w in want.items() if f != "bias")
    assert np.count_nonzero(weights[:-1]) == sum(w != 0 for f, w in want.items() if f != "bias")
    few = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(None, None), (5, ""), (6, "x" * 1_500_000)], "doc_id long, text string"))
    for r in quality.score_quality(few, weights).collect():
        if len(r["text"] or "") < 100_000:
            assert r["score"] == pytest.approx(plain_score(r["text"], want), abs=1e-4)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, sf).collect()}
    marks = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scored[r["doc_id"]]["held_out"]]
    right = [scored[r["doc_id"]]["predicted"] == r["quality"] for r in marks]
    assert len(marks) > 50 and sum(right) / len(right) > 0.93
    kept = [scored[r["doc_id"]]["predicted"] for r in marks if r["quality"] == 1]
    assert sum(kept) / len(kept) > 0.97


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 9.0), (2, None, 9.0), (None, "", 9.0), (2, "!!! $$$", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, 1), (1, None)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels)
    out = quality.score_quality(docs, weights).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    assert not quality.train_quality(docs, labels.where("false")).any()
    assert quality.score_quality(docs.where("false"), weights).count() == 0


def test_long_texts_train_on_all_features(spark):
    text = " ".join(f"w{k}x" for k in range(3000))
    weights = quality.train_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), epochs=1)
    raw = np.frombuffer(text.encode(), np.uint8)
    found = quality.features(raw, np.array([0, len(raw)]))[0]
    assert len(found) > 5000 and weights[found].all()


def test_training_rows_are_chosen_after_the_join(spark):
    docs = spark.createDataFrame([(1, f"text {k % 40}") for k in range(50)] + [(2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)] + [(k, 1) for k in range(100, 200)], "doc_id long, quality int")
    names = dict(key="doc_id", text="text", label="quality", bits=18)
    copies = lambda n: [r["copies"] for r in quality.training_rows(docs, labels, rows=n, **names).collect()]
    assert sum(copies(1000)) == 102 and len(copies(1000)) == 82 and sum(copies(30)) == 30 and sum(copies(2)) == 2


def test_ftrl_learns_a_rule():
    model = quality.Ftrl(4)
    for k in range(400):
        model.learn(*quality._inputs(np.array([k % 2, 2 + k % 5]), 4), k % 2)
    w = model.weights(np.arange(17))
    assert w[1] > 0 > w[0]


def test_transcripts_on_conversations(spark):
    sf = "/root/testdata/sf0.01"
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    blocks = transcripts.as_transcripts(conv)
    held = quality.held_out("conv_id")
    model = transcripts.fit(blocks.where(~held))
    got, want = {}, {}
    for r in transcripts.parse(blocks.where(held).drop("role"), model).collect():
        got.setdefault(r["conv_id"], {})[r["turn_no"]] = r["role"]
    for r in conv.where(held).collect():
        want.setdefault(r["conv_id"], {})[r["turn"]] = r["role"]
    same = sum(got[k].get(t) == role for k, v in want.items() for t, role in v.items())
    assert same / sum(map(len, want.values())) > 0.85


def test_viterbi_by_enumeration():
    import itertools

    r = np.random.default_rng(2)
    codes_of = (len(transcripts.ROLES) + 1) * transcripts.LENGTHS * transcripts.SHAPES
    model = np.log(r.random((1 + transcripts.STATES + codes_of, transcripts.STATES)) + 1e-3)
    step, emit = model[1 : 1 + transcripts.STATES], model[1 + transcripts.STATES :]
    for size in (1, 2, 4, 5):
        codes = r.integers(0, codes_of, size)

        def score(path, entry=-1):
            first = model[0] if entry < 0 else step[entry]
            return first[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:])) + sum(emit[c, s] for c, s in zip(codes, path))

        paths = list(itertools.product(range(transcripts.STATES), repeat=size))
        assert tuple(transcripts.viterbi(model, codes)) == max(paths, key=score)
        assert tuple(transcripts.viterbi(model, codes, 3, 1)) == max((p for p in paths if p[-1] == 1), key=lambda p: score(p, 3))
        best = transcripts.passage(model, codes, False)
        assert best[2, 4] == pytest.approx(max(score(p, 2) for p in paths if p[-1] == 4))
        assert transcripts.passage(model, codes, True)[5, 0] == pytest.approx(max(score(p) for p in paths if p[-1] == 0))


def test_transcripts_with_null_keys_ties_and_repeated_rows(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.as_transcripts(conv))
    rows = [(None, 0, "User: a"), (None, 1, "Assistant: b\nc"), (4, 0, "User: x?"), (4, 0, "User: x?"), (4, None, "System: s"), (9, 2, "")]
    out = transcripts.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("codes", F.lit("clash")), model).collect()
    lines = Counter()
    for r in out:
        lines[r["conv_id"]] += r["n_lines"]
    assert lines == {None: 3, 4: 3, 9: 1}
    four = sorted((r["turn_no"], r["body"]) for r in out if r["conv_id"] == 4)
    assert [k for k, _ in four] == list(range(len(four)))
    told = plain_turns(model, ["System: s", "User: x?", "User: x?"])  # null orders first, ties as read; a marker stays where the state opens no turn
    assert [(r["role"], r["n_lines"], r["rendered"]) for r in sorted(out, key=lambda r: r["turn_no"]) if r["conv_id"] == 4] == told


def test_marked_transcript_is_rendered(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.as_transcripts(conv))
    text = "User: Hi there\nAssistant: Hello.\nHow are you?\nUser: Fine"
    one = spark.createDataFrame([(1, 0, text), (2, None, None), (3, 0, "")], "conv_id long, turn long, text string")
    out = {(r["conv_id"], r["turn_no"]): r["rendered"] for r in transcripts.parse(one, model).collect()}
    assert out[1, 0] == "<|user|>\nHi there\n<|end|>" and out[1, 1] == "<|assistant|>\nHello.\nHow are you?\n<|end|>" and out[1, 2] == "<|user|>\nFine\n<|end|>"
    assert (2, 0) in out and (3, 0) in out
    assert transcripts.parse(one.where("false"), model).count() == 0


def test_long_transcript_in_chunks_is_the_whole_path(spark, monkeypatch):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.as_transcripts(conv))
    blocks = transcripts.as_transcripts(conv.where("conv_id < 40").withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.col("conv_id") % 2)).drop("role")
    whole = sorted(map(tuple, transcripts.parse(blocks, model).collect()))
    monkeypatch.setattr(transcripts, "CHUNK_LINES", 5)
    assert sorted(map(tuple, transcripts.parse(blocks, model).collect())) == whole


def plain_turns(model, blocks):
    """Turns of one transcript by a plain program: states of all lines at once, the marker cut where a turn opens."""
    import re

    lines = [line for block in blocks for line in (block or "").split("\n")]
    out = []
    for line, state in zip(lines, transcripts.viterbi(model, np.array([plain_code(line) for line in lines]))):
        opens = state < len(transcripts.ROLES)
        if opens:
            line = re.sub(transcripts.HEADING, "", re.sub(transcripts.MARKER, "", line, count=1), count=1)
        if opens or not out:
            out.append([transcripts.ROLES[state % len(transcripts.ROLES)], []])
        out[-1][1].append(line)
    return [(role, len(body), f"<|{role}|>\n" + "\n".join(body).strip(" ") + "\n<|end|>") for role, body in out]


def plain_code(line):
    import re

    found = re.search(transcripts.MARKER, line) or re.search(transcripts.HEADING, line)
    kind = next((k for k, role in enumerate(transcripts.ROLES, 1) if found and found[1].lower() in transcripts.MARKER_NAMES[role]), 0)
    size = min(int(math.log2(len(line) + 1)), transcripts.LENGTHS - 1)
    shape = 3 if not line.strip(" ") else 1 if re.search(r"\?\s*$", line) else 2 if re.search(r"^\s*(?:[-*\u2022]\s|\d+[.)]\s|```|\t| {4})", line) else 0
    return (kind * transcripts.LENGTHS + size) * transcripts.SHAPES + shape


def test_rendered_turns_by_a_plain_program(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.as_transcripts(conv))
    blocks = transcripts.as_transcripts(conv.where("conv_id < 60")).drop("role")
    held = [(1000, 0, "User: what is it?\nAnswer: is a word here\nA: too\nAssistant: well\nQ: inside"), (1001, 0, "### User\nhello\nAssistant:\nAssistant: twice"), (1002, 5, None), (1002, 6, "no marker\n\nbot: x")]
    blocks = blocks.unionByName(spark.createDataFrame(held, blocks.schema))
    told = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        told.setdefault(r["conv_id"], []).append(r["text"])
    got = {}
    for r in sorted(transcripts.parse(blocks, model).collect(), key=lambda r: r["turn_no"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["n_lines"], r["rendered"]))
    assert got == {k: plain_turns(model, v) for k, v in told.items()}


def test_no_text_but_markers_is_lost(spark):
    """Kept lines are the given ones, but that the opening line of a turn may have lost a marker."""
    import re

    model = np.log(np.full((1 + transcripts.STATES + 4 * transcripts.LENGTHS * transcripts.SHAPES, transcripts.STATES), 0.1))
    model[1:7, 3:] += 3  # further lines are likelier than new turns, whatever the markers say
    text = "\n".join(f"{name}: text {k}" for k, name in enumerate(["User", "Answer", "A", "Assistant", "Q", "System"] * 9))
    out = transcripts.parse(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), model).collect()
    body = [line for r in sorted(out, key=lambda r: r["turn_no"]) for line in r["body"].split("\n")]
    given = text.split("\n")
    opens, at = set(), 0
    for r in sorted(out, key=lambda r: r["turn_no"]):
        opens.add(at)
        at += r["n_lines"]
    assert len(opens) < 5 and [re.sub(transcripts.MARKER, "", x) if k in opens else x for k, x in enumerate(given)] == body


def test_a_block_of_very_many_lines(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.as_transcripts(conv))
    block = "\n".join("User: a line" if k % 50 == 0 else "Assistant: more of it" if k % 50 == 25 else f"further {k}" for k in range(200_000))
    out = transcripts.parse(spark.createDataFrame([(1, 0, block), (2, 0, "User: x")], "conv_id long, turn long, text string"), model)
    n = out.groupBy("conv_id").agg(F.sum("n_lines").alias("lines"), F.count("*").alias("turns"), F.sum(F.length("body")).alias("size"))
    assert {(r["conv_id"], r["lines"]) for r in n.collect()} == {(1, 200_000), (2, 1)}
