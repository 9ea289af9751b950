"""Suffix-order removal, near duplicates, embeddings, lines and components against brute force, with the odd cases of each."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import embedding_dup, graph, line_dedup, near_dup, suffix_dedup, textvec

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, data, length=400):
    got = sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(data, DOCS), length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    want = sorted((k, *rest) for (k, _), rest in zip(data, brute_repeats([t for _, t in data], length)))
    assert got == want


def test_repeats_on_the_documents(spark):
    check_repeats(spark, [(r["doc_id"], r["text"]) for r in documents(spark).collect()])


def test_repeats_in_odd_texts(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(300)
    data = [(1, None), (2, ""), (3, "a" * 3000), (4, "ab" * 900), (5, base), (6, base), (7, base[:1000] + "é" + base[1001:]), (8, base[100:499]), (9, base[100:500]), (10, prose(60) + base[700:1200] + prose(60)), (11, "x" * 399), (12, "y" * 400)]
    check_repeats(spark, data)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    r = random.Random(5)
    text = [r.choice("abcdefghij ") for _ in range(1500)]
    data = []
    for k in range(40):
        copy = list(text)
        for _ in range(3):
            copy[r.randrange(len(copy))] = r.choice("XYZ")
        data.append((k, "".join(copy)))
    check_repeats(spark, data)


def test_repeats_with_null_and_repeated_keys_and_clashing_columns(spark):
    base = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(300))
    rows = [(None, base, 1), (None, base, 2), (7, base, 3), (7, "short", 4)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, tkey long"))
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out.collect()) == [(5, 0)] + [(len(base), len(base))] * 3


def test_longest_previous_factors():
    r = random.Random(1)
    for _ in range(20):
        t = bytes(r.choice(b"ab") for _ in range(r.randint(0, 40)))
        order = suffix_dedup.suffix_order(np.frombuffer(t, np.uint8), np.full(len(t), len(t)), max(len(t), 1))[0] if t else np.zeros(0, np.int64)
        assert [t[i:] for i in order] == sorted(t[i:] for i in range(len(t)))
        common = suffix_dedup.common_prefixes(t, order)
        for later in (False, True):
            length, source = suffix_dedup.longest_previous_factors(order, common, later)
            for i in range(len(t)):
                others = range(i + 1, len(t)) if later else range(i)
                best = max((next((k for k in range(len(t) - max(i, j)) if t[j + k] != t[i + k]), len(t) - max(i, j)) for j in others), default=0)
                assert length[i] == best
                if best:
                    assert source[i] in others and t[source[i] : source[i] + best] == t[i : i + best]


def thue_morse(bits):
    """Two different words with one hash under every polynomial with an odd base modulo 2**64."""
    a, b = "a", "b"
    for _ in range(bits):
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_texts_apart_that_defeat_polynomials(spark):
    for bits in (3, 7, 8, 11, 12):
        a, b = (x.encode() for x in thue_morse(bits))
        data = np.frombuffer(a + b, np.uint8)
        x, y = textvec.hash_spans(data, np.array([0, len(a)]), np.array([len(a), len(data)]))
        assert x != y
    a, b = thue_morse(11)
    got = near_dup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], DOCS), width=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 1)]
    check_repeats(spark, [(1, a), (2, b), (3, "c" * 200 + a[:900]), (4, b[500:1100])])


def test_spans_hash_by_their_bytes_wherever_they_stand():
    r = random.Random(9)
    raw = bytes(r.randrange(256) for _ in range(5000))
    spans = [(a := r.randrange(4900), a + r.choice([0, 1, 7, 8, 9, 31, 64])) for _ in range(500)]
    alone = [int(textvec.hash_spans(np.frombuffer(raw[a:b], np.uint8), np.array([0]), np.array([b - a]))[0]) for a, b in spans]
    together = textvec.hash_spans(np.frombuffer(raw, np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert alone == [int(x) for x in together]
    assert len({raw[a:b] for a, b in spans}) == len(set(alone))


def test_repeats_in_a_text_of_several_megabytes(spark):
    r = random.Random(12)
    prose = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2_300_000))
    passage = prose[1_048_300:1_049_400]  # across the border of two stretches
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, prose), (2, passage), (3, prose[500_000:500_450])], DOCS)).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["n_spans"]) for x in out) == [(1, 1100 + 450, 2), (2, 1100, 1), (3, 450, 1)]


def shingles(text, width):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_near(data, width, threshold=80):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(data[i][0])
    return sorted((k, len(s), min(groups[find(i)])) for i, ((k, _), s) in enumerate(zip(data, sets)))


def check_near(spark, data, width):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(data, DOCS), width=width).collect())
    assert got == brute_near(data, width)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_on_the_documents(spark, width):
    check_near(spark, [(r["doc_id"], r["text"]) for r in documents(spark).collect()], width)


def test_near_duplicates_at_the_threshold_and_in_odd_texts(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    data = [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "one"), (105, "ONE two"), (106, "one\x0btwo"), (107, "É"), (108, "é")]
    for k in range(90):
        n = r.randint(4, 26)
        at = r.randrange(3)
        w = words[at * 20 : at * 20 + n]
        if r.random() < 0.7:
            w[r.randrange(len(w))] = f"x{k}"
        data.append((k, " ".join(w)))
    check_near(spark, data, 2)
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_stars_alone_lose_no_link(spark, monkeypatch):
    """A chain in which hubs are often unlike both ends, in blocks of three."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 3)
    words = [f"w{k}" for k in range(140)]
    data = [(k, " ".join(words[k : k + 40])) for k in range(0, 100, 3)] + [(500 + k, " ".join(words[k : k + 38] + ["z", "y"])) for k in range(0, 90, 7)]
    check_near(spark, data, 2)


def test_near_duplicates_with_null_and_repeated_keys(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, 1), (4, text, 1), (4, "other words here", 1), (9, text + " more", 1), (9, text + " more", 1)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long"), width=2).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in out) == [(-1, 29, 4), (4, 2, 4), (4, 29, 4), (9, 30, 4), (9, 30, 4)]


def test_variants_of_one_original_with_many_null_keys(spark, monkeypatch):
    """Variants that are near the original and far from each other, under one null key: every class finds its own text."""
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words))]
    for k in range(40):
        variant = list(words)
        for at in r.sample(range(60), 2):
            variant[at] = f"x{k}"
        rows.append((None, " ".join(variant)))
    rows += [(7, rows[3][1]), (8, rows[30][1]), (9, "something else")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), width=2).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"]) for x in out) == [(-1, 7)] * 41 + [(7, 7), (8, 7), (9, 9)]


def test_largest_components_are_not_paired_with_themselves(spark):
    rows = [(1, k, 0) for k in range(10_000)] + [(1, 10_000 + k, 1 + k) for k in range(3)] + [(2, k, k) for k in range(4)]
    cells = near_dup._in_blocks(spark.createDataFrame(rows, "bucket long, id long, component long"), "bucket", 100)
    assert cells.where("bucket = 1").count() == 10_000 + 3 * 101
    met = cells.alias("x").join(cells.alias("y"), "cell").where("x.bucket = 2 and x.id < y.id and (x.same or x.side <> y.side)").count()
    assert met == 6


def test_components_in_shuffled_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 40)
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for x in list(root):
        least[find(x)] = min(least[find(x)], x)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[find(x)] for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(data, threshold=0.9):
    ok, unit = [], []
    for _, v in data:
        a = np.array(v if v is not None and all(x is not None for x in v) else [], float)
        good = len(a) > 0 and np.isfinite(a).all() and a.any()
        ok.append(good)
        unit.append(a / np.linalg.norm(a) if good else None)
    n = len(data)
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return sorted((data[i][0], sum(link[i]), data[label[i]][0]) for i in range(n))


@pytest.mark.parametrize("block", [7, 4096])
def test_embeddings(spark, block):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16)).astype(np.float32)
    vectors = [base[k % 12] + r.normal(size=16).astype(np.float32) * 0.28 * (k % 4) for k in range(70)]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(70, None), (71, []), (72, [0.0] * 16), (73, [float("nan")] + [1.0] * 15), (74, [1.0, None]), (75, [1e30] * 16), (76, [2e30] * 16), (77, [1.0] * 8), (78, [2.0] * 8), (79, [1.0] * 16), (80, [1.0] * 16)]
    got = embedding_dup.embedding_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>"), block=block).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == brute_vectors(data)
    assert embedding_dup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bound_never_misses():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 24))
    y = x + r.normal(size=x.shape) * 0.45
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    true = {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= 0.9))}
    i, j = embedding_dup.possible(embedding_dup.quantise(x), embedding_dup.quantise(y), 0.9)
    assert true and true <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 3 * len(true) + 50


def test_lines(spark):
    long = "This boilerplate line is long enough to count."
    data = [(k, f"own line {k} that is certainly long enough to count\n{long}\nshort", f"s{k % 5}") for k in range(10)] + [(20, None, "s0"), (21, "", "s1"), (22, long, None), (None, long + "\nx", "s3"), (0, long, "s9")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("line", F.lit("clash")).withColumn("cut", F.lit(1)).withColumn("row", F.lit(2))
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.remove_spread_lines(docs, min_sites=5, min_bytes=40).collect()}
    assert len(out) == len(data)
    first = [r for k, r in out.items() if k[0] == 0]
    assert all(r["n_removed"] == 0 for r in first)
    assert all(out[k, t]["n_removed"] == 1 and long not in out[k, t]["kept_text"] for k, t, _ in data[1:10])
    assert out[20, None]["kept_text"] is None and out[21, ""]["kept_text"] == "" and out[22, long]["kept_text"] == ""
    assert out[None, long + "\nx"]["kept_text"] == "x" and out[20, None]["cut"] == 1 and out[20, None]["row"] == 2
    untouched = line_dedup.remove_spread_lines(docs, min_sites=7, min_bytes=40)
    assert untouched.agg(F.sum("n_removed")).first()[0] == 0


def test_short_lines_and_rows_without_a_site(spark):
    rows = [(k, f"mine {k}\nAll rights reserved.\n \n", f"s{k % 9}") for k in range(9, 27)] + [(1, "All rights reserved.", None), (None, "All rights reserved.\nq", "s1"), (None, "other", "s2")]
    out = line_dedup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8).collect()
    got = {(r["doc_id"], r["text"]): r["kept_text"] for r in out}
    assert got[9, rows[0][1]] == rows[0][1] and got[10, rows[1][1]] == "mine 10\n \n" and got[1, rows[-3][1]] == ""
    assert got[None, rows[-2][1]] == "q" and got[None, "other"] == "other"


def test_words_of_many_rows():
    import pyarrow as pa

    texts = ["Ab cd", "", None, "ef", " g\th ", "ab"]
    data, offsets = textvec.text_buffer(pa.array(texts))
    row, start, end, h = textvec.words(data, offsets)
    assert row.tolist() == [0, 0, 3, 4, 4, 5] and [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["Ab", "cd", "ef", "g", "h", "ab"]
    assert h[0] == h[5] and len(set(h.tolist())) == 5
