"""Fingerprints, token alignment and hard negatives against brute force, with the odd cases of each."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import hard_negatives, queries, scaled_sketch, textvec, token_align

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def shingles(text, width=5):
    raw = np.frombuffer(text.encode(), np.uint8)
    return set((textvec.shingle_sets(raw, np.array([0, len(raw)]), width)[0] >> np.uint64(16)).tolist())


def brute_sketch(text, scale=16, floor=16):
    every = sorted(shingles(text))
    return np.array([h for k, h in enumerate(every) if h < (1 << 48) // scale or k < floor], np.int64)


def check_fingerprints(rows, out):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    for (k, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        a, e, f = (brute_sketch(t) for t in (text, edited, following))
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (scaled_sketch.encode(a), scaled_sketch.encode(e))
        assert (scaled_sketch.decode(r["fingerprint"]) == a).all()
        assert (r["near_edited"], r["resemblance_edited"]) == scaled_sketch.likeness(a, e)
        assert (r["near_next"], r["resemblance_next"]) == scaled_sketch.likeness(a, f)


def test_fingerprints_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op12_scaled_fingerprints(spark, SF).collect()
    check_fingerprints([(r["doc_id"], r["text"]) for r in docs.collect()], out)
    near = [r["near_edited"] for r in out if r["n_chars"] > 400]
    assert 0.5 < np.mean(near) < 0.85 and np.mean([r["near_next"] for r in out]) < 0.2


def test_fingerprints_of_odd_texts(spark):
    words = " ".join(f"w{k}" for k in range(4000))
    rows = [(9, None), (8, ""), (7, "é" * 10), (6, "a b"), (5, words), (4, words), (3, words[:200]), (2, "A B"), (1, " \n "), (None, "unkeyed " * 30)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_text", F.lit("clash")).withColumn("part", F.lit(1))
    out = scaled_sketch.edited_fingerprints(docs).collect()
    check_fingerprints(rows, out)
    by = {r["doc_id"]: r for r in out}
    assert by[5]["near_next"] == 1.0 and by[5]["fingerprint"] == by[4]["fingerprint"] and by[9]["near_next"] == 1.0 and by[8]["near_next"] == 0.0
    check_fingerprints(rows, scaled_sketch.edited_fingerprints(docs.repartition(7)).collect())
    one = scaled_sketch.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g")], DOCS)).collect()
    check_fingerprints([(1, "a b c d e f g")], one)
    assert scaled_sketch.edited_fingerprints(docs.where("false")).count() == 0
    assert scaled_sketch.edited_fingerprints(spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "z")], DOCS)).count() == 4


def test_sketches_merge_and_measure_containment(spark):
    r = np.random.default_rng(4)
    vocabulary = [f"word{k}" for k in range(5000)]
    parts = [" ".join(r.choice(vocabulary, 900)) for _ in range(6)] + ["only three words", "", None]
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(parts)], f"{DOCS}, side int")
    told = scaled_sketch.sketches(docs).join(docs.select("doc_id", "side"), "doc_id")
    union = {g: set().union(*(shingles(parts[k]) for k in range(9) if k % 2 == g and parts[k])) for g in (0, 1)}
    got = scaled_sketch.merged(told, "side").groupBy("side").agg(F.sort_array(F.collect_list("hash")).alias("s")).collect()
    for row in got:
        every = np.array(sorted(union[row["side"]]), np.int64)
        assert (np.array(row["s"]) == scaled_sketch.retained(every)).all()
    whole = " ".join(parts[:6])
    pair = scaled_sketch.sketches(spark.createDataFrame([(0, parts[0]), (1, whole)], DOCS))
    a, b = (pair.where(f"doc_id = {k}").select(F.col("sketch").alias(n)) for k, n in ((0, "a"), (1, "b")))
    row = a.join(b, F.lit(True)).select(scaled_sketch.contained(F.col("a"), F.col("b")).alias("x"), scaled_sketch.contained(F.col("b"), F.col("a")).alias("y")).first()
    assert row["x"] == 1.0 and abs(row["y"] - 1 / 6) < 0.08


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def brute_alignment(rows, sides):
    """Per document: (n_a, n_b, groups as text, links), by sets of byte offsets and all pairs that overlap."""
    a, b = sides
    alphabet = token_align.byte_alphabet()
    told = []
    for key, text in rows:
        none = (key, 0, 0, [], [])
        if not text:
            told.append(none)
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            told.append(none)
            continue
        spans = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            at, found = 0, []
            for i, r in zip(ids, raw):
                found.append((at, at + len(r), i))
                at += len(r)
            spans.append(found)
        links, low = [], 0
        for s, e, i in spans[0]:
            while spans[1][low][1] <= s:
                low += 1
            for s2, e2, j in spans[1][low:]:
                if s2 >= e:
                    break
                links.append((i, j))
        stops = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for low, high in zip([0, *stops], stops):
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans) if len(whole) < 3000 else None)
        told.append((key, len(ids_a), len(ids_b), groups, links))
    count = Counter(p for *_, links in told for p in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for key, n_a, n_b, groups, links in told:
        digest = "" if not links else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


def check_alignment(rows, out, sides):
    want = brute_alignment(rows, sides)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in out]
    order = lambda rows: sorted(rows, key=repr)
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


def test_alignment_of_the_documents(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_alignment([(r["doc_id"], r["text"]) for r in docs.collect()], queries.op13_token_alignment(spark, SF).collect(), sides)


def test_alignment_of_odd_texts(spark, sides):
    odd = ["", None, " ", "  two  spaces ", "a\nb", "a \n b", "tab\there", "end\n", "<|endoftext|> is plain", "</s><s><unk>", "<0x41>", "sub\u2581word", "caf\u00e9 na\u00efve \u4f60\u597d \U0001f600!", "e\u0301 \u00a0x \u3000 y", "a\x00b", "1234567890 " * 40, "antidisestablishmentarianism" * 9, "x" * 2500, "don't  can't we'll", "\ufeffbom", "word", "word", "Word word"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "word"), (None, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("stretch", F.lit("clash")).withColumn("n_a", F.lit(9))
    check_alignment(rows, token_align.align_tokens(docs).collect(), sides)
    check_alignment(rows, token_align.align_tokens(docs.repartition(5), stretch=40).collect(), sides)
    assert token_align.align_tokens(docs.where("false")).count() == 0


def test_pointer_jumping_on_long_chains():
    ends_a = np.arange(2, 2002, 2)
    ends_b = np.concatenate((np.arange(1, 2000, 2), [2000]))
    a, b = token_align.label_groups(ends_a, ends_b)
    assert set(a) == set(b) == {0}
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(np.append(r.choice(np.arange(1, 200), r.integers(1, 60)), 200)) for _ in range(2))
        common = np.intersect1d(x, y)
        a, b = token_align.label_groups(x, y)
        assert (a == np.searchsorted(common, x)).all() and (b == np.searchsorted(common, y)).all()


def brute_negatives(rows, anchors, k=5, low=80, high=100):
    """Rows are (id, label, codes); one row an id."""
    out = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in rows if b != a and len(x) == len(y))
        for s, p in [(-s, b) for s, b, other in scored if other == label][:k]:
            near = [(b, -n) for n, b, other in scored if other != label and low * s <= high * -n <= high * s][:k]
            out += [(a, p, r, b, s, n) for r, (b, n) in enumerate(near, 1)]
    return sorted(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def found(frame):
    return sorted(tuple(r[c] for c in NEGATIVES) for r in frame.collect())


@pytest.mark.parametrize("sizes", [(65_536, 65_536), (37, 3)])
def test_hard_negatives_against_brute_force(spark, sizes):
    r = np.random.default_rng(6)
    centre = r.normal(size=(4, 12))
    rows = [(k, int(c), [int(v) for v in np.floor(40 * (centre[c] + 0.5 * r.normal(size=12)))]) for k in range(400) for c in [r.integers(0, 4)]]
    rows += [(400 + k, int(k % 3), rows[7][2]) for k in range(60)] + [(500, 0, [0] * 12), (501, 1, [0] * 12), (502, 0, [3, 4]), (503, 1, [3, 4]), (504, 0, [2, 4]), (505, 2, []), (506, 0, []), (507, 2, [])]
    rows += [(600, 0, [1 << 29] * 12), (601, 0, [(1 << 29) + 1] * 12), (602, 1, [(1 << 29) - 1] * 12)]
    anchors = {k for k in range(0, 700, 9)} | {500, 502, 505, 600}
    odd = [(None, 0, [1] * 12), (701, None, [1] * 12), (702, 0, None), (703, 0, [1] * 11 + [None]), (7, 9, rows[7][2])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, codes array<long>").withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(0))
    asked = F.col("vec_id").isin(*anchors)
    assert found(hard_negatives.hard_negatives(frame, asked, rows=sizes[0], block=sizes[1])) == brute_negatives(rows, anchors)
    assert hard_negatives.hard_negatives(frame.where("false"), asked).count() == 0 == hard_negatives.hard_negatives(frame, F.lit(False)).count()


def test_hard_negatives_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_hard_negatives"])
    at = [want.columns.index(c) for c in NEGATIVES]
    assert found(queries.op11_hard_negatives(spark, SF)) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def test_best_first_opens_few_boxes():
    r = np.random.default_rng(8)
    points = np.floor(256 * (np.repeat(r.normal(size=(64, 6)), 128, axis=0) + 0.05 * r.normal(size=(64 * 128, 6))))
    tree = hard_negatives.Tree(np.arange(len(points)), points)
    for q in points[::1000]:
        got, leaves = hard_negatives.best_first([tree], q, np.array([-np.inf]), np.array([np.inf]), 5, -1)
        order = np.lexsort((np.arange(len(points)), -(points @ q)))[:5]
        assert [i for _, i in got[0]] == order.tolist() and leaves < len(points) / hard_negatives.LEAF / 4
