"""Every operator and stage gives the rows of the plain scan whatever form its input comes in: shuffled, coalesced, or from many files."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vintara.llm import decontaminate, embedding_dup, hard_negatives, lattice_lm, line_dedup, near_dup, packing, quality, scaled_sketch, sharding, suffix_dedup, token_align, transcripts

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def coded(rows):
    codes = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return hard_negatives.hard_negatives(rows.select("vec_id", "label", codes.alias("codes")), F.col("vec_id") % 10 == 0)


def scored(docs):
    rows = lattice_lm.score_texts(docs, F.pmod(F.col("doc_id"), F.lit(5)) != 0, group="lang")
    return rows.select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base"), F.round("score", 3).alias("score"))


#: table, key, and what is taken of the operator's result; packing and sharding place rows freely within their laws, so what they may not change is compared.
OPERATORS = {
    "op1": ("documents", "doc_id", lambda d: suffix_dedup.remove_repeats(d.select("doc_id", "text"))),
    "op2": ("documents", "doc_id", lambda d: near_dup.near_duplicates(d, width=2)),
    "op3": ("documents", "doc_id", lambda d: sharding.shard_documents(d).select("doc_id", "size", "text_crc32", "law")),
    "op4": ("documents", "doc_id", scored),
    "op5": ("embeddings", "vec_id", lambda d: embedding_dup.embedding_duplicates(d)),
    "op7": ("documents", "doc_id", lambda d: decontaminate.find_leaks(d.select("doc_id", "text"), read(d.sparkSession, "benchmark"))),
    "op8": ("documents", "doc_id", lambda d: packing.pack_documents(d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
    "op9": ("documents", "doc_id", lambda d: line_dedup.remove_spread_lines(d, min_sites=3)),
    "op11": ("embeddings", "vec_id", coded),
    "op12": ("documents", "doc_id", scaled_sketch.edited_fingerprints),
    "op13": ("documents", "doc_id", token_align.align_tokens),
}


def forms(frame, key, folder):
    frame.repartition(13).write.mode("overwrite").parquet(folder)
    shuffled = frame.groupBy(key).agg(*[F.first(c).alias(c) for c in frame.columns if c != key]).select(*frame.columns)
    return {"shuffled": shuffled, "coalesced": frame.repartition(5).coalesce(1), "many files": frame.sparkSession.read.parquet(folder)}


def rows(frame):
    names = sorted(frame.columns)
    return sorted((repr([r[n] for n in names]) for r in frame.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_any_form_of_input(spark, tmp_path, name):
    table, key, run = OPERATORS[name]
    plain = read(spark, table)
    want = rows(run(plain))
    for form, frame in forms(plain, key, str(tmp_path / "files")).items():
        assert rows(run(frame)) == want, form


def test_transcripts_on_any_form_of_input(spark, tmp_path):
    blocks = transcripts.as_transcripts(read(spark, "conversations")).drop("role")
    model = transcripts.fit(transcripts.as_transcripts(read(spark, "conversations")))
    want = rows(transcripts.parse(blocks, model))
    blocks.repartition(7).write.parquet(str(tmp_path / "files"))
    for frame in (blocks.repartition(6, "text"), blocks.repartition(3).coalesce(1), spark.read.parquet(str(tmp_path / "files"))):
        assert rows(transcripts.parse(frame, model)) == want


def test_stages_on_any_form_of_input(spark, tmp_path):
    plain = read(spark, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        take = (lambda f: f.select("doc_id", "start", "length", "ids_crc32")) if name == "packing" else (lambda f: f)
        want = rows(take(stage(spark, plain, SF)))
        for form, frame in forms(plain, "doc_id", str(tmp_path / f"files{k}")).items():
            assert rows(take(stage(spark, frame, SF))) == want, (name, form)


def test_quality_scores_on_any_form_of_input(spark, tmp_path):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    run = lambda d: quality.classify(d, labels).select("doc_id", F.round("score", 6).alias("score"))
    want = rows(run(docs))
    for form, frame in forms(docs, "doc_id", str(tmp_path / "files")).items():
        assert rows(run(frame)) == want, form
