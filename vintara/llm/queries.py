"""The queries of this subpackage: opN_<name> over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.llm.common import table
from vintara.llm.decontaminate import find_leaks
from vintara.llm.embedding_dup import embedding_duplicates
from vintara.llm.hard_negatives import hard_negatives
from vintara.llm.lattice_lm import score_texts
from vintara.llm.line_dedup import remove_spread_lines
from vintara.llm.near_dup import near_duplicates
from vintara.llm.packing import pack_documents
from vintara.llm.quality import classify, held_out
from vintara.llm.scaled_sketch import edited_fingerprints
from vintara.llm.sharding import shard_documents
from vintara.llm.suffix_dedup import remove_repeats
from vintara.llm.token_align import align_tokens
from vintara.llm.transcripts import as_transcripts, fit, parse


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), length=400).drop("kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2, threshold=80)


def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), shards=24)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", folds=7, fold=2)
    scored = score_texts(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), ~out, group="lang")
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.9)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.7)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.transform("matches", lambda m: m["item_id"])
    return leaks.select("doc_id", (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), size=2048, end_id=1, max_segments=16, max_loss=2044)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_spread_lines(table(spark, sf_dir, "documents", "doc_id", "text", "source"), min_sites=8, min_bytes=None)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = as_transcripts(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    model = fit(blocks.where(~held_out("conv_id")))
    turns = parse(blocks.drop("role"), model)
    return turns.select("conv_id", held_out("conv_id").alias("held_out"), "turn_no", "role", "n_lines", F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    coded = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("codes"))
    return hard_negatives(coded, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


def op12_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_virtual_slot_sharding": op3_virtual_slot_sharding,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_vector_packing": op8_vector_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_scaled_fingerprints": op12_scaled_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}

#: Links (a, b) in both directions to each node's component; nodes come from ``ids``.
_REACH = """
reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), listed AS (
            SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM worded
        ), shingle AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM listed), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        linked AS (SELECT a, b FROM shared x JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * x.n >= 80 * (p.n + q.n - x.n)),
        links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN component c ON c.id = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
    """,
    "op5_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ids AS (SELECT id FROM v),
        usable AS (SELECT id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9), {_REACH}
        SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept FROM component c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.id
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
        ), spread AS (
            SELECT line, min(doc_id) AS first_doc FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 8
        ), judged AS (
            SELECT l.doc_id, l.line, l.pos, s.line IS NOT NULL AND l.doc_id <> s.first_doc AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
        )
        SELECT d.doc_id, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_removed, 0)::BIGINT AS n_removed, md5(coalesce(j.kept, '')) AS kept_md5
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
        ) j USING (doc_id)
    """,
    "op11_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS s
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        ), positive AS (SELECT a, b, s FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        negative AS (
            SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
            FROM positive p JOIN scored n ON p.a = n.a AND NOT n.alike AND 80 * p.s <= 100 * n.s AND n.s <= p.s
        )
        SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM negative WHERE r <= 5
    """,
}

#: All 400-byte windows by their MD5; the windows that start more than once cover what goes.
ORACLE_SQL["op1_suffix_dedup"] = """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
    windows AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, n_bytes - 398)) AS i FROM d WHERE n_bytes >= 400)),
    hit AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) r ON r.h = windows.h),
    run AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
    span AS (SELECT doc_id, min(i) AS s, max(i) + 399 AS e FROM run GROUP BY doc_id, k),
    edge AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a FROM span UNION ALL SELECT doc_id, n_bytes + 1, coalesce(m, 0) + 1 FROM d LEFT JOIN (SELECT doc_id, max(e) AS m FROM span GROUP BY doc_id) USING (doc_id)),
    kept AS (SELECT doc_id, string_agg(hex(array_slice(b, a, s - 1)), '' ORDER BY a) AS x FROM edge JOIN d USING (doc_id) WHERE a < s GROUP BY doc_id)
    SELECT d.doc_id, n_bytes, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
    FROM d LEFT JOIN (SELECT doc_id, sum(e - s + 1) AS n, count(*) AS k FROM span GROUP BY doc_id) r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
