"""From raw documents to packed sequences: five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.llm.common import cut, table
from vintara.llm.decontaminate import decontaminate
from vintara.llm.line_dedup import remove_spread_lines
from vintara.llm.near_dup import near_duplicates
from vintara.llm.packing import pack_documents
from vintara.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts (score of 0.7 or more)."""
    return classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines of any length; every document stays, with what is left of its text and its new length."""
    cleaned = remove_spread_lines(docs.select(*COLUMNS), min_sites=8, min_bytes=None)
    return cleaned.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five words, similarity 0.8 or more): the one with the smallest id.

    Rows without an id come after those with one; of rows alike in their id the first as read stays.
    Documents without words belong to no group and stay. Rows are numbered once and written with
    their numbers, so the input may come from a shuffle.
    """
    numbered = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    keyed = numbered.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"), "text")
    kept = near_duplicates(keyed, key="key", width=5, threshold=80).where("kept").select("key.row")
    return numbered.join(kept, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, within its edit budget."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens; a row for each piece."""
    return pack_documents(docs, size=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer are beyond SQL, so tests/llm holds the pipeline against a plain program, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
