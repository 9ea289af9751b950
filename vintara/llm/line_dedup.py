"""Cross-site line deduplication with HyperLogLog sketches (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import cut

SKETCH_LOG2 = 12
#: The sketch's relative standard error at 2 ** 12 registers is under 0.017; estimates within this share of the threshold are counted exactly.
NEAR = 0.15


def judged(line: Column, min_bytes: int | None) -> Column:
    """Whether a line can be boilerplate: at least ``min_bytes`` bytes long or, with None, anything but white space."""
    return line.rlike(r"[^\x20\x09-\x0D]") if min_bytes is None else F.octet_length(line) >= min_bytes


def spread_lines(docs: DataFrame, *, key: str, text: str, site: str, min_sites: int, min_bytes: int | None) -> DataFrame:
    """(line_id, first_key) of the lines found on at least ``min_sites`` distinct sites.

    Lines are the pieces between line feeds that are ``judged``; a line's id is its MD5. Each id's HyperLogLog sketch of sites is built per task and merged by aggregation, so a
    line found in a third of all rows moves one sketch per task. Only ids whose estimate is near
    the threshold get an exact count of their distinct (id, site) pairs.
    """
    lines = docs.select(F.col(key).alias("k"), F.col(site).alias("s"), F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    lines = lines.where(judged(F.col("line"), min_bytes) & F.col("s").isNotNull()).select("k", "s", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line_id"))
    seen = lines.groupBy("line_id").agg(F.hll_sketch_agg("s", SKETCH_LOG2).alias("sketch"), F.min("k").alias("first_key"))
    seen = cut(seen.select("line_id", "first_key", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR)))
    sure = seen.where(F.col("sites") > min_sites * (1 + NEAR)).select("line_id", "first_key")
    near = seen.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line_id", "first_key")
    pairs = lines.join(near.select("line_id"), "line_id", "left_semi").groupBy("line_id", "s").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line_id").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact, "line_id").select("line_id", "first_key"))


def remove_spread_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, min_bytes: int | None = None, out: str = "kept_text") -> DataFrame:
    """``docs`` with three more columns: ``out`` (the text left), n_lines and n_removed.

    A line on ``min_sites`` or more distinct sites is boilerplate: it is removed everywhere but in
    the document with the smallest key among those that have it and a site, so no content leaves
    the corpus altogether. Lines shorter than ``min_bytes`` bytes always stay; with None every line
    but the blank ones is judged. Rows without a site count for no spread and keep no line for the
    others, but lose boilerplate too. A null text stays null with no lines; an empty text is one
    empty line. A null key is never the first; rows repeated with one key, or without one, are
    told apart by their texts. Extra columns pass through, whatever their names other
    than the three new ones.
    """
    flagged = cut(spread_lines(docs, key=key, text=text, site=site, min_sites=min_sites, min_bytes=min_bytes))
    base = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tk"), F.col(text).alias("t"), F.struct(*docs.columns).alias("row"))
    lines = base.select("k", "tk", F.explode(F.split("t", "\n", -1)).alias("line")).where(judged(F.col("line"), min_bytes))
    lines = lines.select("k", "tk", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line_id"))
    hit = lines.join(flagged, "line_id").where(~F.col("k").eqNullSafe(F.col("first_key")))
    by_doc = hit.groupBy(F.col("k").alias("hk"), F.col("tk").alias("ht")).agg(F.collect_set("line_id").alias("cut"))
    both = base.join(by_doc, F.col("k").eqNullSafe(F.col("hk")) & (F.col("tk") == F.col("ht")), "left")
    every = F.split("t", "\n", -1)
    none = F.array().cast("array<binary>")
    kept = F.filter(every, lambda x: ~(judged(x, min_bytes) & F.array_contains(F.coalesce(F.col("cut"), none), F.unhex(F.md5(x.cast("binary"))))))
    both = both.withColumn("kept", F.when(F.col("cut").isNull(), every).otherwise(kept))
    return both.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in (out, "n_lines", "n_removed")],
        F.array_join("kept", "\n").alias(out),
        F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_lines"),
        (F.coalesce(F.size(every), F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias("n_removed"),
    )


__all__ = ["judged", "remove_spread_lines", "spread_lines"]
