"""Exact dedup with a heavy-hitter split.

Every row's digest is computed once. A mergeable frequent-items summary of the Misra-Gries family
(``approx_top_k``) finds the digests that may be frequent; their true counts are then taken, and
the verified winners, at most ``heavy_items`` rows, are broadcast for map-side resolution. All other digests go
through an ordinary shuffle, in which no key can hold more than a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

#: Counters of the summary (a power of two) and the most winners it can give. Both bound the broadcast.
TRACKED, HEAVY_ITEMS = 8192, 1024


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the UTF-8 text; a null text counts as empty."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, heavy_items: int = HEAVY_ITEMS, tracked: int = TRACKED, heavy_rows: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty; nothing else is changed) the row with the largest doc_id stays.
    A null doc_id is kept only if no other copy has one. Repeated rows with the same doc_id and text are
    each reported; they count in group_size. An empty table gives an empty result.
    """
    keyed = written(digests(docs), "digests")
    frequent = (
        keyed.select(F.explode(F.expr(f"approx_top_k(text_sha256, {heavy_items}, {tracked})")).alias("top"))
        .select(F.col("top.item").alias("text_sha256"))
    )
    # Verified: exact counts replace the summary's estimates before anything is decided by them.
    heavy = written(
        keyed.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= heavy_rows),
        "winners",
    )
    mapped = keyed.join(F.broadcast(heavy), "text_sha256")
    rest = keyed.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    sizes = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shuffled = rest.join(sizes, "text_sha256")
    return mapped.unionByName(shuffled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; repeated rows of one doc_id and text leave one."""
    groups = exact_groups(docs.select("doc_id", "text"), **options)
    losers = written(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct(), "losers")
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("_sha"))
    left = whole.join(losers, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left_anti")
    return left.dropDuplicates(["_doc_id", "_sha"]).select("_doc.*")
