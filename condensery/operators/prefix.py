"""Values of the row before and running sums over a document's rows, in two levels, so that a document of any length is many tasks' work.

Rows are cut into parts of so many places. Within parts a window works as usual; each part gives one carry row; a window over a document's carry rows, of which there are few, tells
each part what comes in from before it, and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Places of a part: rows of a document that one task's window takes.
BLOCK = 1 << 16


def parted(rows: DataFrame, block: int) -> DataFrame:
    return rows.withColumn("_part", F.expr(f"idx div {block}"))


def joined_back(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with the carry of their parts, null where there is none; most documents have one part and no carry."""
    own = carry.filter("_carry IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("_part").alias("_at"), "_carry")
    return rows.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_at")), "left").drop("_doc", "_at", "_part")


def previous(rows: DataFrame, block: int = BLOCK, **values: Column) -> DataFrame:
    """``rows`` (doc_id, idx) with, under each name, what the row before it in its document has as that value; null for a document's first row."""
    cut = parted(rows.withColumn("_value", F.struct(*(v.alias(k) for k, v in values.items()))), block)
    near = cut.withColumn("_before", F.lag("_value").over(Window.partitionBy("doc_id", "_part").orderBy("idx"))).drop("_value")
    last = cut.groupBy("doc_id", "_part").agg(F.max_by("_value", "idx").alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("doc_id").orderBy("_part")))
    found = F.coalesce("_before", "_carry")
    return joined_back(near, carry).withColumns({k: found[k] for k in values}).drop("_before", "_carry")


def running(rows: DataFrame, name: str, value: Column, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, idx) with the sum of an integer ``value`` over its document's rows up to it."""
    cut = parted(rows.withColumn("_value", value.cast("long")), block)
    near = cut.withColumn("_sum", F.sum("_value").over(Window.partitionBy("doc_id", "_part").orderBy("idx"))).drop("_value")
    sums = cut.groupBy("doc_id", "_part").agg(F.sum("_value").alias("_all"))
    carry = sums.withColumn("_carry", F.sum("_all").over(Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return joined_back(near, carry).withColumn(name, F.col("_sum") + F.coalesce("_carry", F.lit(0))).drop("_sum", "_carry")
