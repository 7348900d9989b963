"""Structural dedup of line tables (doc_id, idx, text) with windows over a document's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from . import prefix
from .chunking import records


def collapse_blank_runs(lines: DataFrame, block: int = prefix.BLOCK) -> DataFrame:
    """The first line of each run of blank ones stays."""
    blank = T.is_blank(F.col("text"))
    return prefix.previous(lines, block, _after_blank=blank).filter(~(blank & F.coalesce("_after_blank", F.lit(False)))).drop("_after_blank")


def collapse_similar_lines(lines: DataFrame) -> DataFrame:
    """The first of the lines that are equal up to numbers stays, with a note of how many there are; blank lines all stay. Adds n_similar."""
    text = F.when(F.col("n_similar") > 1, F.format_string("%s  [x%d similar lines collapsed]", F.col("text"), F.col("n_similar"))).otherwise(F.col("text"))
    return similar_lines(lines).withColumn("text", text)


def similar_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, idx, text, n_similar): the first of the lines that are equal up to numbers, as it is, and their number."""
    blank = T.is_blank(F.col("text"))
    # Blank lines get a key of their own each, so that they make no large group.
    keyed = lines.withColumn("_key", F.when(blank, F.concat(F.lit("\u0000"), F.col("idx").cast("string"))).otherwise(T.normalized_line(F.col("text"))))
    counts = keyed.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n_similar"), F.min(F.struct("idx", "text")).alias("_first"))
    return counts.select("doc_id", F.col("_first.idx").alias("idx"), F.col("_first.text").alias("text"), "n_similar")


def summarize_repeated_blocks(lines: DataFrame, min_block_lines: int = 2, min_repeats: int = 3, block: int = prefix.BLOCK) -> DataFrame:
    """Runs of equal records of several lines become their first record, with a note on its last line. Adds n_blocks: records left out behind that line, and block_head: the record's first line."""
    per_record = (
        records(lines, block).groupBy("doc_id", "record_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("body"), F.min("idx").alias("idx"))
        .withColumns({
            "head": F.col("body")[0]["text"],
            "key": F.array_join(F.transform("body", lambda b: T.normalized_line(b["text"])), "\n"),
            "long": (F.size("body") >= min_block_lines) & F.exists("body", lambda b: ~T.is_blank(b["text"])),
        })
    )
    # Of the record before, whether it is of several lines and which.
    before = prefix.previous(per_record, block, _key=F.when(F.col("long"), F.col("key")))
    new = ~(F.col("long") & F.coalesce(F.col("_key") == F.col("key"), F.lit(False)))
    islands = prefix.running(before, "island", new.cast("int"), block).drop("_key")
    # A run of any length is a sum, not a group that meets in one task.
    timestamp = F.regexp_extract("head", T.TIMESTAMP, 0)
    sums = islands.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("begins"), F.min_by(timestamp, "idx").alias("first"), F.max_by(timestamp, "idx").alias("last"))
    runs = islands.withColumnRenamed("island", "_own").join(sums.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("island"))).drop("_doc", "_own")
    kept = runs.filter((F.col("n") < min_repeats) | (F.col("idx") == F.col("begins")))
    span = F.when(F.col("first") != "", F.concat(F.lit(", "), F.col("first"), F.lit(" .. "), F.when(F.col("last") != "", F.col("last")).otherwise(F.col("first")))).otherwise("")
    note = F.when(F.col("n") >= min_repeats, F.concat(F.format_string("  [repeated block x%d", F.col("n")), span, F.lit("]"))).otherwise("")
    size = F.size("body")
    return kept.select(
        "doc_id", F.when(F.col("n") >= min_repeats, F.col("head")).alias("block_head"),
        F.posexplode(F.transform("body", lambda b, i: F.struct(b["idx"].alias("idx"), F.when(i == size - 1, F.concat(b["text"], note)).otherwise(b["text"]).alias("text"), F.when((i == size - 1) & (F.col("n") >= min_repeats), F.col("n") - 1).otherwise(0).alias("n_blocks")))).alias("_i", "b"),
    ).select("doc_id", "b.idx", "b.text", "b.n_blocks", "block_head")


def structural_pass(lines: DataFrame, summarize_blocks: bool) -> tuple[DataFrame, DataFrame]:
    """Lines after the whole pass, and (doc_id, collapsed, blank_runs): lines and blocks left out as repeated, and blank lines left out."""
    staged = summarize_repeated_blocks(lines) if summarize_blocks else lines.withColumn("n_blocks", F.lit(0))
    blocks = staged.groupBy("doc_id").agg(F.sum("n_blocks").alias("blocks"), F.count(F.lit(1)).alias("n_lines"))
    out = collapse_similar_lines(collapse_blank_runs(staged.select("doc_id", "idx", "text")))
    similar = out.groupBy("doc_id").agg(F.sum(F.col("n_similar") - 1).alias("similar"), F.sum("n_similar").alias("n_left"))
    return out.select("doc_id", "idx", "text"), blocks.join(similar, "doc_id").select("doc_id", (F.col("blocks") + F.col("similar")).cast("int").alias("collapsed"), (F.col("n_lines") - F.col("n_left")).cast("int").alias("blank_runs"))


def collapse_notes(lines: DataFrame, summarize_blocks: bool = False, most: int = 10) -> DataFrame:
    """(doc_id, notes) of documents with repeats: what was collapsed, blocks first, in order, ``most`` at most."""
    staged = summarize_repeated_blocks(lines) if summarize_blocks else lines.withColumns({"n_blocks": F.lit(0), "block_head": F.lit("")})
    short = lambda c: F.left(T.strip(F.col(c)), F.lit(60))
    blocks = staged.filter("n_blocks > 0").select("doc_id", F.lit(0).alias("kind"), "idx", F.format_string("%dx block starting: %s", F.col("n_blocks") + 1, short("block_head")).alias("note"))
    similar = similar_lines(collapse_blank_runs(staged.select("doc_id", "idx", "text"))).filter("n_similar > 1")
    both = blocks.union(similar.select("doc_id", F.lit(1), "idx", F.format_string("%dx: %s", "n_similar", short("text"))))
    first = both.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "idx"))).filter(F.col("k") <= most)
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "note"))), lambda n: n["note"]).alias("notes"))
