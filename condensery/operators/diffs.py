"""Unified diffs: hunks on the new side, the blocks they touch, and files without content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .chunking import line_chunks


def parse_hunks(diffs: DataFrame, reset_on_deletion: bool = True) -> DataFrame:
    """(diff_id, path, new_start, new_lines, new_end) from diffs (diff_id, text). ``reset_on_deletion``: hunks of a deleted file belong to no
    path; without it they count for the file before."""
    lines = line_chunks(diffs.withColumnRenamed("diff_id", "doc_id"))
    header = r"^\+\+\+ b/(.+)$"
    path = F.when(F.col("text").rlike(header), F.trim(F.regexp_extract("text", header, 1)))
    if reset_on_deletion:
        path = path.when(F.col("text").startswith("+++ "), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    at = lines.withColumn("path", F.last(path, True).over(w)).filter(F.col("text").rlike(hunk) & (F.col("path") != ""))
    count = F.regexp_extract("text", hunk, 2)
    out = at.select(F.col("doc_id").alias("diff_id"), "path", F.regexp_extract("text", hunk, 1).cast("int").alias("new_start"), F.when(count == "", 1).otherwise(F.nullif(count, F.lit("")).cast("int")).alias("new_lines"))
    return out.withColumn("new_end", F.col("new_start") + F.greatest(F.col("new_lines") - 1, F.lit(0)))


#: Lines of a bin.
BIN = 64


def touched_blocks(blocks: DataFrame, hunks: DataFrame) -> DataFrame:
    """Blocks (doc_id is the path, or what ``hunks`` call path) whose lines overlap a hunk. Both are cut into bins of lines and meet in those, not with all of a file."""
    h = hunks.select(F.col("path").alias("doc_id"), "new_start", "new_end", F.explode(F.sequence(F.expr(f"new_start div {BIN}"), F.expr(f"new_end div {BIN}"))).alias("bin"))
    b = blocks.select("doc_id", "idx", "start_line", "end_line", F.explode(F.sequence(F.expr(f"start_line div {BIN}"), F.expr(f"end_line div {BIN}"))).alias("bin"))
    met = b.join(h, ["doc_id", "bin"]).filter("start_line <= new_end AND new_start <= end_line").select("doc_id", "idx").distinct()
    return blocks.join(met, ["doc_id", "idx"], "left_semi")


def skipped_files(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """(diff_id, path) with hunks but no content, or an empty one; contents may be listed as b/path, and for one diff (diff_id) or for all."""
    have = contents(files).filter(F.length("text") > 0)
    keys = [c for c in ("diff_id", "path") if c in have.columns]
    return hunks.select("diff_id", "path").distinct().join(have.select(*keys), keys, "left_anti").select("diff_id", "path")


def contents(files: DataFrame) -> DataFrame:
    """(path, text), and diff_id where ``files`` has it, of files (doc_id, text): one row for each, the entry under its plain path before that under b/path."""
    keys = [c for c in ("diff_id", "path") if c == "path" or c in files.columns]
    plain = files.select(*keys[:-1], F.regexp_replace("doc_id", "^b/", "").alias("path"), "text", F.startswith("doc_id", F.lit("b/")).alias("_b")).filter(F.length("text") > 0)
    return plain.groupBy(*keys).agg(F.min_by("text", F.struct("_b", F.sha2("text", 256))).alias("text"))
