"""Reports as text columns: summaries, notes, Markdown, HTML. The wording of summaries, notes and headings is fixed values: readers of such reports expect it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


STYLE = ".kept, .dropped { display: block; white-space: pre-wrap; font-family: monospace } .kept { color: darkgreen } .dropped { color: firebrick; text-decoration: line-through }"


def summary(original: Column, compressed: Column, ratio: Column, kept: Column, total: Column, removed: Column, collapsed: Column) -> Column:
    return F.concat(reduction(original, compressed, ratio), F.format_string(", %d/%d chunks kept, %d near-duplicates removed, %d repeated lines collapsed", kept, total, removed, collapsed))


def reduction(original: Column, compressed: Column, ratio: Column) -> Column:
    # format_number rounds the double's exact value, halves to the even digit; format_string and bround round its shortest decimal form, a tie more often.
    return F.format_string("%d -> %d tokens (%s%% reduction)", original, compressed, F.call_function("format_number", ratio * 100, F.lit("0.0")))


def repo_summary(totals: DataFrame) -> DataFrame:
    """``totals`` of a repository with its summary line."""
    line = F.concat(F.format_string("%d files, ", "files"), reduction(F.col("original_tokens"), F.col("compressed_tokens"), F.col("compression_ratio")), F.format_string(", %d cross-file symbol(s) restored", "restored"))
    return totals.withColumn("summary", line)


def diff_summary(totals: DataFrame) -> DataFrame:
    """``totals`` of a diff with its summary line."""
    return totals.withColumn("summary", F.concat(F.format_string("%d changed file(s), ", "files"), reduction(F.col("original_tokens"), F.col("compressed_tokens"), F.col("compression_ratio"))))


def session_summary(totals: DataFrame) -> DataFrame:
    """``session_totals`` with a summary line for each conversation."""
    line = F.concat(reduction(F.col("original_tokens"), F.col("compressed_tokens"), F.col("compression_ratio")), F.format_string(", %d/%d turns kept, %d duplicate turn(s) dropped", "turns_kept", "turns_total", "turns_dropped_duplicate"))
    return totals.withColumn("summary", line)


def restored_note() -> Column:
    return F.when(F.coalesce("restored", F.lit(0)) > 0, F.format_string("cross-file dependency closure restored %d block(s)", "restored"))


def repo_notes(totals: DataFrame, root: str) -> DataFrame:
    """``totals`` of a repository with its notes."""
    return totals.withColumn("notes", F.array_compact(F.array(F.concat(F.format_string("scanned %d files under ", "files"), F.lit(root)), restored_note())))


def diff_notes(totals: DataFrame, hunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """``totals`` of a diff with its notes. ``skipped`` (path): changed files without contents; a note names them all, in order."""
    changed = hunks.agg(F.count_distinct("path").alias("n_changed"))
    left_out = skipped.agg(F.count(F.lit(1)).alias("n_skipped"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    # Each side is one row.
    joined = totals.join(F.broadcast(changed), F.lit(True)).join(F.broadcast(left_out), F.lit(True))
    skip = F.when(F.col("n_skipped") > 0, F.format_string("skipped %d file(s) with unavailable content: %s", "n_skipped", "paths"))
    notes = F.array_compact(F.array(F.format_string("parsed diff: %d changed file(s)", "n_changed"), restored_note(), skip))
    return joined.withColumn("notes", notes).drop("n_changed", "n_skipped", "paths")


def session_notes(turns: DataFrame) -> DataFrame:
    """(conv_id, notes) of compressed turns (conv_id, format, action)."""
    of = lambda action: F.count_if(F.col("action") == action)
    return turns.groupBy("conv_id").agg(F.array(
        F.format_string("parsed %d turn(s) as '%s' format", F.count(F.lit(1)), F.first("format")),
        F.format_string("protected %d system turn(s) + %d recent turn(s) verbatim", of("protected_system"), of("protected_recent")),
        F.format_string("dropped %d duplicate older turn(s)", of("dropped_duplicate")),
        F.format_string("compressed %d older turn(s)", of("compressed")),
    ).alias("notes"))


def diff_rows(diff_lines: Column, row) -> Column:
    """``row(kept, line)`` for each line of each chunk in order; an empty chunk has one empty line."""
    lines = lambda d: F.when(F.size(T.split_lines(d["text"])) > 0, T.split_lines(d["text"])).otherwise(F.array(F.lit("")))
    return F.coalesce(F.flatten(F.transform(diff_lines, lambda d: F.transform(lines(d), lambda s: row(d["kept"], s)))), F.array().cast("array<string>"))


def markdown(title: Column, summary_: Column, notes: Column, diff_lines: Column) -> Column:
    rows = diff_rows(diff_lines, lambda kept, s: F.concat(F.when(kept, "+ ").otherwise("- "), s))
    head = F.array(F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("**"), summary_, F.lit("**")), F.lit(""), F.lit("## Notes"), F.lit(""))
    legend = F.array(*map(F.lit, ["", "## Diff", "", "`+` kept · `-` dropped", "", "```diff"]))
    return F.array_join(F.concat(head, F.transform(notes, lambda n: F.concat(F.lit("- "), n)), legend, rows, F.array(F.lit("```"), F.lit(""))), "\n")


def html(title: Column, summary_: Column, notes: Column, diff_lines: Column) -> Column:
    rows = diff_rows(diff_lines, lambda kept, s: F.concat(F.lit('<span class="'), F.when(kept, "kept").otherwise("dropped"), F.lit('">'), F.when(s == "", "&nbsp;").otherwise(T.html_escape(s)), F.lit("</span>")))
    items = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("<li>"), T.html_escape(n), F.lit("</li>"))), "")
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), T.html_escape(title), F.lit("</title>\n<style>" + STYLE + "</style>\n</head>\n<body>\n<h1>"), T.html_escape(title), F.lit('</h1>\n<div class="summary">'), T.html_escape(summary_), F.lit('</div>\n<h2>Notes</h2>\n<ul class="notes">'), items, F.lit('</ul>\n<h2>Diff</h2>\n<div class="diff">'), F.array_join(rows, ""), F.lit("</div>\n</body>\n</html>\n"))


def report(path: Column, title: Column, summary_: Column, notes: Column, diff_lines: Column) -> Column:
    """Markdown for paths that end so, HTML for all others."""
    return F.when(F.lower(path).rlike(r"\.(md|markdown)$"), markdown(title, summary_, notes, diff_lines)).otherwise(html(title, summary_, notes, diff_lines))
