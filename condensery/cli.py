"""Command line: compress files, code folders, diffs or chat exports."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import text as T
from .functions.dims import PRESETS, PROFILES, preset
from .functions.storage import written
from .operators import diffs, reports, sessions
from .plans import compress as C
from .sources import files as S
from .sources.mirror import write_mirror


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="condensery")
    p.add_argument("path", nargs="?")
    p.add_argument("--repo")
    p.add_argument("--max-files", type=int, default=500, help="files of a repository that are taken, by path; the number left out is told")
    p.add_argument("--diff", nargs="?", const="HEAD")
    p.add_argument("--diff-target-ref")
    p.add_argument("--diff-file")
    p.add_argument("--session")
    p.add_argument("--protect-recent", type=int, default=4)
    p.add_argument("--target", type=float)
    p.add_argument("--content-type", choices=["auto", "code", "logs", "prose"], default="auto")
    p.add_argument("--preset", choices=sorted(PRESETS))
    p.add_argument("--model", choices=sorted(PROFILES), default="default")
    p.add_argument("--dedup-threshold", type=float, help="similarity of near duplicates; 0.85 for files, and for sessions what fits each role's turns")
    p.add_argument("--out", help="folder for the compressed texts, each at its own relative path")
    p.add_argument("--report", help="folder for reports; Markdown if it ends in .md, else HTML")
    p.add_argument("--quiet", action="store_true", help="no summary and notes on stderr")
    return p


@dataclass
class Outcome:
    """A run's rows, with the relative path and the banner of each, and one-row or small tables of its summary and notes."""

    rows: DataFrame
    path: Column
    text: str = "compressed_text"
    banner: Column | None = None
    told: list[DataFrame] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def banner(*counts: Column) -> Column:
    """The line above a file's text."""
    inside = F.concat(F.format_string("%d -> %d tokens", "original_tokens", "compressed_tokens"), *counts)
    return F.concat(F.lit("----- "), F.col("path"), F.lit(" ("), inside, F.lit(") -----"))


def outcome(spark: SparkSession, args: argparse.Namespace) -> Outcome:
    target = args.target if args.target is not None else preset(args.preset)[0] if args.preset else 0.70
    if sum(x is not None for x in (args.path, args.diff_file, args.session)) + (args.repo is not None and args.diff is None and args.diff_file is None) + (args.diff is not None) != 1:
        raise ValueError("give one of: a path, --repo, --diff, --diff-file, --session")
    if args.session:
        parsed = sessions.parse_exports(S.read_texts(spark, args.session).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("raw")), strict=True)
        parsed = written(parsed, "parsed")
        turns = written(C.compress_session(sessions.exploded_turns(parsed), args.protect_recent, target, args.model, args.dedup_threshold), "turns")
        told = reports.session_summary(C.session_totals(turns)).join(reports.session_notes(turns.join(parsed.select("conv_id", "format"), "conv_id")), "conv_id")
        messages = C.session_messages(turns).withColumnRenamed("messages", "compressed_text")
        return Outcome(messages, F.concat(relative(F.col("conv_id"), args.session), F.lit(".json")), told=[told])
    if args.repo and args.diff is None and args.diff_file is None:
        files, left_out = S.code_files(spark, args.repo, max_files=args.max_files)
        done = written(C.compress_repo(files, target, args.model), "repo")
        told = reports.repo_notes(reports.repo_summary(C.totals(done)), args.repo)
        notes = [f"left out {left_out} file(s) beyond the first {args.max_files}"] if left_out else []
        return Outcome(done, relative(F.col("path"), args.repo), banner=banner(), told=[told], notes=notes)
    if args.diff is not None or args.diff_file:
        root = args.repo or "."
        diff = S.read_texts(spark, args.diff_file).withColumnRenamed("doc_id", "diff_id") if args.diff_file else S.git_diff(spark, root, args.diff, args.diff_target_ref)
        hunks = written(diffs.parse_hunks(diff), "hunks")
        contents = written(S.files_at(hunks.select("path").distinct(), root, args.diff_target_ref), "contents")
        done = written(C.compress_diff(hunks, contents, target, args.model), "diff")
        told = reports.diff_notes(reports.diff_summary(C.totals(done.drop("diff_id"))), hunks, diffs.skipped_files(hunks, contents))
        counts = F.format_string(", %d changed block(s) kept, %d dependency block(s) restored", "changed_blocks_kept", "dependency_blocks_restored")
        return Outcome(done, F.col("path"), banner=banner(counts), told=[told])
    threshold = args.dedup_threshold if args.dedup_threshold is not None else preset(args.preset)[1] if args.preset else 0.85
    done = written(C.compress(S.read_texts(spark, args.path), target, threshold, args.content_type, args.model), "texts")
    return Outcome(done, relative(F.col("doc_id"), args.path))


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; of a single file its name."""
    plain = lambda c: F.regexp_replace(c, r"^\w+:/*", "/")
    base = root.split("://")[-1].rstrip("/")
    below = F.substring_index(plain(path), base.lstrip("./") + "/", -1)
    return F.when(F.endswith(plain(path), F.lit(base)), F.substring_index(path, "/", -1)).otherwise(below)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return outcome(spark, args).rows


def summary_line(result: DataFrame) -> str | None:
    """What a run did as one line, from sums over its rows; None for sessions, whose rows hold only messages."""
    if "original_tokens" not in result.columns:
        return None
    sums = result.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("before"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("after"))
    return sums.select(F.format_string("%d texts, %d -> %d tokens (%.1f%% reduction)", "n", "before", "after", T.ratio(F.col("before"), F.col("after")) * 100)).first()[0]


def row_summary(result: DataFrame) -> Column:
    """The summary line of each row of ``result``: a text's counts of chunks, or a file's tokens alone."""
    before, after = F.col("original_tokens"), F.col("compressed_tokens")
    if "chunks_kept" not in result.columns:
        return reports.reduction(before, after, T.ratio(before, after))
    return reports.summary(before, after, F.col("compression_ratio"), F.col("chunks_kept"), F.col("chunks_total"), F.col("near_duplicates_removed"), F.col("structural_lines_collapsed"))


def row_notes(result: DataFrame) -> Column:
    """A text's notes; a file's say what was restored in it."""
    if "notes" in result.columns:
        return F.col("notes")
    restored = F.col("dependency_blocks_restored")
    return F.array_compact(F.array(F.concat(F.lit("file: "), "path"), F.when(restored > 0, F.format_string("cross-file dependency closure restored %d block(s)", restored))))


def printed(done: Outcome) -> Iterator[str]:
    """Every text, in order, a partition at a time: with its banner and a blank line behind it where texts are files."""
    rows = done.rows.select(done.path.alias("_path"), F.col(done.text).alias("_text"), (done.banner if done.banner is not None else F.lit(None).cast("string")).alias("_banner"))
    for row in rows.orderBy("_path").toLocalIterator():
        yield f"{row['_banner']}\n{row['_text']}\n" if row["_banner"] is not None else row["_text"] or ""


def told(done: Outcome) -> Iterator[str]:
    """The summary, and notes below it."""
    if not done.told:
        yield summary_line(done.rows)
    for table in done.told:
        for row in table.toLocalIterator():
            yield row["summary"]
            yield from (f"  {note}" for note in row["notes"])
    yield from (f"  {note}" for note in done.notes)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("condensery").getOrCreate()
    try:
        done = outcome(spark, args)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if args.report and "diff_lines" in done.rows.columns:
        text = reports.report(F.lit(args.report), F.lit("Compression report"), row_summary(done.rows), row_notes(done.rows), F.col("diff_lines"))
        S.write_texts(done.rows.select(text.alias("text")), args.report)
    if args.out:
        write_mirror(done.rows.select(done.path.alias("path"), F.col(done.text).alias("text")), args.out)
    else:
        for text in printed(done):
            print(text)
    if not args.quiet:
        for line in told(done):
            print(line, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
