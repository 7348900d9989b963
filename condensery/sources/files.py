"""Sources and sinks: text files, code folders, diffs of a git work tree, question lists; text and report folders."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dims import CODE_ENDINGS, PRUNED_FOLDERS


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole files; bytes that are not UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.expr("is_valid_utf8(CAST(content AS STRING))"), F.col("content").cast("string")).otherwise(F.replace(F.expr("make_valid_utf8(CAST(content AS STRING))"), F.lit("�"), F.lit("")))
    return files.select(F.col("path").alias("doc_id"), text.alias("text"))


def code_files(spark: SparkSession, root: str, endings: tuple[str, ...] = CODE_ENDINGS, max_files: int | None = 500) -> tuple[DataFrame, int]:
    """Source files below ``root``, by path, without generated and hidden folders; the first ``max_files`` of them, all if it is None. With them the number of files that this leaves out."""
    inside = F.regexp_replace("doc_id", r"^\w+:/*", "/")
    pruned = "|".join(f.replace(".", r"\.") for f in PRUNED_FOLDERS)
    below = F.substring(inside, len(root.removeprefix("file://").rstrip("/")) + 1, 1 << 20)
    found = read_texts(spark, root).filter(inside.rlike(rf"\.({'|'.join(endings)})$") & ~below.rlike(rf"/({pruned}|\.[^/]+)/"))
    if max_files is None:
        return found, 0
    # Paths alone are counted: contents are not read for that.
    return found.orderBy("doc_id").limit(max_files), max(0, found.select("doc_id").count() - max_files)


def read_code(spark: SparkSession, root: str, endings: tuple[str, ...] = CODE_ENDINGS, max_files: int | None = 500) -> DataFrame:
    """The files of ``code_files``."""
    return code_files(spark, root, endings, max_files)[0]


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "question"))


def git_diff(spark: SparkSession, repository: str, base: str = "HEAD", target: str | None = None) -> DataFrame:
    """(diff_id, text): a work tree's unified diff, read on the driver."""
    done = subprocess.run(["git", "diff", "--no-color", f"{base}..{target}" if target else base], cwd=repository, capture_output=True, text=True, timeout=30)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return spark.createDataFrame([("diff", done.stdout)], "diff_id string, text string")


def files_at(paths: DataFrame, repository: str, ref: str | None = None) -> DataFrame:
    """(doc_id, text) of files (path) at a commit, or in the work tree; files that aren't there give no row. Executors read them from the repository, a folder
    that they share: a task asks one git process for all of its paths."""

    def at_commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "cat-file", "--batch"], cwd=repository, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
            for batch in batches:
                found = []
                for path in batch.column("path").to_pylist():
                    if not path or "\n" in path:
                        continue
                    git.stdin.write(f"{ref}:{path}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    # "<id> blob <size>", or "<name> missing".
                    if len(head) < 3 or not head[-1].isdigit():
                        continue
                    body = git.stdout.read(int(head[-1]) + 1)[:-1]
                    if head[-2] == b"blob":
                        found.append((path, body.decode(errors="ignore")))
                yield listed(found)
            git.stdin.close()

    def in_work_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(f"{repository}/{path}", encoding="utf-8", errors="ignore") as f:
                        found.append((path, f.read()))
                except (OSError, ValueError):
                    continue
            yield listed(found)

    def listed(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["doc_id", "text"])

    return paths.select("path").mapInArrow(at_commit if ref else in_work_tree, "doc_id string, text string")


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    texts.select(F.col(column).alias("value")).write.text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """(path, report) as one text folder per report path."""
    reports.select("path", F.col("report").alias("value")).write.partitionBy("path").text(path)
