"""Ranking of compressors (adapters) over the datasets that they were measured on."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F


def leaderboard(results: DataFrame) -> DataFrame:
    """One row per adapter of ``results`` (seq, adapter, dataset, original_tokens, compressed_tokens, retention, skipped_reason).

    Skipped results add nothing to the sums; an adapter counts as skipped if its first result by ``seq`` was. The ratio is one of sums,
    null without tokens; null retentions are left out of the mean.
    """
    reason = F.nullif("skipped_reason", F.lit(""))
    ran = F.when(reason.isNull(), True)
    sums = results.groupBy("adapter").agg(
        F.min_by(reason, "seq").alias("skipped_reason"), F.count(ran).alias("datasets_evaluated"), F.sum(F.when(ran, F.col("original_tokens"))).alias("before"),
        F.sum(F.when(ran, F.col("compressed_tokens"))).alias("after"), F.avg(F.when(ran, F.col("retention"))).alias("avg_retention"),
    )
    ratio = F.when(F.col("before") > 0, 1 - F.col("after") / F.col("before"))
    return sums.select("adapter", "skipped_reason", "datasets_evaluated", ratio.alias("overall_compression_ratio"), "avg_retention")


def ranked(board: DataFrame) -> DataFrame:
    """Adapters that ran first, the best ratio on top; a null ratio counts as none. Equal ones by name."""
    return board.orderBy(F.col("skipped_reason").isNotNull(), F.coalesce("overall_compression_ratio", F.lit(0.0)).desc(), "adapter")


def datasets(results: DataFrame) -> DataFrame:
    """The number of different datasets in ``results``."""
    return results.agg(F.count_distinct("dataset").alias("datasets"))


def per_dataset(results: DataFrame) -> DataFrame:
    """(seq, entry): each result as a JSON object, with its ratio; an adapter's name and address where ``results`` has such columns (adapter_name, adapter_url)."""
    zero = F.lit(0).cast("long")
    ratio = F.when(F.col("original_tokens") > 0, 1 - F.col("compressed_tokens") / F.col("original_tokens")).otherwise(F.lit(0.0))
    own = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in ("adapter_name", "adapter_url")]
    fields = ["dataset", F.col("adapter").alias("adapter_key"), *own, F.coalesce("original_tokens", zero).alias("original_tokens"), F.coalesce("compressed_tokens", zero).alias("compressed_tokens"), ratio.alias("compression_ratio"), "retention", "skipped_reason"]
    return results.select("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("entry"))


def document(results: DataFrame, target: float, quality: bool) -> Iterator[str]:
    """The whole leaderboard as one JSON document, line by line: the run's settings, every result in order, and the totals of each adapter. A partition at a time passes through."""
    head = {"target_compression": target, "quality_eval_ran": quality}
    yield json.dumps(head, indent=2)[:-2] + ','
    yield '  "per_dataset": ['
    yield from separated(row["entry"] for row in per_dataset(results).orderBy("seq", "entry").toLocalIterator())
    yield '  ],'
    yield '  "leaderboard": {'
    totals = ranked(leaderboard(results))
    own = F.to_json(F.struct(*(c for c in totals.columns if c != "adapter")), {"ignoreNullFields": "false"})
    yield from separated(f"{json.dumps(row['adapter'])}: {row['entry']}" for row in totals.select("adapter", own.alias("entry")).toLocalIterator())
    yield '  }'
    yield '}'


def separated(entries: Iterator[str]) -> Iterator[str]:
    before = None
    for entry in entries:
        if before is not None:
            yield f"    {before},"
        before = entry
    if before is not None:
        yield f"    {before}"


def write_document(results: DataFrame, path: str, target: float = 0.70, quality: bool = False) -> None:
    """``document`` as one file, a local path or an address that pyarrow's file systems know."""
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with place.open_output_stream(name) as f:
        for line in document(results, target, quality):
            f.write(f"{line}\n".encode())
