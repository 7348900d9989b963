"""Helpers shared by the corpus operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a task; bounds a Python worker's memory whatever the batch size.
CHUNK_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster's spark.checkpoint.dir names; driver and executors share it. One of our own only where it is not set and all is one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="condensery-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Has Spark drop an execution's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/condensery-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def written_ids(df: DataFrame, name: str) -> DataFrame:
    """``written`` for narrow tables of ids: an eighth as many files as a shuffle has partitions, as each file and task costs more than the few rows of a partition; two for each core at least."""
    spark = df.sparkSession
    return written(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)), name)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut a batch into runs of rows whose texts together stay near ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All ASCII-whitespace separated words, flat, and the row offsets into them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(some), parents.filter(some).to_numpy()
    return flat, np.searchsorted(parents, np.arange(len(texts) + 1))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, flat, and the row offsets."""
    flat, offsets = words_of(pc.utf8_lower(texts))
    coded = flat.dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return (names[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each row with their counts: (row, hash, count), sorted by row and hash.

    A row with fewer words than ``width`` has one shingle of all its words; a row without words has none.
    """
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        salts = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        long_rows = np.flatnonzero(n >= width)
        rows = np.repeat(long_rows, n[long_rows] - width + 1)
        starts = np.arange(len(rows)) - np.repeat(np.cumsum(n[long_rows] - width + 1) - (n[long_rows] - width + 1), n[long_rows] - width + 1) + offsets[rows]
        h = np.zeros(len(rows), np.uint64)
        for j in range(width):
            h += mix64(words[starts + j] * salts[j])
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            hs = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = n[short] > j
                hs[has] += mix64(words[offsets[short[has]] + j] * salts[j])
            rows, h = np.concatenate([rows, short]), np.concatenate([h, hs])
        h = mix64(h)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return rows[at], h[at], np.diff(np.append(at, len(h)))
