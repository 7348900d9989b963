"""Token ids in files of Simple-8b words.

A block holds the ids of consecutive documents: a header, the index of its escapes, the word offset of every group of
``GROUP`` ids, then little-endian 64-bit words. A word's top four bits select how many ids of how many bits it packs; an
escape word says that the next word is one id that needs more than 60 bits. Blocks are rows of a Parquet table (Spark's
writer commits it, so it survives lost executors and works on any store), with their document index beside them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import slices, texts_of
from .tokenise import SLICE_BYTES, encoder

END_ID = 1
#: Ids to a group: decoding can begin at any group.
GROUP = 256
#: Ids in a block at least, unless its task has no more.
BLOCK_IDS = 1 << 18
#: Ids per word and bits per id of selectors 0 to 13; 15 is the escape.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BITS = tuple(60 // n for n in COUNTS)
ESCAPE = 15
HEADER = struct.Struct("<4sIIII")
BLOCKS = "first_doc long, block int, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), np.uint8)
    for k in range(1, 64):
        over = ids >= np.uint64(1 << k)
        if not over.any():
            break
        out += over
    return out


def encode_block(ids: np.ndarray, group: int = GROUP) -> bytes:
    """Simple-8b bytes of ids (any uint64)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    bits = bit_lengths(ids)
    index = np.arange(n)
    room = np.minimum((index // group + 1) * group, n) - index
    # The largest selector whose count of ids from each place on all fit; greedy from left to right.
    best = np.zeros(n, np.int8)
    widest, reached = bits.copy(), 1
    for s, count in enumerate(COUNTS):
        while reached < count and reached < n:
            widest[:-reached] = np.maximum(widest[:-reached], bits[reached:])
            reached += 1
        fits = (widest <= BITS[s]) & (room >= count)
        if not fits.any():
            break
        best[fits] = s
    best[bits > 60] = ESCAPE
    counts = np.array([*COUNTS, 0, 1], np.int64)
    starts, steps = [], []
    at = np.arange(0, n, group)
    ends = np.minimum(at + group, n)
    step = 0
    groups = np.arange(len(at))
    while len(at):
        starts.append(at)
        steps.append(groups)
        at = at + counts[best[at]]
        more = at < ends
        at, ends, groups = at[more], ends[more], groups[more]
        step += 1
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    owner = np.concatenate(steps) if steps else np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], owner[order]
    selector = best[starts].astype(np.uint64)
    is_escape = selector == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(is_escape) - is_escape
    words = np.zeros(len(starts) + int(is_escape.sum()), np.uint64)
    words[place] = selector << np.uint64(60)
    for s, count in enumerate(COUNTS):
        own = np.flatnonzero(selector == s)
        if len(own):
            values = ids[starts[own][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(BITS[s]))
            words[place[own]] |= np.bitwise_or.reduce(values, axis=1)
    escapes = place[is_escape]
    words[escapes + 1] = ids[starts[is_escape]]
    first_of_group = place[np.searchsorted(owner, np.arange(-(-n // group)))] if n else np.zeros(0, np.int64)
    return b"".join([
        HEADER.pack(b"S8B1", n, len(words), len(escapes), group),
        escapes.astype("<u4").tobytes(), first_of_group.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def decode_block(payload: bytes, first_group: int = 0) -> np.ndarray:
    """The ids from a group on, all words at once."""
    magic, n, n_words, n_escapes, group = HEADER.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b block")
    at = HEADER.size
    escapes = np.frombuffer(payload, "<u4", n_escapes, at)
    n_groups = -(-n // group)
    offsets = np.frombuffer(payload, "<u4", n_groups, at + 4 * n_escapes)
    words = np.frombuffer(payload, "<u8", n_words, at + 4 * (n_escapes + n_groups))
    if first_group:
        begin = int(offsets[first_group])
        words, escapes = words[begin:], escapes[escapes >= begin] - begin
    raw = np.zeros(len(words), bool)
    raw[escapes + 1] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[raw] = 14
    counts = np.array([*COUNTS, 0, 1], np.int64)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n - first_group * group, np.uint64)
    for s, count in enumerate(COUNTS):
        own = np.flatnonzero(selector == s)
        if len(own):
            values = words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(BITS[s])) & np.uint64((1 << BITS[s]) - 1)
            out[starts[own][:, None] + np.arange(count)] = values
    out[starts[escapes]] = words[escapes + 1]
    return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, leading_space: bool = False, end_id: int = END_ID) -> None:
    """Encode whole texts (null counts as empty), each with ``end_id`` behind, and write blocks in ascending doc_id order.

    Null doc_ids come first. Repeated rows are written as often as they come. An empty table writes no blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, leading_space).encode
        doc_ids, sizes, parts, waiting, block, first = [], [], [], 0, 0, None
        schema = pa.schema([("first_doc", pa.int64()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])

        def emit() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pylist([{"first_doc": first, "block": block, "n_ids": len(ids), "doc_ids": doc_ids, "n_tokens": sizes, "payload": encode_block(ids)}], schema)

        for whole in batches:
            for batch in slices(whole, limit=SLICE_BYTES):
                ids, offsets = encode(texts_of(batch))
                own = batch.column("doc_id").to_pylist()
                if not block and not sizes:
                    first = own[0]
                ended = np.insert(ids, offsets[1:], np.uint32(end_id))
                cuts = offsets + np.arange(len(offsets))
                at = 0
                while at < len(own):
                    to = min(len(own), max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_IDS - waiting, "left"))))
                    doc_ids += own[at:to]
                    sizes += np.diff(cuts[at : to + 1]).tolist()
                    parts.append(ended[cuts[at] : cuts[to]])
                    waiting += int(cuts[to] - cuts[at])
                    at = to
                    if waiting >= BLOCK_IDS:
                        yield emit()
                        doc_ids, sizes, parts, waiting, block = [], [], [], 0, block + 1
        if sizes:
            yield emit()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """The ids of all blocks before each block: _first, _block, _start.

    Blocks are summed up by the task that wrote them, so the one unpartitioned window has a row for each such task.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path).select("first_doc", "block", "n_ids")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("first_doc").agg(F.sum("n_ids").alias("n")).select(F.col("first_doc").alias("_f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard"))
    within = Window.partitionBy("first_doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return inner.join(shards, F.col("first_doc").eqNullSafe(F.col("_f"))).select(F.col("first_doc").alias("_first"), F.col("block").alias("_block"), (F.col("_shard") + F.col("_within")).alias("_start"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = decode_block(row["payload"]).astype("<u4")
                n = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(n)
                begins = ends - n
                columns = [pa.array([row["first_doc"]] * len(n), pa.int64()), pa.array([row["block"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(n), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)], pa.int64())]
                names = ["first_doc", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ["ids"] * with_ids
    blocks = spark.read.schema(BLOCKS).parquet(path).select("first_doc", "block", "doc_ids", "n_tokens", "payload")
    docs = blocks.mapInArrow(decoded, "first_doc long, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    placed = docs.join(block_starts(spark, path), F.col("first_doc").eqNullSafe(F.col("_first")) & (F.col("block") == F.col("_block")))
    return placed.select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *extra)
