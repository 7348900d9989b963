"""Removal of repeated passages: every byte covered by a ``length``-byte string that also starts somewhere else.

A difference-cover suffix sort restricted to what the question needs. Instead of every second or third position, the sampled positions are
content-defined: a window's sampled position is the least hashed ``gram`` of its ``length``-byte string, so that equal strings
have their sample at the same shift (the property for which difference covers are used; compare string
synchronizing sets, Kempa and Kociumaka 2019) and one position in about eighty is sampled.

1. Sampled positions get a name for the tuple that they head; names that occur once in the corpus are unique suffixes and leave.
2. The recursion on names compares the whole stretch that the windows of one sampled position cover: its name is made from the
   names of its parts. Stretches that occur twice are repeated as a whole.
   Where a sample heads several stretches, blocks of offsets to it are named in the same way (what a block's windows share, all that they cover).
3. The remaining suffixes are merged in: of the windows in blocks that are still mixed, those whose name recurs are sorted by their ``length``-byte
   prefixes over the whole corpus, and each is compared with the one before it and the one after it.

In the first two steps two 64-bit names together stand for ranks, which spares a global sort of all positions; a table of every suffix would be many times
the input. In the last step a name only leaves out what is unique: what is removed there has been compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import forget, mix64, texts_of, written

LENGTH, GRAM = 200, 32
#: Bytes of a text that are handled at once; longer texts are cut into overlapping segments.
SEGMENT = 1 << 20
PLACE_BITS = 21
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_NAMES = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Names:
    """Names of any substring of ``data`` from prefix sums (polynomials modulo 2^64 over named bytes)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_NAMES[data] * up[: len(data)], dtype=np.uint64)])

    def at_all(self, size: int) -> np.ndarray:
        """Names of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def sampled(data: np.ndarray, names: Names, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share a sampled position: (position, first start, last start).

    ``data`` may hold several texts; runs over their borders mean nothing and are cut away by the caller.
    """
    n = len(data) - gram + 1
    width = length - gram + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # Least named gram, the leftmost on ties.
    least = (names.at_all(gram) & ~mask) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    owner = (least & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], first, np.append(first[1:], len(owner)) - 1


def segments(batch: pa.RecordBatch, length: int, margin: int = 0, segment: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts in pieces of bounded size: (bytes, row of each text in it, where it begins there, where that is in its text).

    A text longer than a piece goes on in the next, ``length`` - 1 bytes before its cut, so that each window lies whole in one, and ``margin`` bytes before that.
    """
    segment = segment or SEGMENT
    texts = texts_of(batch)
    buffers = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(buffers[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        if offsets[row + 1] - offsets[row] > segment:
            for at in range(0, int(offsets[row + 1] - offsets[row]) - length + 1, segment - length + 1):
                before = min(at, margin)
                begin = offsets[row] + at
                yield data[begin - before : min(begin + segment, offsets[row + 1])], np.array([row]), np.zeros(1, np.int64), np.array([at - before])
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + segment, "right")) - 1)
        yield data[offsets[row] : offsets[to]], np.arange(row, to), offsets[row:to] - offsets[row], np.zeros(to - row, np.int64)
        row = to


def runs_of(data: np.ndarray, names: Names, begins: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The sampled runs inside the texts of a piece: (which text, position, first start, last start)."""
    place, low, high = sampled(data, names, length, gram)
    ends = np.append(begins[1:], len(data))
    # A run that crosses a border is cut there: each text gets its own part of it.
    which = np.searchsorted(begins, low, "right") - 1
    last = np.searchsorted(begins, high, "right") - 1
    if (which != last).any():
        n = last - which + 1
        index = np.repeat(np.arange(len(low)), n)
        which = which[index] + np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        place, low, high = place[index], np.maximum(low[index], begins[which]), np.minimum(high[index], np.append(begins[1:], len(data) + 1)[which] - 1)
    high = np.minimum(high, ends[which] - length)
    inside = low <= high
    return which[inside], place[inside], low[inside], high[inside]


def stretches(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """(row, low, size, shift, sample, stretch): ``size`` windows from ``low`` on share the sampled position low + shift, named ``sample``;
    ``stretch`` names all that they cover. One row for each sampled position: the piece that the position falls to sees its run whole."""
    # A run's windows begin at most so far before its position; a piece's own positions are more.
    margin, segment = length - gram, max(segment, 2 * length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            sizes = pc.binary_length(texts_of(batch)).to_numpy()
            for data, rows, begins, at in segments(batch, length, margin, segment):
                names = Names(data)
                which, place, low, high = runs_of(data, names, begins, length, gram)
                if sizes[rows[0]] > segment:
                    own = (place >= margin) | (at[0] == 0)
                    if at[0] + len(data) < sizes[rows[0]]:
                        own &= place <= len(data) - length
                    which, place, low, high = which[own], place[own], low[own], high[own]
                columns = [pa.array(numbers[rows][which], pa.int64()), pa.array(low - begins[which] + at[which], pa.int32()), pa.array(high - low + 1, pa.int16()), pa.array(place - low, pa.int16()), pa.array(names.of(place, place + gram).view(np.int64)), pa.array(stretch_names(names, place, low, high, length).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "low", "size", "shift", "sample", "stretch"])

    return texts.select("row", "text").mapInArrow(scan, "row long, low int, size short, shift short, sample long, stretch long")


def stretch_names(names: Names, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Of all that a run's windows cover, with the sample's place in it."""
    return mix64(names.of(low, high + length) ^ mix64((place - low).astype(np.uint64) + np.uint64(1)))


#: Window offsets to the sample that are named together in the second step.
BLOCK = 16
#: Prefixes that a task cuts from a text at once.
PREFIXES = 8192
#: What flags mean: all that the windows cover recurs; the windows are to be told apart by the next step.
WHOLE, ASK = 1, 2


def named_apart(found: DataFrame, step: str) -> DataFrame:
    """One step of the recursion: ``found`` (row, low, sample, stretch, ...) without those whose sample occurs once, with flag and without the names.

    Equal stretches are one class and recur as a whole. Where a sample has several classes, one occurrence of each goes on (ASK).
    """
    # Partial aggregation: a passage in very many documents is one class after the map side.
    classes = written(found.groupBy("sample", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "low")).alias("one")), step + "-classes")
    samples = classes.groupBy("sample").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    shared = classes.join(samples, "sample").select("sample", "stretch", (F.col("n") > 1).alias("whole"), (F.col("kinds") > 1).alias("mixed"), F.col("one.row").alias("one_row"), F.col("one.low").alias("one_low"))
    shared = written(shared, step + "-shared")
    forget(classes)
    asks = F.col("mixed") & (F.col("one_row") == F.col("row")) & (F.col("one_low") == F.col("low"))
    flag = (F.when(F.col("whole"), WHOLE).otherwise(0) + F.when(asks, ASK).otherwise(0)).cast("byte")
    flagged = found.join(shared, ["sample", "stretch"]).withColumn("flag", flag).filter("flag > 0")
    return flagged.drop("sample", "stretch", "whole", "mixed", "one_row", "one_low")


def of_each(batch: pa.RecordBatch, column: str, *fields: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(place in the batch, bytes of its text, the fields of its list's structs as arrays) for each row of a batch."""
    lists = batch.column(column)
    values = [lists.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    ends = lists.offsets.to_numpy()
    texts = batch.column("text")
    for k in range(batch.num_rows):
        yield k, np.frombuffer(texts[k].as_buffer() or b"", np.uint8), [v[ends[k] : ends[k + 1]] for v in values]


def blocks(asked: DataFrame, length: int, segment: int = SEGMENT) -> DataFrame:
    """(row, low, size, alone, sample, stretch) of the offset blocks of asked runs: ``size`` windows from ``low`` on; the
    sample is what all windows of the block's offsets share, the stretch all that they cover. alone: not known to recur."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            rows = batch.column("row").to_numpy()
            for k, raw, (low, size, shift, flag) in of_each(batch, "runs", "low", "size", "shift", "flag"):
                ask = flag & ASK > 0
                low, high, place, alone = low[ask], (low + size)[ask] - 1, (low + shift)[ask], (flag & WHOLE == 0)[ask]
                first, last = (place - high) // BLOCK, (place - low) // BLOCK
                n = last - first + 1
                run = np.repeat(np.arange(len(low)), n)
                j = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                begin, end = place[run] - BLOCK * j - BLOCK + 1, place[run] - BLOCK * j
                from_, to = np.maximum(begin, low[run]), np.minimum(end, high[run])
                core, whole = np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
                for at in range(0, len(raw), segment):
                    own = (end >= at) & (end < at + segment)
                    if own.any():
                        start = max(0, at - length)
                        names = Names(raw[start : at + segment + length])
                        a, b = np.maximum(begin[own] - start, 0), np.minimum(end[own] + length, len(raw)) - start
                        core[own] = mix64(names.of(end[own] - start, np.minimum(begin[own] + length, len(raw)) - start) + j[own].astype(np.uint64))
                        clipped = (end[own] - start - a).astype(np.uint64)
                        whole[own] = mix64(names.of(a, b) + j[own].astype(np.uint64) * np.uint64(1024) + clipped)
                for column, value in zip(out, (np.full(len(run), rows[k]), from_, to - from_ + 1, alone[run], core.view(np.int64), whole.view(np.int64)), strict=True):
                    column.append(value)
            if out[0]:
                kinds = [pa.int64(), pa.int32(), pa.int16(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], ["row", "low", "size", "alone", "sample", "stretch"])

    return asked.select("row", "text", "runs").mapInArrow(name, "row long, low int, size short, alone boolean, sample long, stretch long")


def windows(asked: DataFrame, length: int, segment: int = SEGMENT) -> DataFrame:
    """(row, start, alone, window) of each window of the asked blocks."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            rows = batch.column("row").to_numpy()
            for k, raw, (low, size, alone) in of_each(batch, "blocks", "low", "size", "alone"):
                block = np.repeat(np.arange(len(low)), size)
                start = low[block] + np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
                window = np.zeros(len(start), np.uint64)
                for at in range(0, len(raw), segment):
                    own = (start >= at) & (start < at + segment)
                    if own.any():
                        window[own] = Names(raw[at : at + segment + length]).of(start[own] - at, start[own] - at + length)
                for column, value in zip(out, (np.full(len(start), rows[k]), start, alone[block] > 0, window.view(np.int64)), strict=True):
                    column.append(value)
            if out[0]:
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], ["row", "start", "alone", "window"])

    return asked.select("row", "text", "blocks").mapInArrow(name, "row long, start int, alone boolean, window long")


def prefixes(asked: DataFrame, length: int) -> DataFrame:
    """(row, start, alone, prefix) of the asked windows: their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for k, raw, (start, alone) in of_each(batch, "windows", "start", "alone"):
                for at in range(0, len(start), PREFIXES):
                    own = start[at : at + PREFIXES]
                    # A piece of the text that holds some of them, in order of their starts.
                    data = np.ascontiguousarray(raw[own[:, None] + np.arange(length)]).tobytes()
                    prefix = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, len(data) + 1, length, dtype=np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rows[k])), pa.array(own, pa.int32()), pa.array(alone[at : at + PREFIXES] > 0), prefix], ["row", "start", "alone", "prefix"])

    return asked.select("row", "text", "windows").mapInArrow(cut, "row long, start int, alone boolean, prefix binary")


def equal_neighbours(windows_: DataFrame) -> DataFrame:
    """(row, start) of the windows that ask (alone) and equal the one before or after them in the order of all prefixes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last window read waits for the one after it.
        held, held_same = None, False
        for batch in batches:
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            prefix = both.column("prefix")
            n = both.num_rows
            same = pc.equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
            before = np.append(held_same, same)
            after = np.append(same, False)
            out = (before | after)[: n - 1] & both.column("alone").to_numpy(zero_copy_only=False)[: n - 1]
            yield both.select(["row", "start"]).slice(0, n - 1).filter(pa.array(out))
            held, held_same = both.slice(n - 1), bool(before[n - 1])
        if held is not None and held_same and held.column("alone")[0].as_py():
            yield held.select(["row", "start"])

    # Equal prefixes fall into one range.
    return windows_.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(compare, "row long, start int")


def removed(joined: DataFrame, length: int, with_text: bool) -> DataFrame:
    """The result of each document, from ``spans``: its runs of starts of repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            numbers, doc_ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for k, raw, (low, size) in of_each(batch, "spans", "low", "size"):
                gone = np.zeros(len(raw), bool)
                left, spans = raw, 0
                if len(low):
                    steps = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(steps, low, 1)
                    np.add.at(steps, low + size - 1 + length, -1)
                    gone = np.cumsum(steps)[: len(raw)] > 0
                    left = raw[~gone]
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                left = left.tobytes()
                out.append((numbers[k], doc_ids[k], len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            if out:
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], RESULT)

    return joined.select("row", "doc_id", "text", "spans").mapInArrow(cut, "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


RESULT = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, doc_id, text, other columns packed as _doc): row tells rows apart where doc_id is null or repeated."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct("*").alias("_doc"))
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty():
        return whole.withColumn("row", F.col("doc_id"))
    return written(whole.withColumn("row", F.monotonically_increasing_id()), "numbered")


def repeated(texts: DataFrame, length: int, gram: int, segment: int = SEGMENT) -> DataFrame:
    """(row, spans): for each document that has any, the runs of starts of windows that start somewhere else too."""
    found = written(stretches(texts, length, gram, segment), "samples")
    # Lists of one document's runs, blocks or windows are bounded by its length.
    runs = written(named_apart(found, "runs"), "runs")
    forget(found)
    by_row = runs.filter(F.col("flag").bitwiseAND(ASK) > 0).groupBy("row").agg(F.collect_list(F.struct("low", "size", "shift", "flag")).alias("runs"))
    split = written(blocks(texts.join(by_row, "row"), length, segment), "blocks")
    parts = written(named_apart(split, "blocks"), "parts")
    forget(split)
    open_parts = parts.filter(F.col("flag").bitwiseAND(ASK) > 0).select("row", "low", "size", (F.col("alone") & (F.col("flag").bitwiseAND(WHOLE) == 0)).alias("alone"))
    single = written(windows(texts.join(open_parts.groupBy("row").agg(F.collect_list(F.struct("low", "size", "alone")).alias("blocks")), "row"), length, segment), "windows")
    twice = written(single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "twice")
    recurring = single.join(twice.hint("merge"), "window").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "alone"))).alias("windows"))
    cut = written(prefixes(texts.join(recurring, "row"), length), "prefixes")
    forget(single, twice)
    starts = written(equal_neighbours(cut).select("row", F.col("start").alias("low"), F.lit(1).cast("short").alias("size")), "starts")
    forget(cut)
    whole = runs.filter(F.col("flag").bitwiseAND(WHOLE) > 0).select("row", "low", "size").union(parts.filter(F.col("alone") & (F.col("flag").bitwiseAND(WHOLE) > 0)).select("row", "low", "size"))
    spans = written(whole.union(starts).groupBy("row").agg(F.collect_list(F.struct("low", "size")).alias("spans")), "spans")
    forget(runs, parts, starts)
    return spans


def passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes and judged as given; a null text counts as empty. Matches never cross documents and may overlap. A null doc_id
    stays null; repeated rows are copies of each other. Texts under ``length`` bytes lose nothing. An empty table gives no rows.
    """
    texts = numbered(docs.select("doc_id", "text")).drop("_doc")
    return removed(texts.join(repeated(texts, length, gram, segment), "row", "left"), length, False).drop("row", "kept")


def drop_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with only the remaining bytes of each text (a character that a removed run cuts goes too); n_chars follows."""
    texts = numbered(docs)
    plain = texts.drop("_doc")
    spans = repeated(plain, length, gram)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [b.as_py().decode("utf-8", "ignore") for b in batch["kept"]]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(left, pa.string())], ["row", "left"])

    changed = removed(plain.join(spans, "row"), length, True).select("row", "kept").mapInArrow(clean, "row long, left string")
    merged = texts.join(changed.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    new_text = F.when(F.col("_row").isNotNull(), F.col("left")).otherwise(F.col("_doc.text"))
    columns = []
    for field in docs.schema:
        column = F.col("_doc").getField(field.name)
        if field.name == "text":
            column = new_text
        elif field.name == "n_chars":
            column = F.when(F.col("_row").isNotNull(), F.length("left")).otherwise(column).cast(field.dataType)
        columns.append(column.alias(field.name))
    return merged.select(columns)
