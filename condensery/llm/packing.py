"""Best-fit packing of token sequences by bin completion.

Sequences are interchangeable when their lengths are equal, so the packing problem is its length histogram: at most
``capacity`` counts, whatever the number of documents. Spark counts the lengths; the search works on those counts and
returns bin patterns with multiplicities; Spark ranks the pieces of each length (with counts by partition, never a window
over all pieces of a length) and deals the ranks out to the patterns' places.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, texts_of, written
from .tokenise import SLICE_BYTES, encoder

CAPACITY, END_ID = 1024, 2
#: Search effort: nodes that the branch and bound visits, and fillings tried at a node, before the incumbent is taken; then how often a
#: few bins are opened and searched again, and the nodes of such a search.
NODES, WIDTH, ROUNDS, ROUND_NODES = 3_000, 4, 300, 300

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of whole texts; (part, length, place) numbers those of one length within a task's rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, places = encoder(vocabulary, True).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, limit=SLICE_BYTES):
                ids, offsets = encode(texts_of(batch))
                rows = [[] for _ in range(6)]
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    at = 0
                    for k, to in enumerate(range(first, len(own) + 1, capacity)):
                        for column, value in zip(rows, (doc_id, k, at, to - at, zlib.crc32(own[at:to]), places[to - at]), strict=True):
                            column.append(value)
                        places[to - at] += 1
                        at = to
                d, k, s, n, c, p = rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(np.full(len(d), part, np.int32)), pa.array(p, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def reachable(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(size, sums up to ``room`` that sizes up to this one make, as bits), by ascending size."""
    mask, sums, out = (1 << (room + 1)) - 1, 1, []
    for size in sorted(s for s, c in counts.items() if c and s <= room):
        left, take = min(counts[size], room // size), 1
        while left:
            take = min(take, left)
            sums |= (sums << (size * take)) & mask
            left -= take
            take *= 2
        out.append((size, sums))
    return out


def fillings(counts: dict[int, int], room: int, most_waste: int, width: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``, by ascending waste and, for one waste, by descending largest item.

    A filling that wastes more than another could be exchanged for it, as could one made of smaller items for an equal sum
    of larger ones (small items fit in more places), so those come first and the dominated ones are left out.
    """
    table = reachable(counts, room)
    if not table:
        yield ()
        return
    given = 0
    for total in range(room, max(0, room - most_waste) - 1, -1):
        if not table[-1][1] >> total & 1:
            continue
        last = len(table)
        while last and given < width:
            # The largest item below the one before that can begin a filling of this total.
            last = next((i for i in range(last - 1, -1, -1) if table[i][0] <= total and (found := build(counts, table, total, i))), -1)
            if last < 0:
                break
            yield found
            given += 1
            if len(found) == 1:
                break
        if total == 0:
            yield ()
        if given >= width or given and total == room:
            return


def every_filling(counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """All fillings of ``room`` to which no further item can be added, by ascending waste; the undominated ones are among them."""
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    out, open_ = [], [((), 0, room)]
    while open_:
        taken, i, left = open_.pop()
        if i == len(sizes):
            used = Counter(taken)
            if all(s > left or used[s] == counts[s] for s in sizes):
                out.append(taken)
            continue
        for n in range(min(counts[sizes[i]], left // sizes[i]) + 1):
            open_.append((taken + (sizes[i],) * n, i + 1, left - n * sizes[i]))
    return sorted(out, key=lambda f: (-sum(f), [-s for s in f]))


def build(counts: dict[int, int], table: list[tuple[int, int]], total: int, start: int) -> tuple[int, ...] | None:
    """Largest-first items of sizes up to table[start], that one included, with this total; None if there are none."""
    out, i, used, first = [], start, 0, True
    while total:
        size = table[i][0]
        rest = table[i - 1][1] if i else 1
        # As many of this size as the smaller ones can complete.
        most = min(counts[size], total // size)
        n = next((n for n in range(most, 0 if first else -1, -1) if rest >> (total - n * size) & 1), None)
        if n is None:
            return None
        out += [size] * n
        total -= n * size
        i, first = i - 1, False
    return tuple(out)


def bin_patterns(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a bin, each with how often it is used; together they use the histogram exactly.

    The first descent takes the best-fitting completion of the largest length each time: it is the incumbent. The branch and bound then tries
    other undominated completions, leaving a branch when its waste alone rules out a better number of bins. With ``nodes`` None the search is complete: every
    completion is tried, bin by bin, so the number of bins is the least possible (for small histograms only: the time is exponential).
    """
    total = sum(s * c for s, c in histogram.items())
    least = -(-total // capacity)
    best: list = []
    best_bins = float("inf")
    visited = 0
    start = {s: c for s, c in histogram.items() if c}

    def options(counts: dict[int, int], waste: int):
        largest = max(counts)
        spare = capacity - largest if best_bins == float("inf") else min(capacity - largest, (best_bins - 1) * capacity - total - waste)
        if spare < 0:
            return iter(())
        rest = dict(counts)
        rest[largest] -= 1
        found = every_filling(rest, capacity - largest) if nodes is None else fillings(rest, capacity - largest, spare, width)
        return ((largest, *f) for f in found)

    if not start:
        return []
    # One frame for each bin pattern chosen: counts before it, its alternatives, bins and waste so far.
    stack = [(start, options(start, 0), 0, 0)]
    chosen: list[tuple[tuple[int, ...], int]] = []
    while stack:
        counts, left, bins, waste = stack[-1]
        spent = nodes is not None and visited >= nodes and best
        pattern = None if spent else next(left, None)
        if pattern is None:
            if spent:
                break
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        visited += 1
        need = Counter(pattern)
        times = 1 if nodes is None else min(counts[s] // n for s, n in need.items())
        after = {s: c - times * need.get(s, 0) for s, c in counts.items() if c > times * need.get(s, 0)}
        bins, waste = bins + times, waste + times * (capacity - sum(pattern))
        if best and waste > (best_bins - 1) * capacity - total:
            continue
        if not after:
            if bins < best_bins:
                best, best_bins = [*chosen, (pattern, times)], bins
            if best_bins == least:
                break
            continue
        chosen.append((pattern, times))
        stack.append((after, options(after, waste), bins, waste))
    return best


def improved(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY, rounds: int = ROUNDS, nodes: int = ROUND_NODES) -> list[tuple[tuple[int, ...], int]]:
    """``patterns`` after up to ``rounds`` searches, each over some bins that waste a bin's room together and some full ones; the better packing of each is kept."""
    have: Counter = Counter()
    for pattern, times in patterns:
        have[pattern] += times
    least, bins, rng = -(-sum(sum(p) * n for p, n in have.items()) // capacity), have.total(), random.Random(1)
    for _ in range(rounds):
        poor = sorted((p for p in have if sum(p) < capacity), key=lambda p: sum(p) * rng.random())
        full = [p for p in have if sum(p) == capacity]
        opened, wasted = Counter(), 0
        for p in poor:
            take = min(have[p], -(-max(0, capacity - wasted) // (capacity - sum(p))))
            if take:
                opened[p], wasted = take, wasted + take * (capacity - sum(p))
        if bins == least or wasted < capacity:
            break
        if full:
            opened.update({p: 1 for p in rng.choices(full, [len(p) * min(3, have[p]) for p in full], k=rng.randint(2, 3 * opened.total() + 3))})
        inside = Counter()
        for p, n in opened.items():
            for size in p:
                inside[size] += n
        again = bin_patterns(dict(inside), capacity, nodes)
        if (fewer := opened.total() - sum(n for _, n in again)) >= 0:
            have -= opened
            for p, n in again:
                have[p] += n
            bins -= fewer
    return list(have.items())


def places_by_length(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs of ranks that one pattern takes: first rank, first bin, items a bin, offset in the bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for pattern, times in patterns:
        offset = 0
        for size, n in Counter(pattern).items():
            runs.setdefault(size, []).append((used[size], base, n, offset))
            used[size] += n * times
            offset += n * size
        base += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its document is the end id alone. Rows are packed one by one, repeated ones as often as
    they come; a null doc_id stays null. An empty table gives no rows. Only documents longer than ``capacity`` are cut; the first piece takes the remainder.
    """
    cut = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    by_part = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places_by_length(improved(bin_patterns(histogram, capacity, nodes), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, base, n, off = runs[int(size)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                within = rank[rows] - first[k]
                sequence[rows] = base[k] + within // n[k]
                offset[rows] = off[k] + within % n[k] * size
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    # A row for each task and length, so it grows with the corpus: shuffled at every size, never broadcast.
    ranked = cut.join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
