"""Folds over sorted streams: rows of a key in order, with a state that goes on from batch to batch; no list of a key's rows is ever made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def key_starts(key: pa.Array, last: object) -> np.ndarray:
    """Where another key begins than the row before has; ``last`` is the key before the first row."""
    codes = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.ones(len(key), bool)
    starts[1:] = codes[1:] != codes[:-1]
    starts[0] = key[0].as_py() != last
    return starts


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches that part no key, of batches sorted by it: the rows of the last key wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode("encode").indices.to_numpy()
        cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        if held and batch.column(key)[0].as_py() != held[-1].column(key)[0].as_py():
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def folded(rows: DataFrame, key: str, order: list[Column | str], step: Callable[[dict | None, pa.RecordBatch], tuple[np.ndarray, dict]]) -> DataFrame:
    """The rows of ``rows`` for which ``step`` says so, of columns that it is given: rows of one ``key`` meet in one task, sorted by ``order``.

    ``step(state, batch)`` gets rows of one key, in order, and the state that it returned for the key's rows before them (None at first), and returns a mask and the
    state. Spark's sort spills, so a key of any length takes a batch of memory and its state.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            starts = key_starts(keys, last)
            cuts = np.union1d(np.flatnonzero(starts), [0, batch.num_rows])
            kept = np.zeros(batch.num_rows, bool)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kept[a:b], state = step(None if starts[a] else state, batch.slice(a, b - a))
            last = keys[batch.num_rows - 1].as_py()
            yield batch.filter(pa.array(kept))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(walk, rows.schema)
