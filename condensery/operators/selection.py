"""Selection under a token budget: greedy by score, going on past chunks that do not fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .streams import folded


def select_under_budget(scored: DataFrame, budgets: DataFrame | None, first_always: bool = True) -> DataFrame:
    """(doc_id, idx) of kept chunks of ``scored`` (doc_id, idx, score, tokens) under ``budgets`` (doc_id, budget, spent); None: ``scored`` has them.

    A document's chunks pass by falling score, ties in order, and only the running total is remembered. ``first_always``: the best chunk stays even if it alone is too large.
    """

    def step(state: dict | None, batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        budget = batch.column("budget")[0].as_py()
        run, any_kept = (state["run"], state["any"]) if state else (batch.column("spent")[0].as_py(), False)
        tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.zeros(len(tokens), bool)
        if first_always and not any_kept:
            kept[0], run, any_kept = True, run + int(tokens[0]), True
        at = int(kept[0])
        while at < len(tokens):
            # As many as fit one after the other, then on to the next that fits alone.
            fits = int(np.searchsorted(np.cumsum(tokens[at:]), budget - run, "right")) if budget >= run else 0
            kept[at : at + fits] = True
            run += int(tokens[at : at + fits].sum())
            at += fits
            small = np.flatnonzero(tokens[at:] <= budget - run)
            if not len(small):
                break
            at += int(small[0])
        return kept, {"run": run, "any": any_kept or bool(kept.any())}

    if budgets is None:
        both = scored.select("doc_id", "idx", "score", "tokens", "budget", F.col("spent").cast("long").alias("spent"))
    else:
        both = scored.select("doc_id", "idx", "score", "tokens").join(budgets.select("doc_id", "budget", F.col("spent").cast("long").alias("spent")), "doc_id")
    return folded(both, "doc_id", [F.desc("score"), "idx"], step).select("doc_id", "idx")
