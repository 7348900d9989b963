"""Symbols, references between code blocks, and the closure that restores definitions kept code still needs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.storage import forget, written


def symbol_table(blocks: DataFrame, scope: str | None = "doc_id") -> DataFrame:
    """(scope, name, doc_id, idx): the last definition of a name within a scope, a column of ``blocks``; files go by their ids' order. ``scope`` None: one for all."""
    defined = blocks.select(F.col(scope).alias("scope") if scope else F.lit("all").alias("scope"), "doc_id", "idx", F.explode("defines").alias("name"))
    return defined.groupBy("scope", "name").agg(F.max(F.struct("doc_id", "idx")).alias("at")).select("scope", "name", "at.doc_id", "at.idx")


def reference_edges(blocks: DataFrame, symbols: DataFrame, scope: str | None = "doc_id") -> DataFrame:
    """(doc_id, idx, to_doc, to_idx): a block refers to a name that another block defines."""
    refs = blocks.select(F.col(scope).alias("scope") if scope else F.lit("all").alias("scope"), "doc_id", "idx", F.explode(F.array_except(T.references(F.col("text")), "defines")).alias("name"))
    found = refs.join(symbols.select("scope", "name", F.col("doc_id").alias("to_doc"), F.col("idx").alias("to_idx")), ["scope", "name"])
    return found.filter((F.col("doc_id") != F.col("to_doc")) | (F.col("idx") != F.col("to_idx"))).select("doc_id", "idx", "to_doc", "to_idx").distinct()


#: Plain steps before pointers are built, and rounds after which what has been reached is one table.
STEPS, COMPACT = 4, 4


def dependency_closure(kept: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(doc_id, idx, restored): kept blocks and all that can be reached from them.

    The first ``steps`` rounds each follow one reference. What is still open then are long chains: blocks with one reference left that leads on get a pointer, and rounds follow
    pointers that double their length, so that a chain of n blocks takes about log n rounds; where a block has several such references, one step is plain again.
    """
    node = F.struct("doc_id", "idx")
    links = edges.select(node.alias("a"), F.struct(F.col("to_doc").alias("doc_id"), F.col("to_idx").alias("idx")).alias("b"))
    first = written(kept.select(node.alias("a"), F.lit(False).alias("restored")).dropDuplicates(["a"]), "reached")
    reached, frontier, rounds = [first], first, 0

    def seen() -> DataFrame:
        return functools.reduce(DataFrame.unionByName, reached)

    def follow(by: DataFrame, everywhere: bool = True) -> bool:
        """Adds what ``by`` leads to from all that has been reached, or from what came last; whether there was anything new."""
        nonlocal frontier, reached, rounds
        rounds += 1
        if rounds % COMPACT == 0:
            one = written(seen(), "reached")
            forget(*(t for t in reached if t is not frontier))
            reached = [one]
        new = (seen() if everywhere else frontier).select("a").join(by, "a").select(F.col("b").alias("a")).distinct().join(seen().select("a"), "a", "left_anti")
        new = written(new.withColumn("restored", F.lit(True)), "frontier")
        if new.isEmpty():
            forget(new)
            return False
        reached.append(new)
        frontier = new
        return True

    more = True
    for _ in range(steps):
        if not (more := follow(links, everywhere=False)):
            break
    while more:
        # References to what has been reached say nothing more.
        links = written(links.join(seen().select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"), "links")
        single = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b")).filter("n = 1").select("a", "b")
        pointers = written(single, "pointers")
        while more := follow(pointers):
            longer = pointers.select("a", F.col("b").alias("by")).join(pointers.select(F.col("a").alias("by"), "b"), "by").select("a", "b")
            pointers, before = written(longer, "pointers"), pointers
            forget(before)
        forget(pointers)
        more = follow(links)
    return seen().select("a.doc_id", "a.idx", "restored")
