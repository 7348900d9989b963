"""Documents to chunks: (doc_id, idx, text), idx in document order."""

from __future__ import annotations

import ast
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import prefix

BLOCKS = "doc_id string, idx int, text string, start_line int, end_line int, defines array<string>, strategy string"
ROW = pa.schema([("doc_id", pa.string()), ("idx", pa.int32()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("defines", pa.list_(pa.string())), ("strategy", pa.string())])
#: Blocks that a task holds as rows before it hands them on.
AT_ONCE = 4096


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    # Outer, as else the optimizer filters by the size of the array, and works the array out once more for that.
    return docs.select("doc_id", F.posexplode_outer(chunks).alias("idx", "text")).filter("idx IS NOT NULL")


def line_chunks(docs: DataFrame) -> DataFrame:
    return explode_chunks(docs, T.split_lines(F.col("text")))


def sentence_chunks(docs: DataFrame) -> DataFrame:
    return explode_chunks(docs, T.split_sentences(F.col("text")))


def prose_chunks(docs: DataFrame) -> DataFrame:
    return typed_chunks(docs.withColumn("content_type", F.lit("prose"))).drop("content_type")


def typed_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, content_type, idx, text) of docs (doc_id, content_type, text) in one pass: lines of code and logs; of prose the sentences, or the
    lines that are not blank where there is at most one sentence and more than one such line."""
    prose = F.col("content_type") == "prose"
    split = docs.select("doc_id", "content_type", "text", F.when(prose, T.split_sentences(F.col("text"))).alias("_sentences"))
    lines = T.split_lines(F.col("text"))
    split = split.withColumn("_lines", F.when(~prose, lines).when(F.size("_sentences") <= 1, F.filter(lines, lambda s: ~T.is_blank(s))))
    chunks = F.when(~prose | (F.size("_lines") > 1), F.col("_lines")).otherwise(F.col("_sentences"))
    return split.select("doc_id", "content_type", F.posexplode_outer(chunks).alias("idx", "text")).filter("idx IS NOT NULL")


def with_prose_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with texts, the chunks of their texts as prose in order, see ``typed_chunks``."""
    split = docs.withColumn("_sentences", T.split_sentences(F.col("text")))
    split = split.withColumn("_lines", F.when(F.size("_sentences") <= 1, F.filter(T.split_lines(F.col("text")), lambda s: ~T.is_blank(s))))
    return split.withColumn("texts", F.when(F.size("_lines") > 1, F.col("_lines")).otherwise(F.col("_sentences"))).drop("_sentences", "_lines")


def records(lines: DataFrame, block: int = prefix.BLOCK) -> DataFrame:
    """``lines`` (doc_id, idx, text) with record_id: a record begins at a marked line or a blank one, and after a blank one."""
    blank = T.is_blank(F.col("text"))
    begins = blank | T.starts_record(F.col("text")) | F.coalesce("_after_blank", F.lit(True))
    counted = prefix.running(prefix.previous(lines, block, _after_blank=blank), "record_id", begins.cast("int"), block)
    return counted.drop("_after_blank").withColumn("record_id", F.col("record_id").cast("int"))


def joined_chunks(chunks: DataFrame, separator: str) -> DataFrame:
    """(doc_id, text): chunks in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), separator).alias("text"))


def top_level(source: str, lines: list[str]) -> list[tuple[int, int, list[str]]] | None:
    """(first line, last line, names defined) of top-level statements and of what is between them; None if it isn't Python."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return None
    spans, done = [], 0
    for node in [*body, None]:
        first = node.lineno if node else len(lines) + 1
        if first - 1 > done and any(s.strip() for s in lines[done : first - 1]):
            spans.append((done + 1, first - 1, []))
        if node:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                names = [node.name]
            else:
                names = [t.id for t in node.targets if isinstance(t, ast.Name)] if isinstance(node, ast.Assign) else []
            spans.append((first, node.end_lineno, sorted(set(names))))
            done = node.end_lineno
        else:
            done = max(done, first - 1)
    return spans


def indented(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """Spans that end where indentation, once deeper than the span's first, comes back to it."""
    spans, begin, base, deeper = [], 0, None, False
    for i, line in enumerate(lines):
        depth = len(line) - len(line.lstrip(" \t")) if line.strip() else None
        if i == begin or depth is None:
            base = depth if i == begin else base
            continue
        if base is None:
            base = depth
        elif depth <= base and deeper:
            spans.append((begin + 1, i, []))
            begin, base, deeper = i, depth, False
            continue
        deeper = deeper or depth > base
    return [*spans, (begin + 1, len(lines), [])] if lines else []


def blocks_of(doc_id: str | None, source: str, python_only_by_name: bool) -> Iterator[tuple]:
    """Rows of ``BLOCKS`` of one document."""
    lines = source.splitlines()
    spans = top_level(source, lines) if not python_only_by_name or str(doc_id).endswith(".py") else None
    strategy = "ast"
    if spans is None:
        spans, strategy = indented(lines), "indentation"
    for i, (a, b, names) in enumerate(spans):
        yield doc_id, i, "\n".join(lines[a - 1 : b]), a, b, names, strategy


def code_blocks(docs: DataFrame, python_only_by_name: bool = False) -> DataFrame:
    """Blocks of code documents: top-level Python statements, else indentation, else lines. ``python_only_by_name``: only documents whose id ends
    in .py are tried as Python (repository and diff modes). Parsing is the one step that needs Python on the executors; of a batch's documents one is parsed at a time, and its
    blocks leave in batches of ``AT_ONCE``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = (block for doc_id, source in zip(batch.column("doc_id"), batch.column("text"), strict=True) for block in blocks_of(doc_id.as_py(), source.as_py() or "", python_only_by_name))
            while rows := list(itertools.islice(blocks, AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ROW.types, strict=True)], schema=ROW)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(cut, BLOCKS)
