"""The compression pipelines over tables of documents, repositories, diffs and chat sessions.

Each is one DataFrame plan whose stages are keyed by document; nothing is collected but a document's own chunks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.dims import preset as preset_values
from ..functions.storage import written
from ..operators import chunking, diffs, graph, selection, sessions, similarity, structural

SEPARATORS = {"prose": " ", "logs": "\n", "code": "\n"}


def compress(
    docs: DataFrame, target_compression: float = 0.70, dedup_threshold: float | None = 0.85, content_type: str = "auto", model: str = "default", extra_filler_patterns: tuple[str, ...] = (),
    use_code_blocks: bool = True, summarize_log_blocks: bool = True, preset: str | None = None, min_accuracy_floor: float = 0.95,
) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): original_tokens, compressed_tokens, compression_ratio, chunks_total, chunks_kept,
    near_duplicates_removed, structural_lines_collapsed, content_type, compressed_text, diff_lines, notes (what each step did, in order).

    ``min_accuracy_floor`` is accepted and has no effect. Empty or null texts give 0 tokens, no chunks and an empty text. Rows are documents of their own whatever their doc_id: null and repeated ones too.
    """
    if preset:
        target_compression, dedup_threshold, min_accuracy_floor = preset_values(preset)
    if not own_keys(docs, "doc_id"):
        rows = numbered(docs.select("doc_id", "text"))
        done = compress(rows.select(F.col("_row").alias("doc_id"), "text"), target_compression, dedup_threshold, content_type, model, extra_filler_patterns, use_code_blocks, summarize_log_blocks)
        named = done.withColumnRenamed("doc_id", "_row").join(rows.select("_row", "doc_id"), "_row")
        return named.select("doc_id", *(c for c in done.columns if c != "doc_id"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if content_type == "prose" and dedup_threshold is not None:
        return compress_prose(own.withColumn("original_tokens", T.token_count(F.col("text"), model)), target_compression, dedup_threshold, model, extra_filler_patterns, use_code_blocks)
    typed = own.withColumn("content_type", T.content_type(F.col("text")) if content_type == "auto" else F.lit(content_type))
    # What is worked out from whole texts is written: a narrow row for each document, and the pieces.
    facts = written(typed.select("doc_id", "content_type", T.token_count(F.col("text"), model).alias("original_tokens")), "facts")
    pieces = written(chunking.typed_chunks(typed), "pieces")
    empty = F.array().cast("array<string>")
    log_lines, log_collapsed = structural.structural_pass(pieces.filter("content_type = 'logs'").drop("content_type"), summarize_log_blocks)
    code_lines, code_collapsed = structural.structural_pass(pieces.filter("content_type = 'code'").drop("content_type"), False)
    parts = [pieces.filter("content_type = 'prose'").drop("content_type").withColumn("defines", empty), renumbered(log_lines).withColumn("defines", empty)]
    if use_code_blocks:
        # After the line pass: its notes usually stop Python from parsing, and indentation decides.
        blocks = chunking.code_blocks(chunking.joined_chunks(code_lines, "\n"))
        parts.append(blocks.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "idx", "text", "defines"))
    else:
        parts.append(renumbered(code_lines).withColumn("defines", empty))
    chunks = written(parts[0].unionByName(parts[1]).unionByName(parts[2]), "chunks")
    left = written(similarity.remove_near_duplicates(chunks, dedup_threshold).withColumn("tokens", T.token_count(F.col("text"), model)), "deduped")
    scored = similarity.density_scores(left.select("doc_id", "idx", "text", "tokens"), extra_filler_patterns, with_text=False)
    budgets = facts.select("doc_id", T.budget(F.col("original_tokens"), target_compression).alias("budget"), F.lit(0).alias("spent"))
    kept = written(selection.select_under_budget(scored.select("doc_id", "idx", "score", "tokens"), budgets), "kept")
    kept = kept.withColumn("restored", F.lit(False))
    if use_code_blocks:
        # Prose and logs define nothing, so only code adds edges.
        with_names = left.filter(F.size("defines") > 0)
        edges = written(graph.reference_edges(left.join(facts.filter("content_type = 'code'").select("doc_id"), "doc_id"), graph.symbol_table(with_names)), "edges")
        if not edges.isEmpty():
            kept = graph.dependency_closure(kept.select("doc_id", "idx"), edges).select("doc_id", "idx", "restored")
    # Texts are gathered once a document; what is known of each chunk is narrow, and meets them by place.
    facts_of = chunks.select("doc_id", "idx").join(kept.select("doc_id", "idx", "restored", F.lit(True).alias("kept")), ["doc_id", "idx"], "left").groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("kept", F.lit(False)).alias("kept")))), lambda c: c["kept"]).alias("flags"), F.count(F.lit(1)).cast("int").alias("chunks_total"),
        F.count("kept").cast("int").alias("n_kept"), F.count_if("restored").cast("int").alias("n_restored"),
    )
    stayed = left.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_left"))
    texts = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]).alias("texts"))
    joined = own.join(facts, "doc_id").join(texts, "doc_id", "left").join(facts_of, "doc_id", "left").join(stayed, "doc_id", "left").join(log_collapsed.union(code_collapsed), "doc_id", "left")
    joined = joined.withColumn("all", F.zip_with("texts", "flags", lambda t, k: F.struct(t.alias("text"), k.alias("kept")))).withColumn("n_near", F.col("chunks_total") - F.coalesce("n_left", F.lit(0)))
    separator = F.when(F.col("content_type") == "prose", " ").otherwise("\n")
    body = F.coalesce(F.array_join(F.transform(F.filter("all", lambda c: c["kept"]), lambda c: c["text"]), "\u0000"), F.lit(""))
    return outcome(joined.withColumn("body", F.replace(body, F.lit("\u0000"), separator)), model, use_code_blocks, dedup_threshold is None)


def compress_prose(docs: DataFrame, target_compression: float, dedup_threshold: float, model: str, extra_filler_patterns: tuple[str, ...], use_code_blocks: bool) -> DataFrame:
    """``compress`` of documents (doc_id, text, original_tokens) that are all prose; their ids are their own.

    Each is a row with its chunks, so that those come together wherever they are looked at, and terms are looked for once: only a document that loses a chunk to another is scored again.
    """
    whole = written(chunking.with_prose_chunks(docs), "whole")

    def pieces(of: DataFrame) -> DataFrame:
        cut = of.select("doc_id", T.budget(F.col("original_tokens"), target_compression).alias("budget"), F.lit(0).alias("spent"), F.posexplode("texts").alias("idx", "text")).withColumn("words", T.word_count(F.col("text")))
        return cut.withColumn("tokens", T.tokens_of(F.col("text"), F.col("words"), model))

    seen = written(similarity.appraised(pieces(whole), dedup_threshold, extra_filler_patterns), "appraised")
    near = similarity.pairs_above(seen.select("doc_id", "idx", "copies", "heads", "terms"), dedup_threshold)
    drops = written(similarity.near_drops(near, seen, dedup_threshold), "drops")
    lost = drops.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_near"))
    again = pieces(whole.join(lost.select("doc_id"), "doc_id", "left_semi")).drop("words").join(drops, ["doc_id", "idx"], "left_anti")
    columns = ["doc_id", "idx", "score", "tokens", "budget", "spent"]
    scored = seen.join(lost, "doc_id", "left_anti").select(columns).union(similarity.density_scores(again, extra_filler_patterns, with_text=False).select(columns))
    kept = selection.select_under_budget(scored, None).groupBy("doc_id").agg(F.sort_array(F.collect_list("idx")).alias("kept"), F.count(F.lit(1)).cast("int").alias("n_kept"))
    joined = whole.join(kept, "doc_id", "left").join(lost, "doc_id", "left").withColumns({"content_type": F.lit("prose"), "n_restored": F.lit(0), "collapsed": F.lit(0), "blank_runs": F.lit(0)})
    some = F.size("texts") > 0
    body = F.array_join(F.transform("kept", lambda i: F.get("texts", i)), " ")
    flag = lambda kept: lambda i: F.struct(i.alias("idx"), F.lit(kept).alias("kept"))
    stays = F.coalesce("kept", F.array().cast("array<int>"))
    goes = F.array_except(F.sequence(F.lit(0), F.size("texts") - 1), stays)
    flags = F.array_sort(F.concat(F.transform(stays, flag(True)), F.transform(goes, flag(False))))
    told = F.when(some, F.zip_with("texts", flags, lambda t, k: F.struct(t.alias("text"), k["kept"].alias("kept"))))
    joined = joined.withColumns({"chunks_total": F.when(some, F.size("texts")), "all": told, "body": F.coalesce(body, F.lit(""))})
    return outcome(joined, model, use_code_blocks, False)


def outcome(joined: DataFrame, model: str, use_code_blocks: bool, adaptive: bool) -> DataFrame:
    """The rows of ``compress`` from each document's facts, chunks and what is left of it."""
    joined = joined.withColumn("after", T.token_count(F.col("body"), model))
    grown = (F.col("after") >= F.col("original_tokens")) & (F.coalesce("chunks_total", F.lit(0)) > 0)
    out = F.when(grown, F.col("original_tokens")).otherwise(F.col("after"))
    return joined.select(
        "doc_id", "content_type", "original_tokens", out.alias("compressed_tokens"), T.ratio(F.col("original_tokens"), out).alias("compression_ratio"),
        F.coalesce("chunks_total", F.lit(0)).alias("chunks_total"), F.when(grown, F.col("chunks_total")).otherwise(F.coalesce("n_kept", F.lit(0))).alias("chunks_kept"),
        (F.coalesce("n_near", F.lit(0)) + F.coalesce("collapsed", F.lit(0))).alias("near_duplicates_removed"), F.coalesce("collapsed", F.lit(0)).alias("structural_lines_collapsed"),
        F.when(grown, F.col("text")).otherwise(F.col("body")).alias("compressed_text"),
        F.transform("all", lambda c: F.struct(c["text"].alias("text"), (c["kept"] | grown).alias("kept"))).alias("diff_lines"), compress_notes(grown, use_code_blocks, adaptive).alias("notes"),
    )


def own_keys(rows: DataFrame, *keys: str) -> bool:
    """Whether the keys tell all rows apart and none is null."""
    missing = functools.reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(missing | (F.col("_n") > 1)).isEmpty()


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _row, a number of their own; written, so that it stays the same."""
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def compress_notes(grown: Column, use_code_blocks: bool, adaptive: bool) -> Column:
    """What each step of ``compress`` did with a document, in order; none for an empty text."""
    n = lambda c: F.coalesce(c, F.lit(0))
    prose, some = F.col("content_type") == "prose", n("chunks_total") > 0
    blocks = "chunking: %d logical code blocks (block-aware)" if use_code_blocks else "chunking: %d lines (block-aware chunking unavailable)"
    steps = F.array(
        F.concat(F.lit("detected content type: "), "content_type"),
        F.when(prose, "structural pass: skipped (prose content)").otherwise(F.format_string("structural pass: removed %d blank-line runs, collapsed %d repeated lines/blocks", n("blank_runs"), n("collapsed"))),
        F.when(F.col("content_type") == "code", F.format_string(blocks, n("chunks_total"))),
        F.when(some, F.format_string("semantic dedup: removed %d near-duplicate chunks" + (" (adaptive threshold)" if adaptive else ""), n("n_near"))),
        F.when(n("n_restored") > 0, F.format_string("dependency closure: restored %d block(s) still referenced elsewhere", "n_restored")),
        F.when(grown, "guardrail: compression would have increased size, returned original text"),
    )
    return F.when(F.col("original_tokens") > 0, F.array_compact(steps)).otherwise(F.array().cast("array<string>"))


def renumbered(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1).cast("int").alias("idx"), "text")


def compress_files(files: DataFrame, target_compression: float, model: str, touched: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The common part of repositories and diffs over files (scope, path, doc_id, text): a file's doc_id is its own, ends as its path does and follows the order of paths within a scope, the
    repository or diff that references stay in. ``touched`` picks, of blocks, those that stay and are charged first."""
    blocks = written(chunking.code_blocks(files, python_only_by_name=True).withColumn("tokens", T.token_count(F.col("text"), model)).withColumn("scope", F.split("doc_id", "\u0000")[0]), "blocks")
    sized = files.select("scope", "path", "doc_id", "text", T.token_count(F.col("text"), model).alias("original_tokens"))
    if touched is None:
        changed = blocks.select("doc_id", "idx", "tokens").limit(0)
    else:
        changed = written(touched(blocks).select("doc_id", "idx", "tokens"), "changed")
    spent = changed.groupBy("doc_id").agg(F.sum("tokens").alias("spent"))
    budgets = sized.join(spent, "doc_id", "left").select("doc_id", T.budget(F.col("original_tokens"), target_compression).alias("budget"), F.coalesce("spent", F.lit(0)).alias("spent"))
    scored = similarity.density_scores(blocks.join(changed, ["doc_id", "idx"], "left_anti").select("doc_id", "idx", "text", "tokens"), with_text=False)
    kept = selection.select_under_budget(scored, budgets, first_always=touched is None).union(changed.select("doc_id", "idx"))
    edges = written(graph.reference_edges(blocks, graph.symbol_table(blocks, "scope"), "scope"), "edges")
    reached = written(graph.dependency_closure(kept, edges), "closed")
    marked = blocks.join(reached, ["doc_id", "idx"], "left").join(changed.select("doc_id", "idx", F.lit(True).alias("changed")), ["doc_id", "idx"], "left")
    listed = marked.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text", F.col("restored").isNotNull().alias("kept")))).alias("all"), F.count(F.lit(1)).cast("int").alias("blocks_total"),
        F.count("restored").cast("int").alias("n_kept"), F.count("changed").cast("int").alias("n_changed"), F.count(F.when(F.col("restored"), 1)).cast("int").alias("n_restored"),
    )
    both = sized.join(listed, "doc_id", "left").withColumn("body", F.when(F.col("all").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter("all", lambda c: c["kept"]), lambda c: c["text"]), "\n\n")))
    both = both.withColumn("after", T.token_count(F.col("body"), model))
    grown = F.col("after") >= F.col("original_tokens")
    none = F.lit(0)
    # Where nothing shrinks the whole file stays, and a diff's blocks all count as kept.
    kept_count = F.when(grown & F.lit(touched is not None), F.col("blocks_total")).otherwise(F.col("n_kept"))
    return both.select(
        "scope", "path", "original_tokens", F.least("after", "original_tokens").alias("compressed_tokens"), F.when(grown, F.col("text")).otherwise(F.col("body")).alias("compressed_text"),
        F.coalesce("n_changed", none).alias("changed_blocks_kept"), F.coalesce(kept_count - F.col("n_changed") - F.col("n_restored"), none).alias("context_blocks_kept"),
        F.coalesce("n_restored", none).alias("dependency_blocks_restored"), F.coalesce("blocks_total", none).alias("blocks_total"),
        F.coalesce(F.transform("all", lambda c: F.struct(c["text"].alias("text"), (c["kept"] | (grown & F.lit(touched is not None))).alias("kept"))), F.array(F.struct(F.col("text"), F.lit(True).alias("kept")))).alias("diff_lines"),
    )


def file_key(scope: Column, path: Column, row: Column | None = None) -> Column:
    """A file's id: within a scope in the order of paths, and with a path's ending. ``row`` tells repeated paths apart."""
    empty = F.lit("")
    return F.concat_ws("\u0000", F.coalesce(scope.cast("string"), empty), *([F.coalesce(path, empty), F.lpad(row.cast("string"), 20, "0")] if row is not None else []), F.coalesce(path, empty))


def compress_repo(files: DataFrame, target_compression: float = 0.70, model: str = "default") -> DataFrame:
    """One row per file (doc_id is its path; with a column repo, files of several repositories): each under its share of the budget, with definitions restored across the files of its repository.

    Rows are files of their own: paths may be repeated, in one repository or in several, or null. Empty or null texts give 0 tokens. The columns are path and counts, and repo where ``files`` has it.
    """
    many = "repo" in files.columns
    plain = files.select(F.col("repo") if many else F.lit("").alias("repo"), F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    if own_keys(plain, "repo", "path"):
        keyed = plain.withColumn("doc_id", file_key(F.col("repo"), F.col("path")))
    else:
        keyed = numbered(plain).withColumn("doc_id", file_key(F.col("repo"), F.col("path"), F.col("_row")))
    done = compress_files(keyed.withColumnRenamed("repo", "scope").select("scope", "path", "doc_id", "text"), target_compression, model).withColumnRenamed("scope", "repo")
    return done if many else done.drop("repo")


def compress_diff(hunks: DataFrame, files: DataFrame, target_compression: float = 0.70, model: str = "default") -> DataFrame:
    """One row per diff and changed file, with its diff_id: touched blocks stay, context fills the budget, definitions are restored across the changed files of its diff.

    ``files`` (doc_id is the path, text) hold the contents of all diffs, or of each, with a column diff_id. Files without content are left out; ``diffs.skipped_files`` lists them.
    """
    held = diffs.contents(files)
    wanted = hunks.select("diff_id", "path").distinct().join(held, [c for c in ("diff_id", "path") if c in held.columns])
    keyed = wanted.select(F.col("diff_id").alias("scope"), "path", file_key(F.col("diff_id"), F.col("path")).alias("doc_id"), "text")
    placed = hunks.withColumn("path", file_key(F.col("diff_id"), F.col("path")))
    return compress_files(keyed, target_compression, model, lambda blocks: diffs.touched_blocks(blocks, placed)).withColumnRenamed("scope", "diff_id")


def totals(files: DataFrame) -> DataFrame:
    """Sums over files: of all, or of each repository or diff where ``files`` has such a column."""
    sums = files.groupBy(*(c for c in ("repo", "diff_id") if c in files.columns)).agg(F.count(F.lit(1)).alias("files"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), F.sum("dependency_blocks_restored").alias("restored"))
    return sums.withColumn("compression_ratio", T.ratio(F.col("original_tokens"), F.col("compressed_tokens")))


def compress_session(turns: DataFrame, protect_recent: int = 4, target_compression: float = 0.70, model: str = "default", dedup_threshold: float | None = 0.9, min_turn_tokens: int = 20) -> DataFrame:
    """One row per turn (conv_id, turn): role, action, original_tokens, compressed_tokens, content. Older turns are compressed as prose.

    Rows are turns of their own: null conversations are one, and repeated turn numbers follow each other."""
    if not own_keys(turns, "conv_id", "turn"):
        # Turns that the keys do not tell apart: each goes on under its place among its conversation's.
        rows = numbered(turns.select("conv_id", "turn", "role", "content"))
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "_row")) - 1
        rows = written(rows.select(F.to_json(F.struct(F.col("conv_id").alias("c"))).alias("_conv"), place.alias("_place"), "conv_id", "turn", "role", "content"), "placed")
        done = compress_session(rows.select(F.col("_conv").alias("conv_id"), F.col("_place").alias("turn"), "role", "content"), protect_recent, target_compression, model, dedup_threshold, min_turn_tokens)
        named = done.withColumnsRenamed({"conv_id": "_conv", "turn": "_place"}).join(rows.select("_conv", "_place", "conv_id", "turn"), ["_conv", "_place"])
        return named.select("conv_id", "turn", *(c for c in done.columns if c not in ("conv_id", "turn")))
    # A turn goes on as a document under its number.
    acted = sessions.turn_actions(turns, protect_recent, dedup_threshold, min_turn_tokens)
    tokens = F.col("tokens") if model == "default" else T.token_count(F.col("content"), model)
    older = acted.filter("compress").select(F.col("_row").alias("doc_id"), F.coalesce("content", F.lit("")).alias("text"), tokens.alias("original_tokens"))
    squeezed = compress_prose(older, target_compression, 0.85, model, (), True).select(F.col("doc_id").alias("_row"), "compressed_tokens", "compressed_text")
    both = acted.join(squeezed, "_row", "left")
    gone = F.col("action") == "dropped_duplicate"
    return both.select(
        "conv_id", "turn", "role", "action", F.col("tokens").alias("original_tokens"), F.when(gone, 0).otherwise(F.coalesce("compressed_tokens", "tokens")).alias("compressed_tokens"),
        F.when(gone, "").otherwise(F.coalesce("compressed_text", "content")).alias("content"),
    )


def session_totals(turns: DataFrame) -> DataFrame:
    sums = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns_total"), F.count_if(F.col("action") != "dropped_duplicate").alias("turns_kept"), F.count_if(F.col("action") == "dropped_duplicate").alias("turns_dropped_duplicate"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))
    return sums.withColumn("compression_ratio", F.greatest(F.lit(0.0), T.ratio(F.col("original_tokens"), F.col("compressed_tokens"))))


def session_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): surviving turns as JSON, in order."""
    kept = turns.filter("action <> 'dropped_duplicate'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return kept.select("conv_id", F.to_json(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), {"pretty": "true"}).alias("messages"))
