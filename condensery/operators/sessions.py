"""Chat sessions: export formats, protected turns, per-role duplicates. Turns are (conv_id, turn, role, content)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.storage import written
from . import similarity

TREE = "struct<current_node:string,mapping:map<string,struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:variant>>>>"
MESSAGES = "struct<chat_messages:array<struct<sender:string,text:string,content:variant>>>"
TURN = "array<struct<role:string,content:string>>"


def kind_of(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN or the like: what a variant holds; VOID for a JSON null, null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def as_text(value: Column) -> Column:
    """A JSON value as text: strings as they are, all else as JSON."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def part_text(part: Column) -> Column:
    """Text of one part of a message: a string, a block's text, or a marker of a tool block; empty for all else."""
    field = lambda name: F.try_variant_get(part, f"$.{name}", "string")
    text = F.try_variant_get(part, "$.text", "variant")
    marker = F.concat(F.lit("["), field("type"), F.lit(": "), F.coalesce(field("name"), F.lit("")), F.lit("]"))
    block = F.when(text.isNotNull(), as_text(text)).when(field("type").isin("tool_use", "tool_result"), marker)
    return F.when(kind_of(part) == "STRING", F.try_variant_get(part, "$", "string")).when(kind_of(part) == "OBJECT", block)


def joined_parts(value: Column) -> Column:
    """The texts of a JSON list's parts, without empty ones, one line each."""
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), part_text)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def flat_content(content: Column) -> Column:
    """Text of a message's content, a variant: a string is taken as it is, whatever it looks like; of a list the texts of its parts; of an object its text, else the object as JSON; nothing of null."""
    kind, text = kind_of(content), F.try_variant_get(content, "$.text", "variant")
    flat = F.when(kind == "ARRAY", joined_parts(content)).when((kind == "OBJECT") & text.isNotNull(), as_text(text)).otherwise(as_text(content))
    return F.when(content.isNull() | (kind == "VOID"), "").otherwise(flat)


def tree_branch(conv: Column) -> Column:
    """Nodes from the root to the current one (else the first leaf), following parents at most once each."""
    nodes = conv["mapping"]
    children = F.flatten(F.transform(F.map_values(nodes), lambda n: F.coalesce(n["children"], F.array().cast("array<string>"))))
    leaves = F.array_except(F.map_keys(nodes), children)
    begin = F.when(F.map_contains_key(nodes, F.coalesce(conv["current_node"], F.lit(""))), conv["current_node"]).otherwise(F.coalesce(F.get(leaves, F.lit(0)), F.get(F.map_keys(nodes), F.lit(0))))
    start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("path"))

    def step(acc, _):
        known = F.coalesce(F.map_contains_key(nodes, F.coalesce(acc["at"], F.lit(""))), F.lit(False)) & ~F.array_contains(acc["path"], F.coalesce(acc["at"], F.lit("")))
        return F.when(known, F.struct(F.try_element_at(nodes, acc["at"])["parent"].alias("at"), F.array_append(acc["path"], acc["at"]).alias("path"))).otherwise(acc)

    return F.reverse(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1))), start, step)["path"])


def longest(schema: str, size: Callable[[Column], Column]) -> Column:
    """The conversation of ``raw``, one object or a list of them, that is longest by ``size``; the first of equal ones."""
    listed = F.when(F.ltrim("raw").startswith("["), F.from_json("raw", f"array<{schema}>")).otherwise(F.array(F.from_json("raw", schema)))
    ranked = F.transform(listed, lambda c, i: F.struct(F.coalesce(size(c), F.lit(-1)).alias("size"), (-i).alias("place")))
    best = F.array_max(ranked)
    return F.get(listed, -best["place"])


def parse_exports(exports: DataFrame, strict: bool = False) -> DataFrame:
    """(conv_id, format, turns) from exports (conv_id, raw); the first format with any turn wins. Unknown or broken input has format null; with ``strict`` it fails the query instead.

    Contents are read as variants, so that a string that looks like JSON stays a string.
    """
    # A download holds a list of conversations: the one with most nodes or messages is taken, the first of equal ones.
    tree = longest(TREE, lambda c: F.size(c["mapping"]))
    messages = longest(MESSAGES, lambda c: F.size(c["chat_messages"]))
    p = exports.select("conv_id", "raw", tree.alias("tree"), messages.alias("messages"), F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>").alias("generic"))
    node = lambda k: F.try_element_at(F.col("tree.mapping"), k)
    parts = lambda content: F.coalesce(F.try_variant_get(content, "$.parts", "variant"), content)
    chatgpt = F.filter(
        F.transform(tree_branch(F.col("tree")), lambda k: F.struct(node(k)["message"]["author"]["role"].alias("role"), flat_content(parts(node(k)["message"]["content"])).alias("content"))),
        lambda t: t["role"].isin("system", "user", "assistant", "tool") & ~T.is_blank(t["content"]),
    )
    role = lambda s: F.when(s.isin("assistant", "system"), s).otherwise("user")
    claude = F.filter(F.transform("messages.chat_messages", lambda m: F.struct(role(m["sender"]).alias("role"), F.when(F.coalesce(m["text"], F.lit("")) != "", m["text"]).otherwise(flat_content(m["content"])).alias("content"))), lambda t: ~T.is_blank(t["content"]))
    given = lambda t, name: F.try_variant_get(t, f"$.{name}", "variant")
    plain = F.when(F.forall("generic", lambda t: (kind_of(t) == "OBJECT") & given(t, "role").isNotNull()), F.transform("generic", lambda t: F.struct(as_text(given(t, "role")).alias("role"), flat_content(given(t, "content")).alias("content"))))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    q = p.select("conv_id", F.when(F.col("tree.mapping").isNotNull(), chatgpt).alias("c1"), F.when(F.col("messages.chat_messages").isNotNull(), claude).alias("c2"), plain.alias("c3"))
    pick = lambda a, b, c: F.when(some(F.col("c1")), a).when(some(F.col("c2")), b).when(some(F.col("c3")), c)
    found = pick(F.lit("chatgpt"), F.lit("claude"), F.lit("generic"))
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("unrecognised conversation format: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return q.select("conv_id", found.alias("format"), pick(*(F.col(c).cast(TURN) for c in ("c1", "c2", "c3"))).alias("turns"))


def exploded_turns(parsed: DataFrame) -> DataFrame:
    return parsed.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.content")


def turn_actions(turns: DataFrame, protect_recent: int = 4, dedup_threshold: float | None = 0.9, min_turn_tokens: int = 20) -> DataFrame:
    """``turns`` with tokens, action, compress (whether its text is to be compressed) and _row, a number of its own. Duplicates are looked for per role, among turns that are not protected;
    ``dedup_threshold`` None takes the threshold that fits each role's turns."""
    system = F.col("role") == "system"
    w = Window.partitionBy("conv_id", system).orderBy(F.desc("turn"))
    marked = turns.withColumn("_recent", ~system & (F.row_number().over(w) <= protect_recent)).withColumns({"tokens": T.token_count(F.col("content")), "_row": F.monotonically_increasing_id()})
    marked = written(marked, "marked")
    group = F.to_json(F.struct(F.col("conv_id").alias("c"), F.col("role").alias("r")))
    old = marked.filter(~system & ~F.col("_recent")).select(group.alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.col("content").alias("text"), "conv_id")
    drops = similarity.near_duplicates(old.select("doc_id", "idx", "text"), dedup_threshold)
    # Written, so that its size is known: where it is small, the turns needn't be shuffled to meet it.
    dropped = written(old.join(drops, ["doc_id", "idx"]).select("conv_id", F.col("idx").alias("turn"), F.lit(True).alias("_dropped")), "dropped")
    both = marked.join(dropped, ["conv_id", "turn"], "left").withColumn("_dropped", F.coalesce("_dropped", F.lit(False)))
    action = F.when(system, "protected_system").when(F.col("_dropped"), "dropped_duplicate").when(F.col("_recent"), "protected_recent").otherwise("compressed")
    return both.withColumn("action", action).withColumn("compress", (F.col("action") == "compressed") & (F.col("tokens") >= min_turn_tokens)).drop("_recent", "_dropped")
