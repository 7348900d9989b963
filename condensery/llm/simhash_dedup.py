"""SimHash near-duplicates: fingerprints that differ in few bits, by a self-join of binary tries over node pairs.

Two of ``bits`` differing bits at most agree in at least two of six blocks of a fingerprint. For each of the fifteen pairs of blocks a trie holds all
fingerprints with those two blocks on top, so each pair of fingerprints that is to be found lies below one node of some trie: a node pair of a node with itself
and no differing bits so far. From there node pairs are traversed together: (a, b) gives the pairs of their children, differing bits add up, and a pair beyond the
budget is left with everything below it. A node whose leaves are one component already needs no visit.

Small nodes are traversed where their leaves meet, many of them at once as arrays of leaf ranges. Nodes with more than ``leaves`` leaves are
opened by Spark, four levels a round, as a table of node pairs with their differing bits, until what is left of each pair is small. Before that, fingerprints that
agree in all but four neighbouring bits are linked: at most sixteen share such a node of the bottom levels.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import forget, slices, texts_of, words_of, written
from .components import components
from .minhash_dedup import HEAVY_GROUPS

WORDS, BITS, SEED = 4, 4, 42
#: Leaves of a node pair, at most, that one traversal takes.
LEAVES = 1024
#: Levels that a round opens.
STRIDE = 4
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16


def blocks_of(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the bits + 2 blocks, of nearly the same width."""
    ends = [round(64 * k / (bits + 2)) for k in range(bits + 3)]
    return [(a, b - a) for a, b in itertools.pairwise(ends)]


def set_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of ``hashes``, how many have each of the 64 bits, lowest first: an (n, 64) array."""
    n = len(offsets) - 1
    counts = np.zeros((n, 64), np.int64)
    for lo in range(0, len(hashes), SHINGLES):
        part = hashes[lo : lo + SHINGLES]
        rows = np.flatnonzero((offsets[1:] > lo) & (offsets[:-1] < lo + len(part)))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        begins = np.maximum(offsets[rows] - lo, 0)
        filled = begins < np.minimum(offsets[rows + 1] - lo, len(part))
        counts[rows[filled]] += np.add.reduceat(bits, begins[filled], axis=0, dtype=np.int32)
    return counts


def simhashes(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprints of an array of texts: bit by bit, whether over half the shingles' XXH64 have it."""
    flat, offsets = words_of(pc.ascii_lower(texts))
    n = np.diff(offsets)
    # All words in one array of bytes, a space behind each: a shingle is a run of it.
    held = pc.binary_join(pa.array([flat.to_pylist()], pa.list_(pa.string())), " ")[0].as_py().encode() if len(flat) else b""
    ends = np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    per_row = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = np.concatenate([[0], np.cumsum(per_row)])
    first = np.repeat(offsets[:-1] - at[:-1], per_row) + np.arange(at[-1])
    last = np.minimum(first + words, np.repeat(offsets[1:], per_row)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(held[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    over = 2 * set_bits(hashes, at) > per_row[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and print, the 64 bits of its fingerprint as a long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhashes(texts_of(batch), words).view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long")


def node(turned: Column, depth: int) -> Column:
    """The first ``depth`` bits."""
    return F.shiftrightunsigned(turned, 64 - depth) if depth < 64 else turned


def turned_by(bits: int) -> list[tuple[Column, int]]:
    """For each pair of blocks, a print with these two moved to the top, and how many bits they are."""
    out = []
    blocks = blocks_of(bits)
    for pair in itertools.combinations(range(len(blocks)), 2):
        order = [blocks[k] for k in (*pair, *(k for k in range(len(blocks)) if k not in pair))]
        moved, room = [], 64
        for low, width in order:
            room -= width
            moved.append(F.shiftleft(F.shiftrightunsigned(F.col("print"), low).bitwiseAND((1 << width) - 1), room))
        out.append((functools.reduce(Column.bitwiseOR, moved), order[0][1] + order[1][1]))
    return out


def bottom_links(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b) of prints that agree in all but ``bits`` neighbouring ones, each node's least print with its others."""
    masks = [F.struct(F.lit(k).alias("k"), F.col("print").bitwiseAND(F.bitwise_not(F.lit(((1 << bits) - 1) << k if k + bits < 64 else -(1 << k)))).alias("rest")) for k in range(0, 65 - bits, bits)]
    below = prints.select("print", F.explode(F.array(*masks)).alias("x")).groupBy("x").agg(F.sort_array(F.collect_list("print")).alias("all")).filter(F.size("all") > 1)
    return below.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << bits)).alias("b"))


def joined(turned: np.ndarray, roots: np.ndarray, bounds: np.ndarray, sides: np.ndarray, depths: np.ndarray, spent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of leaves of different roots that differ in ``bits`` bits at most, by traversing node pairs together.

    Task k's leaves are ``turned[bounds[k]:bounds[k + 1]]``; ``sides[k]`` is where its second node begins (its first leaf where the pair is a
    node with itself). Each node's leaves are sorted. ``depths`` are the levels at which the pairs stand, ``spent`` their differing bits.
    """
    changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # A pair of ranges: begin and end of either, and the bits that are spent.
    live = np.zeros((0, 5), np.int64)
    begin, end = bounds[:-1], bounds[1:]
    own = sides == begin
    whole = np.stack([begin, np.where(own, end, sides), sides, end, spent], 1)
    for level in range(int(depths.min(initial=64)), 65):
        live = np.concatenate([live, whole[depths == level]])
        a, b, c, d, used = live.T
        live = live[(used <= bits) & (b > a) & (d > c)]
        a, b, c, d, used = live.T
        # Both of one component already: nothing to find.
        live = live[(changes[b - 1] != changes[a]) | (changes[d - 1] != changes[c]) | (roots[a] != roots[c])]
        a, b, c, d, used = live.T
        # Two leaves go the rest of the way at once; what differs above this level is spent already.
        leaf = (b - a == 1) & (d - c == 1)
        i, j = a[leaf], c[leaf]
        below = np.uint64((1 << (64 - level)) - 1)
        near = np.bitwise_count((turned[i] ^ turned[j]) & below).astype(np.int64) + used[leaf]
        close = near <= bits
        found.append((i[close], j[close]))
        live = live[~leaf]
        if level == 64 or not (len(live) or (depths > level).any()):
            break
        a, b, c, d, used = live.T
        ones = np.concatenate([[0], np.cumsum((turned >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)])
        m, o = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        self_pair = a == c
        more = used + 1
        live = np.concatenate(
            [np.stack([a, m, c, o, used], 1), np.stack([m, b, o, d, used], 1), np.stack([a, m, o, d, more], 1), np.stack([m, b, c, o, more], 1)[~self_pair]]
        )
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between ids, those that join what the ones before have not joined."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def traversed(leaves: DataFrame, bits: int, most: int) -> DataFrame:
    """(a, b): links between roots, found below the node pairs of ``leaves`` (trie, depth, a, b, spent, side, turned, root).

    A task reads its node pairs sorted; only the last one of a batch, of bounded size, waits for the next batch.
    """
    names = ["trie", "depth", "a", "b"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """Whole node pairs, of so many leaves that all pairs of them would fit in memory."""
        held: dict[str, np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                got = {c: batch.column(c).to_numpy() for c in batch.schema.names}
                held = got if held is None else {c: np.concatenate([held[c], got[c]]) for c in got}
            if held is None or not len(held["a"]):
                continue
            same = np.ones(len(held["a"]) - 1, bool)
            for c in names:
                same &= held[c][1:] == held[c][:-1]
            cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(held["a"])]])
            work, at = np.cumsum(np.diff(cuts) ** 2), 0
            last = len(cuts) - (1 if batch is None else 2)
            while at < last:
                to = max(at + 1, int(np.searchsorted(work[:last], (work[at - 1] if at else 0) + 4 * most**2, "right")))
                yield {c: x[cuts[at] : cuts[to]] for c, x in held.items()} | {"cuts": cuts[at : to + 1] - cuts[at]}
                at = to
            held = {c: x[cuts[last] :] for c, x in held.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            cuts, first = x["cuts"], x["cuts"][:-1]
            second = first + np.add.reduceat((x["side"] == 0).astype(np.int64), first)
            sides = np.where(second == cuts[1:], first, second)
            i, j = joined(x["turned"].view(np.uint64), x["root"], cuts, sides, x["depth"][first].astype(np.int64), x["spent"][first].astype(np.int64), bits)
            links = np.unique(np.stack([x["root"][i], x["root"][j]], 1), axis=0)
            kept = spanning(links[:, 0], links[:, 1])
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.int64()), pa.array([q for _, q in kept], pa.int64())], ["a", "b"])

    dealt = leaves.repartition(*names).sortWithinPartitions(*names, "side", F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(visit, "a long, b long")


def opened(pairs: DataFrame, members: DataFrame, depth: int, bits: int) -> DataFrame:
    """The node pairs ``STRIDE`` levels below ``pairs`` (trie, a, b, spent) that stand at ``depth``: the same columns, and n, the leaves of both."""
    below = members.groupBy("trie", node(F.col("turned"), depth + STRIDE).alias("child")).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    below = written(below.withColumn("parent", F.shiftrightunsigned("child", STRIDE)), "trie-nodes")
    one, two = (below.select("trie", F.col("parent").alias(p), F.col("child").alias(f"{p}_child"), F.col("n").alias(f"{p}_n"), F.col("low").alias(f"{p}_low"), F.col("high").alias(f"{p}_high")) for p in "ab")
    spent = F.col("spent") + F.bit_count(F.col("a_child").bitwiseXOR(F.col("b_child")).bitwiseAND((1 << STRIDE) - 1))
    met = pairs.select("trie", "a", "b", "spent").join(one, ["trie", "a"]).join(two, ["trie", "b"]).filter("a <> b OR a_child <= b_child")
    apart = (F.least("a_low", "b_low") < F.greatest("a_high", "b_high")) & ((F.col("a_child") != F.col("b_child")) | (F.col("a_n") > 1))
    return met.withColumn("spent", spent.cast("int")).filter((F.col("spent") <= bits) & apart).select(
        "trie", F.col("a_child").alias("a"), F.col("b_child").alias("b"), "spent", F.when(F.col("a_child") == F.col("b_child"), F.col("a_n")).otherwise(F.col("a_n") + F.col("b_n")).alias("n")
    )


def leaves_of(pairs: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """The leaves of node pairs that stand at ``depth``, side 0 before side 1."""
    pairs = pairs.select("trie", F.lit(depth).alias("depth"), "a", "b", "spent")
    ends = pairs.withColumn("end", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at"))))))
    at = members.withColumn("at", node(F.col("turned"), depth))
    return ends.select("trie", "depth", "a", "b", "spent", "end.side", "end.at").join(at, ["trie", "at"]).select("trie", "depth", "a", "b", "spent", "side", "turned", "root")


def print_links(prints: DataFrame, bits: int, leaves: int) -> DataFrame:
    """(a, b) of links between prints (print, root) of different roots, named by their roots, that join all that differ in ``bits`` bits at most."""
    tries = turned_by(bits)
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("trie"), x.alias("turned")) for k, (x, _) in enumerate(tries))))
    # All tries start at the same level, the least that two blocks have.
    top = min(depth for _, depth in tries)
    every = prints.select("root", turned.alias("x")).select("x.trie", "x.turned", "root")
    nodes = every.groupBy("trie", node(F.col("turned"), top).alias("a")).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    nodes = written(nodes.select("trie", "a", F.col("a").alias("b"), F.lit(0).alias("spent"), "n"), "trie-pairs")
    under = every.withColumn("a", node(F.col("turned"), top)).join(nodes.select("trie", "a", "n"), ["trie", "a"])
    members = written(under.select("trie", "a", "turned", "root", "n"), "trie-leaves")
    small = members.filter(F.col("n") <= leaves).select("trie", F.lit(top).alias("depth"), "a", F.col("a").alias("b"), F.lit(0).alias("spent"), F.lit(0).alias("side"), "turned", "root")
    links, made = [written(traversed(small, bits, leaves), "trie-links")], [nodes, members]
    pairs, depth = nodes.filter(F.col("n") > leaves), top
    while not pairs.isEmpty():
        # Only leaves of nodes that are still open.
        ends = written(pairs.select("trie", F.col("a").alias("at")).union(pairs.select("trie", F.col("b").alias("at"))).distinct(), "trie-ends")
        members = written(members.withColumn("at", node(F.col("turned"), depth)).join(ends, ["trie", "at"], "left_semi").select("trie", "turned", "root"), "trie-open")
        below = written(opened(pairs, members, depth, bits), "trie-pairs")
        depth += STRIDE
        links.append(written(traversed(leaves_of(below.filter(F.col("n") <= leaves), members, depth), bits, leaves), "trie-links"))
        made += [ends, members, below]
        pairs = below.filter(F.col("n") > leaves)
    forget(*made)
    return functools.reduce(DataFrame.union, links)


def print_components(prints: DataFrame, bits: int = BITS, leaves: int = LEAVES) -> DataFrame:
    """(print, root) of distinct prints: root is the least print that can be reached by links of ``bits`` differing bits at most."""
    first = written(bottom_links(prints, bits), "bottom-links")
    roots = written(components(first), "bottom-roots")
    rooted = written(prints.join(roots.select(F.col("id").alias("print"), "root"), "print", "left").select("print", F.coalesce("root", "print").alias("root")), "rooted")
    links = print_links(rooted, bits, leaves)
    merged = written(components(links), "merged")
    out = written(rooted.join(merged.select(F.col("id").alias("root"), F.col("root").alias("into")), "root", "left").select("print", F.coalesce("into", "root").alias("root")), "print-roots")
    forget(first, roots, rooted, merged)
    return out


def simhash_components(docs: DataFrame, words: int = WORDS, bits: int = BITS, leaves: int = LEAVES) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id that can be reached, itself included).

    Words are runs between ASCII white space, A to Z lower-cased; shingles of ``words`` words count as often as they occur. A text with fewer
    words is one shingle; a text without words, or a null one, has fingerprint zero, which links like any other. Repeated rows come back as often. A null
    doc_id is never a component's id unless all of its ids are null. An empty table gives no rows. Texts of any length are taken whole; other columns play no part.
    """
    signed = written(fingerprints(docs, words), "prints")
    distinct = written(signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    roots = print_components(distinct.select("print"), bits, leaves)
    least = roots.join(distinct, "print").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(roots.join(least, "root").join(distinct.select("print", "n"), "print").select("print", "component_id", "n"), "components")
    forget(distinct, roots)
    # The commonest prints, a bounded number, are resolved where their rows are; none of those that are shuffled has more than a small share of the rows.
    heavy = written(named.filter("n > 1").orderBy(F.desc("n"), "print").limit(HEAVY_GROUPS).select("print", "component_id"), "heavy-prints")
    mapped = signed.join(F.broadcast(heavy), "print")
    rest = signed.join(F.broadcast(heavy.select("print")), "print", "left_anti").join(named.select("print", "component_id"), "print")
    return mapped.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
