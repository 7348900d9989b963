"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is a bag of word shingles weighted by their counts. Every shingle sends a Poisson process of arrivals (seeded by its
hash, at a rate equal to its weight) to the signature's registers, each of which keeps the shingle that came first; a shingle stops
once its next arrival is later than every register's. Two documents agree in a register with the probability Jaccard
similarity J_P of their weights, which is the plain Jaccard similarity when all weights are equal.

Equal signatures of ``rows`` registers make a bucket. In a bucket every member is compared with the hub (the member that shares most
buckets with others) instead of with every other member, and links are verified on the whole bags. What is in one component of the links so far needs no
further comparison. Where a bucket still holds several components, what is left is compared at once if it has few members (each then meets a bounded number of others). In
larger ones some members after the other, from the smallest component on, are compared with those of other components, until none is left. Pairs of different components that are too
far apart are told, without loss, by the parities of their bags (``may_link``) while they meet: they never become rows, and bags are only read for what is near the threshold.

What a bucket has in common (its size, its hub, its components) comes from windows over its ids: one shuffle, and as many rows as there are members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import forget, hashed_words, mix64, shingles, slices, texts_of, written, written_ids
from .components import components
from .suffix_dedup import numbered

WORDS, SIMILARITY = 5, 0.8
#: Bands of registers: a pair at 0.8 misses all of them once in 5,000.
BANDS, ROWS = 36, 7
#: Words of 64 parities that outline a bag: they tell bags of up to some 2,500 shingles apart, and pass pairs of longer ones on to be compared.
PARITIES = [f"p{k}" for k in range(32)]
#: Bags that are outlined at once.
DRAWN = 128
#: Arrivals that a signature takes at once, and of one shingle at most.
ARRIVALS, MOST_STEPS = 1 << 14, 64
#: Members of a bucket, at most, that the first round compares with the others; four times as many in each later one, as fewer are left.
SLOTS = 64
#: Members of a bucket, at most, whose members of different components are all compared.
SMALL = 32
#: More than what rounding can move a similarity or a number of parities.
MARGIN = 1e-6
#: Rounds after which what has been seen is written as one table.
COMPACT = 4
#: Groups, the largest ones, whose sizes are broadcast, so that no shuffled group has more than a small share of the rows.
HEAVY_GROUPS = 1024


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """ProbMinHash of many bags at once: an (n_rows, registers) array of element hashes, 0 where a bag is empty."""
    times = np.full(n_rows * registers, np.inf)
    winners = np.zeros(n_rows * registers, np.uint64)
    live, clock, latest, k = np.arange(len(rows)), np.zeros(len(rows)), np.full(n_rows, np.inf), 0
    scale = 1.0 / weights.astype(np.float64)
    with np.errstate(over="ignore"):
        while len(live):
            # Small bags need many arrivals of each shingle: the fewer shingles are left, the more arrivals of each are taken at once.
            steps = np.arange(k + 1, k + 1 + max(1, min(MOST_STEPS, ARRIVALS // len(live))), dtype=np.uint64)
            k += len(steps)
            r = mix64(elements[live, None] + steps * np.uint64(0x9E3779B97F4A7C15))
            # Upper bits give the time that passes to the next arrival, a remix gives its register.
            at = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) * scale[live, None]
            at[:, 0] += clock
            at = np.cumsum(at, axis=1)
            on_time = at < latest[rows[live], None]
            which, _ = np.nonzero(on_time)
            r, arrived, owner = r[on_time], at[on_time], live[which]
            live, clock = live[on_time[:, -1]], at[on_time[:, -1], -1]
            slot = rows[owner] * registers + (mix64(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
            better = arrived < times[slot]
            s, t, e = slot[better], arrived[better], elements[owner[better]]
            np.minimum.at(times, s, t)
            won = t == times[s]
            winners[s[won]] = e[won]
            touched = np.unique(s // registers)
            latest[touched] = times.reshape(n_rows, registers)[touched].max(1)
    return winners.reshape(n_rows, registers)


def band_keys(z: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of signatures (n, bands * rows), and of which band it is."""
    z = z.reshape(len(z), bands, rows)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(z), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
        for j in range(rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + z[:, :, j])
    return keys


def key_lists(keys: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))


def digested(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a 128-bit digest of the bag (null for an empty one) and the band hashes of its signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                flat, offsets = hashed_words(texts_of(batch))
                row, bag, count = shingles(flat, offsets, words)
                n = batch.num_rows
                keys = band_keys(signatures(row, bag, count, n, bands * rows), bands, rows)
                with np.errstate(over="ignore"):
                    counted = mix64(bag + mix64(count.astype(np.uint64)))
                    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    np.add.at(one, row, counted)
                    np.add.at(two, row, mix64(counted ^ np.uint64(0xA0761D6478BD642F)))
                empty = np.bincount(row, minlength=n) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(one.view(np.int64), mask=empty), pa.array(two.view(np.int64), mask=empty), key_lists(keys)],
                    ["doc_id", "one", "two", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, one long, two long, bands array<long>")


def bags(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its whole bag: distinct shingle hashes in order, and their counts, as bytes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                flat, offsets = hashed_words(texts_of(batch))
                row, bag, count = shingles(flat, offsets, words)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                parts = list(zip(ends[:-1], ends[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([bag[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([b"" if (count[a:b] == 1).all() else count[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary())],
                    ["doc_id", "bag", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(collect, "doc_id long, bag binary, counts binary")


def probability_jaccard(x: np.ndarray, xc: np.ndarray | None, y: np.ndarray, yc: np.ndarray | None) -> float:
    """Exact J_P of two bags given as sorted hashes with counts, or None where all are 1: the sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(x) or not len(y):
        return 0.0
    # Both are sorted: the places of y's elements in x.
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    if xc is None and yc is None:
        shared = int(np.count_nonzero(same))
        return shared / (len(x) + len(y) - shared)
    xc, yc = (np.ones(len(v), np.uint32) if c is None else c for v, c in ((x, xc), (y, yc)))
    iy = np.flatnonzero(same)
    ix = at[iy]
    if not len(ix):
        return 0.0
    a, b = xc[ix].astype(np.float64), yc[iy].astype(np.float64)
    both, n = np.unique(xc[ix].astype(np.uint64) << np.uint64(32) | yc[iy].astype(np.uint64), return_counts=True)
    kinds = np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)]).astype(np.float64)
    only_x, only_y = xc.sum() - a.sum(), yc.sum() - b.sum()
    # Elements with the same two counts give the same term.
    below = only_x / kinds[0] + only_y / kinds[1] + (np.maximum(kinds[0][None, :] / kinds[0][:, None], kinds[1][None, :] / kinds[1][:, None]) * n).sum(1)
    return float((n / below).sum())


def verified(pairs: DataFrame, bagged: DataFrame) -> DataFrame:
    """The given pairs (a, b and further columns) with their similarity, on whole bags. ``a`` is the hub: its bag comes by the last join."""
    own = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch, side: str) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
            for bag, counts in zip(batch[f"bag_{side}"], batch[f"counts_{side}"], strict=True):
                counts = counts.as_buffer()
                yield np.frombuffer(bag.as_buffer(), np.uint64), np.frombuffer(counts, np.uint32) if counts.size else None

        for batch in batches:
            near = [probability_jaccard(*x, *y) for x, y in zip(read(batch, "a"), read(batch, "b"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(near, pa.float64())], [*own, "similarity"])

    left = bagged.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"), F.col("counts").alias("counts_a"))
    right = bagged.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"), F.col("counts").alias("counts_b"))
    # Few pairs are left of a partition: some partitions, and parts of those that AQE has split, are one task.
    spark = pairs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select(*own, "bag_a", "counts_a", "bag_b", "counts_b").coalesce(tasks).mapInArrow(compare, ", ".join(f"{c} long" for c in own) + ", similarity double")


def outlined(bagged: DataFrame) -> DataFrame:
    """doc_id, weight (shingles with repeats) and ``PARITIES`` of each bag (doc_id, bag, counts): each bit tells whether an odd number of the distinct shingles hash to it."""
    bits = 64 * len(PARITIES)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DRAWN):
                batch = whole.slice(at, DRAWN)
                held = [np.frombuffer(b.as_buffer(), np.uint64) for b in batch["bag"]]
                weight = [int(np.frombuffer(c.as_buffer(), np.uint32).sum()) if c.as_buffer().size else len(x) for c, x in zip(batch["counts"], held, strict=True)]
                place = np.repeat(np.arange(len(held)), [len(x) for x in held]) * bits + (np.concatenate(held) % np.uint64(bits)).astype(np.int64)
                odd = (np.bincount(place, minlength=len(held) * bits) & 1).astype(np.uint8).reshape(len(held), bits)
                words = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(weight, pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["doc_id", "weight", *PARITIES])

    return bagged.select("doc_id", "bag", "counts").mapInArrow(draw, ", ".join(f"{c} long" for c in ("doc_id", "weight", *PARITIES)))


def may_link(one: str, two: str, similarity: float) -> Column:
    """False only for pairs of outlines (weight and ``PARITIES``) whose J_P is below ``similarity``.

    A shingle that one bag alone has flips one parity at most, so at least as many shingles as parities differ are in one bag alone. If these have the shares f and g of the two weights, J_P is at
    most 1 / (1 + f / (1 - f) + g / (1 - g)): a term of J_P is at most 1 / (1 / p + g / q) for its shares p and q, which is concave and homogeneous, so its sum is at most its value at the
    sums 1 - f and 1 - g. A shingle weighs 1 at least, thus f + g is at least the number that differ over the larger weight; the bound is loosest with f = g.
    """
    apart = sum((F.bit_count(F.col(f"{one}.{p}").bitwiseXOR(F.col(f"{two}.{p}"))) for p in PARITIES[1:]), F.bit_count(F.col(f"{one}.{PARITIES[0]}").bitwiseXOR(F.col(f"{two}.{PARITIES[0]}"))))
    return apart <= 2 * (1 - similarity) / (1 + similarity) * F.greatest(f"{one}.weight", f"{two}.weight") + MARGIN


def settled(members: DataFrame, bagged: DataFrame, seen: DataFrame, similarity: float, small: int = SMALL) -> DataFrame | None:
    """(a, b) of further links between members (key, rep, root) of a bucket that are in different components.

    A bucket with at most ``small`` members is compared at once. A round compares a few members of each larger one, of all its components but the largest and from the smallest on, with those
    of its other components, but for pairs seen before and pairs whose outlines are too far apart; they have then met all of them and leave the bucket. Buckets close when one component is
    left, so comparisons grow with members and rounds and no round makes all pairs of a large bucket.
    """
    outlines = written(outlined(bagged.join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")), "outlines")
    open_, found, held, turn = members, None, [], 0
    while True:
        turn += 1
        now = written_ids(on_turn(open_, small, SLOTS << min(2 * turn - 2, 16)).join(outlines.withColumnRenamed("doc_id", "rep"), "rep"), "now")
        if now.isEmpty():
            forget(now, outlines)
            return found
        if turn % COMPACT == 0:
            # What earlier rounds have compared and found as one table each: a round's plan doesn't grow with the number of rounds.
            seen = written(seen, "seen")
            found = written(found, "found") if found is not None else None
            forget(*held)
            held = [seen]
        one, two = (now.select("key", F.struct("rep", "root").alias(k), (F.col("few") | F.col("turn")).alias(f"meets_{k}"), F.struct("weight", *PARITIES).alias(f"outline_{k}")) for k in ("one", "two"))
        met = one.filter("meets_one").join(two, "key").filter("one.root <> two.root AND (one.rep > two.rep OR NOT meets_two)").filter(may_link("outline_one", "outline_two", similarity))
        # A pair comes once, whichever side's turn it is: with its roots, links need no look-up.
        met = met.select(F.greatest("one", "two").alias("x"), F.least("one", "two").alias("y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")).distinct()
        near = written(verified(met.join(seen.select("a", "b"), ["a", "b"], "left_anti"), bagged), "near")
        links = near.filter(F.col("similarity") >= similarity)
        found = links.select("a", "b") if found is None else found.union(links.select("a", "b"))
        seen = seen.select("a", "b").union(near.select("a", "b"))
        held.append(near)
        open_ = now.filter("NOT few AND NOT turn").select("key", "rep", "root")
        if not links.isEmpty():
            # Components that have met go on as one.
            merged = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("into"))
            open_ = open_.join(merged, "root", "left").select("key", "rep", F.coalesce("into", "root").alias("root"))


def on_turn(members: DataFrame, small: int, slots: int) -> DataFrame:
    """(key, rep, root, few, turn) of the buckets of ``members`` with several components. few: the bucket has at most ``small`` members; turn: of each of so many slots, the member of the smallest component but for the largest one."""
    bucket = Window.partitionBy("key")
    sized = members.withColumns({"left": F.count(F.lit(1)).over(bucket), "low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).filter("low < high")
    sized = sized.withColumn("size", F.struct(F.count(F.lit(1)).over(Window.partitionBy("key", "root")).alias("n"), "root")).withColumn("largest", F.max("size").over(bucket)["root"])
    slot = F.pmod(F.xxhash64("rep"), F.lit(slots))
    rank = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.col("root") == F.col("largest"), "size.n", "rep"))
    ranked = sized.withColumn("slot", slot).withColumn("rank", rank)
    few = F.col("left") <= small
    return ranked.select("key", "rep", "root", few.alias("few"), (~few & (F.col("rank") == 1) & (F.col("root") != F.col("largest"))).alias("turn"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, group_id (the smallest doc_id of its class), group_size, n_links, kept.

    Words are lower-cased runs between white space; bags hold their ``words``-word shingles with counts (a shorter text is one
    shingle). Documents with equal bags are one class from the start; classes are the components of the links with J_P of at least ``similarity``.
    n_links counts the verified links of the document's bag. A null text counts as empty; texts without words are never near
    anything. A null doc_id gets a null group. Repeated rows of one doc_id come back as often, each in the class of its own text. An empty table gives
    no rows. The smallest doc_id of a class stays.
    """
    docs = docs.select("doc_id", "text")
    if own_ids(docs):
        return classes_of(docs, words, similarity, bands, rows)
    return by_row(numbered(docs).drop("_doc"), words=words, similarity=similarity, bands=bands, rows=rows).drop("row")


def own_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id of its own."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty()


def by_row(texts: DataFrame, **options) -> DataFrame:
    """``near_duplicates`` with row, of rows told apart by row: their doc_ids may be null or repeated, with equal or other texts."""
    known = texts.select(F.col("row").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))
    found = classes_of(known, **options).select(F.col("doc_id").alias("row"), F.col("group_id").alias("root"), "group_size", "n_links")
    named = texts.select("row", "doc_id").join(found, "row")
    least = named.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return named.join(least, "root").select("row", "doc_id", "group_id", "group_size", "n_links", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def classes_of(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """``near_duplicates`` of documents with ids of their own."""
    signed = written(digested(docs, words, bands, rows), "signatures")
    # Equal bags are one class: only its smallest doc_id goes on. A partial aggregate, so a huge class costs little.
    equal = signed.filter("one IS NOT NULL AND doc_id IS NOT NULL").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    reps = written(equal, "classes")
    members = members_of(reps)
    stars = written_ids(starred(members), "stars")
    # The candidates grow with the corpus: shuffled at every size, so that costs follow the input.
    bagged = written(bags(docs.join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), words), "bags")
    near = written(verified(stars, bagged).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "similarity"), "near")
    links = near.filter(F.col("similarity") >= similarity).select("a", "b")
    roots = components(links).select(F.col("id").alias("rep"), "root")
    # With two members the hub has met the other.
    last = written_ids(open_members(members.select("key", "rep").join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), 2).drop("n"), "open")
    more = settled(last, bagged, near, similarity, small)
    every = links if more is None else links.union(more)
    every = written_ids(every.distinct(), "every")
    final = components(every)
    degree = every.select(F.col("a").alias("rep")).union(every.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    classes = (reps.drop("bands").join(final.select(F.col("id").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left").select("one", "two", F.coalesce("root", "rep").alias("root"), "n_links"))
    named = signed.select("doc_id", "one", "two").join(classes, ["one", "two"], "left")
    sized = written_ids(named.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "groups")
    sizes = written_ids(sized.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "group-sizes")
    forget(signed, reps, members, stars, bagged, last, every)
    # The largest groups, a bounded number, are resolved where their rows are; no group that is shuffled has more than a small share of the rows.
    heavy = written_ids(sizes.orderBy(F.desc("group_size"), "group_id").limit(HEAVY_GROUPS), "heavy-groups")
    mapped = sized.join(F.broadcast(heavy), "group_id")
    rest = sized.join(F.broadcast(heavy.select("group_id")), "group_id", "left_anti").join(sizes, "group_id", "left")
    return mapped.unionByName(rest).select(
        "doc_id", "group_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), "n_links", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept")
    )


def open_members(rooted: DataFrame, above: int) -> DataFrame:
    """(key, rep, root, n) of the buckets of ``rooted`` (key, rep, root) that hold several components and more than ``above`` members; n: a bucket's members. Buckets of the same members are one, under another key."""
    bucket = Window.partitionBy("key")
    counted = rooted.withColumns({"n": F.count(F.lit(1)).over(bucket), "low": F.min("root").over(bucket), "high": F.max("root").over(bucket)})
    counted = counted.withColumn("set", F.bit_xor(F.xxhash64("rep")).over(bucket))
    return counted.filter((F.col("low") < F.col("high")) & (F.col("n") > above)).select(F.xxhash64("set", "n").alias("key"), "rep", "root", "n").distinct()


def members_of(reps: DataFrame) -> DataFrame:
    """(key, rep, score) of the buckets of (rep, bands) with two members or more; score: the members of all of a document's buckets, how central it is."""
    crowded = reps.select("rep", F.explode_outer("bands").alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    return written_ids(crowded.select("key", "rep", F.sum("n").over(Window.partitionBy("rep")).alias("score")), "members")


def starred(members: DataFrame) -> DataFrame:
    """(a, b) of each bucket's hub, its most central member, and its other ones."""
    hub = F.first("rep").over(Window.partitionBy("key").orderBy(F.desc("score"), "rep"))
    return members.select(hub.alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    if not own_ids(docs):
        texts = numbered(docs)
        losers = written(by_row(texts.drop("_doc"), **options).filter(~F.col("kept")).select(F.col("row").alias("_drop_row")), "near-losers")
        return texts.join(losers, F.col("row") == F.col("_drop_row"), "left_anti").select("_doc.*")
    losers = written(classes_of(docs.select("doc_id", "text"), **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_drop_id")), "near-losers")
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"))
    return whole.join(losers, F.col("_doc_id") == F.col("_drop_id"), "left_anti").select("_doc.*")
