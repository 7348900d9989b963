"""Every step of the near-duplicate search on families of texts whose similarity lies about the threshold."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensery.llm import minhash_dedup


def bag(text):
    w = text.split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def similarity(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x.keys() & y.keys())


def changed(text, n, rnd):
    """``text`` with a run of words replaced: that many more shingles are other ones."""
    w = text.split()
    at = rnd.randrange(len(w) - n)
    return " ".join([*w[:at], *(f"new{rnd.randrange(10**6)}" for _ in range(n)), *w[at + n :]])


def roots_of(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("small", [32, 2])
def test_families(spark, small):
    """Members of a family are 0.6 to 0.95 alike, so that buckets hold several components. With ``small`` at 2 all go on to the second signature and its rounds."""
    rnd = random.Random(11)
    texts = []
    for f in range(2):
        base = " ".join(f"f{f}w{rnd.randrange(400)}" for _ in range(160))
        texts += [base] + [changed(base, rnd.choice([4, 8, 14, 20]), rnd) for _ in range(16)]
    bags = [bag(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similarity(bags[a], bags[b]) >= 0.8]
    want = roots_of(range(len(texts)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.classes_of(docs, small=small).collect()}
    assert got == want and len(set(want.values())) > 4


def test_recall_of_planted_pairs(spark):
    """300 pairs of similarity 0.8 to 0.9: the first banding alone misses one at 0.8 once in some thousands."""
    rnd = random.Random(5)
    texts, pairs = [], 0
    while pairs < 300:
        base = " ".join(f"p{pairs}w{k}" for k in range(rnd.randint(80, 200)))
        other = changed(base, max(1, round(len(base.split()) * rnd.uniform(0.02, 0.07))), rnd)
        if 0.8 <= similarity(bag(base), bag(other)) < 0.9:
            texts += [base, other]
            pairs += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(300))
    assert found >= 299 and len(set(got.values())) == 600 - found


def test_small_bags_take_few_steps(monkeypatch):
    """Three shingles fill 1,200 registers with some 3,000 arrivals each; one after the other they took as many steps. Signatures are the same however many are taken at once."""
    calls, mix64 = [], minhash_dedup.mix64
    monkeypatch.setattr(minhash_dedup, "mix64", lambda x: calls.append(len(x)) or mix64(x))
    sizes = [3, 0, 40, 7]
    rows, rnd = np.repeat(np.arange(4), sizes), np.random.default_rng(3)
    bag, count = rnd.integers(0, 2**63, len(rows)).astype(np.uint64), rnd.integers(1, 4, len(rows)).astype(np.uint32)
    got = minhash_dedup.signatures(rows, bag, count, 4, 1_200)
    assert len(calls) < 300
    monkeypatch.setattr(minhash_dedup, "ARRIVALS", 1)
    assert (got == minhash_dedup.signatures(rows, bag, count, 4, 1_200)).all() and not got[1].any() and got[0].all()


def test_steps_make_rows_by_members(spark):
    """What a bucket has in common comes without a join of its members, which were as many rows again for each step."""
    members = spark.createDataFrame([(k % 3, k, k % 5) for k in range(60)], "key long, rep long, root long")
    for made in (minhash_dedup.open_members(members, 2), minhash_dedup.on_turn(members, 4, 4), minhash_dedup.starred(members.withColumnRenamed("root", "score"))):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert minhash_dedup.open_members(members, 20).count() == 0 and minhash_dedup.open_members(members, 2).count() == 60
    turns = minhash_dedup.on_turn(members, 4, 4)
    # Roots have four members in each bucket: the largest of equal ones, 4, has no turn.
    assert turns.count() == 60 and turns.filter("few").count() == 0 and 0 < turns.filter("turn").count() <= 12 and turns.filter("turn AND root = 4").count() == 0


def test_outlines_lose_no_link(spark):
    """Bags about the threshold, a third of them with counts: every pair at 0.8 may link, and what is far apart may not."""
    rnd = random.Random(2)
    texts = []
    for f in range(4):
        base = " ".join(f"f{f}w{rnd.randrange(90 if f % 2 else 10**6)}" for _ in range(120))
        texts += [changed(base + " " + base if f == 3 and k % 3 else base, rnd.randint(1, 16), rnd) for k in range(12)]
    bags = [bag(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = minhash_dedup.outlined(minhash_dedup.bags(docs, 5))
    one, two = (drawn.select(F.col("doc_id").alias(k), F.struct("weight", *minhash_dedup.PARITIES).alias(f"outline_{k}")) for k in ("a", "b"))
    told = {(r["a"], r["b"]): r["may"] for r in one.crossJoin(two).filter("a < b").select("a", "b", minhash_dedup.may_link("outline_a", "outline_b", 0.8).alias("may")).collect()}
    near = {p: similarity(bags[p[0]], bags[p[1]]) for p in told}
    assert sum(s >= 0.8 for s in near.values()) > 20 and all(told[p] for p, s in near.items() if s >= 0.8)
    plain = [p for p, s in near.items() if s < 0.7 and max(bags[p[0]].values()) == max(bags[p[1]].values()) == 1]
    assert len(plain) > 20 and not any(told[p] for p in plain)


def test_large_group_compares_few(spark, monkeypatch):
    """Copies of one text with changes of their own, each at about 0.7 from the others: they share buckets, but only what is near the threshold is compared, without a signature more."""
    rnd = random.Random(8)
    base = " ".join(f"w{k}" for k in range(150))
    texts = [base] + [changed(changed(base, 1 + k % 9, rnd), 1 + k % 7, rnd) for k in range(200)]
    # No shingle comes twice.
    bags = [bag(t).keys() for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])]
    compared, verified = [], minhash_dedup.verified
    monkeypatch.setattr(minhash_dedup, "verified", lambda pairs, bagged: compared.append(pairs.count()) or verified(pairs, bagged))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.classes_of(docs).collect()}
    want = roots_of(range(len(texts)), links)
    assert got == want and len(set(want.values())) > 10
    assert sum(compared[1:]) < 1_000
