"""Own thresholds, keep-first removal and budgets against plain loops, over one document of very many rows too."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensery.operators import selection, similarity, streams

TERM = r"[^\W][\w\-.]*"


def chunks_of(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc_id string, idx int, text string")


def cosines(texts):
    plain = [t for t in texts if len(t.strip()) >= 3]
    bags = [collections.Counter(re.findall(r"\b\w[\w\-.]*\b", t.lower())) for t in plain]
    df = collections.Counter(t for b in bags for t in b)
    n = len(bags)
    vs = []
    for b in bags:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vs.append({t: x / size for t, x in v.items()} if size else {})
    return [round(sum(x * vs[j].get(t, 0) for t, x in vs[i].items()), 9) for i in range(n) for j in range(i + 1, n)], n


def plain_threshold(texts):
    sims, n = cosines(texts)
    return min(max(float(np.percentile(sims, 95)), 0.6), 0.95) if n > 2 else 0.6


def documents():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    docs = {f"random{k}": [" ".join(rnd.choices(words[: 4 + k], k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 25))] for k in range(30)}
    # The percentile lies between a similarity below the floor and one above it.
    for extra in range(6):
        docs[f"parted{extra}"] = ["alpha beta gamma delta", "alpha beta gamma delta", f"alpha beta gamma x{extra}" if extra % 2 else "alpha beta q r", *[f"only{extra} these{k} words{k}" for k in range(3 + extra)]]
    for n in range(3, 25):
        docs[f"one-pair{n}"] = ["same words here", "same words here", *[f"lone{k}" for k in range(n - 2)]]
    docs |= {"few": ["abc def", "abc def"], "trivial": ["a", "b", "", "ab"], "equal": ["one two three"] * 9, "no-terms": ["!!!", "???", "...", "---"]}
    return docs


def test_own_thresholds(spark):
    docs = documents()
    got = {r["doc_id"]: r["threshold"] for r in similarity.adaptive_thresholds(chunks_of(spark, docs)).collect()}
    want = {d: plain_threshold(t) for d, t in docs.items()}
    assert got.keys() == want.keys()
    assert {d: (got[d], want[d]) for d in docs if abs(got[d] - want[d]) > 1e-7} == {}
    assert sum(0.6 < x < 0.95 for x in want.values()) > 5


def test_the_second_filter_asks_only_documents_that_the_floor_parts(spark, monkeypatch):
    asked = []
    plain = similarity.pairs_above
    monkeypatch.setattr(similarity, "pairs_above", lambda v, t: (asked.append(t if isinstance(t, float) else {r["doc_id"] for r in t.collect()}), plain(v, t))[1])
    docs = documents()
    similarity.adaptive_thresholds(chunks_of(spark, docs)).collect()
    parted = set()
    for d, t in docs.items():
        sims, n = cosines(t)
        if n > 2:
            at = (len(sims) - 1) * 0.95
            low, high = sorted(sims)[math.floor(at)], sorted(sims)[min(math.floor(at) + 1, len(sims) - 1)]
            if low < 0.6 <= high:
                parted.add(d)
    assert asked[0] == 0.6 and asked[1] == parted and len(parted) < len(docs) / 2


def test_similar_pairs_of_copies(spark):
    docs = documents()
    got = {(r["doc_id"], r["i"], r["j"]): r["similarity"] for r in similarity.similar_pairs(chunks_of(spark, docs), 0.7).collect()}
    want = {}
    for d, texts in docs.items():
        at = [i for i, t in enumerate(texts) if len(t.strip()) >= 3]
        places = [(i, j) for k, i in enumerate(at) for j in at[k + 1 :]]
        want |= {(d, i, j): s for (i, j), s in zip(places, cosines(texts)[0], strict=True) if s >= 0.7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_vectors_shuffle_chunks_and_not_terms(spark):
    """Terms are counted and weighted where their document is: one shuffle, whose rows grow with the chunks."""
    v = similarity.vectors(chunks_of(spark, {"a": ["one two", "two three"]}), distinct=True)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_whole_keys():
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(k, pa.string())}) for k in (["a", "a"], ["a"], ["a", "b", None], [None, None], [], ["c"], ["d"])]
    assert [b.column("k").to_pylist() for b in streams.whole_keys(iter(batches), "k")] == [["a"] * 4 + ["b"], [None] * 3, ["c"], ["d"]]


def plain_drops(edges):
    dropped = set()
    for j in sorted({j for _, j in edges}):
        if any(b == j and a not in dropped for a, b in edges):
            dropped.add(j)
    return dropped


@pytest.mark.parametrize("rounds", [0, 1, 50])
def test_keep_first(spark, rounds):
    rnd = random.Random(2)
    docs = {f"d{k}": sorted({tuple(sorted(rnd.sample(range(20), 2))) for _ in range(rnd.randint(1, 60))}) for k in range(8)}
    docs["chain"] = [(k, k + 1) for k in range(30)]
    docs["star"] = [(0, k) for k in range(1, 30)] + [(k, 40) for k in range(1, 30)]
    pairs = spark.createDataFrame([(d, i, j, 0.9) for d, e in docs.items() for i, j in e], "doc_id string, i int, j int, similarity double")
    got = collections.defaultdict(set)
    rows = similarity.keep_first_drops(pairs, rounds).collect()
    for r in rows:
        got[r["doc_id"]].add(r["idx"])
    assert got == {d: plain_drops(e) for d, e in docs.items()} and len(rows) == sum(map(len, got.values()))


def test_a_chain_takes_a_round_for_every_other_link(spark, monkeypatch):
    made = []
    plain = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: (made.append(name), plain(df, name))[1])
    chain = spark.createDataFrame([("c", k, k + 1) for k in range(12)], "doc_id string, i int, j int")
    assert {r["idx"] for r in similarity.keep_first_drops(chain, 40).collect()} == {1, 3, 5, 7, 9, 11}
    assert made.count("undecided") == 6


def plain_selection(chunks, budget, spent, first):
    run, kept = spent, []
    for score, idx, tokens in sorted(chunks, key=lambda c: (-c[0], c[1])):
        if run + tokens <= budget or (first and not kept):
            run += tokens
            kept.append(idx)
    return kept


@pytest.mark.parametrize("first", [True, False])
def test_budgets(spark, first):
    rnd = random.Random(8)
    docs = {f"d{k}": ([(rnd.choice([0.0, 0.5, 0.7, rnd.random()]), i, rnd.randint(0, 30)) for i in range(rnd.randint(1, 60))], rnd.randint(1, 200), 0 if first else rnd.randint(0, 150)) for k in range(40)}
    scored = spark.createDataFrame([(d, i, s, t) for d, (c, _, _) in docs.items() for s, i, t in c], "doc_id string, idx int, score double, tokens int")
    budgets = spark.createDataFrame([(d, b, s) for d, (_, b, s) in docs.items()], "doc_id string, budget int, spent int")
    got = collections.defaultdict(set)
    for r in selection.select_under_budget(scored, budgets, first).collect():
        got[r["doc_id"]].add(r["idx"])
    assert {d: got[d] for d in docs} == {d: set(plain_selection(c, b, s, first)) for d, (c, b, s) in docs.items()}


def test_a_million_chunks_of_one_document(spark):
    rows = spark.range(1_000_000).select(F.lit("big").alias("doc_id"), F.col("id").cast("int").alias("idx"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("score"), (F.col("id") % 13 + 1).cast("int").alias("tokens"))
    budgets = spark.createDataFrame([("big", 3_000_001, 0)], "doc_id string, budget int, spent int")
    kept = selection.select_under_budget(rows, budgets)
    sums = kept.join(rows, ["doc_id", "idx"]).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("idx").cast("long")).alias("at")).first()
    i = np.arange(1_000_000)
    order = np.lexsort((i, -((i * 7919) % 1000)))
    tokens, run, want = (i % 13 + 1)[order].tolist(), 0, []
    for at, t in zip(order.tolist(), tokens, strict=True):
        if run + t <= 3_000_001 or not want:
            run += t
            want.append(at)
    assert (sums["n"], sums["tokens"], sums["at"]) == (len(want), run, sum(want))
