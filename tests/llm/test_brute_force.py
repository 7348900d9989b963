"""Parts of the corpus operators against plain versions: near pairs of a whole given table, the lexicon's matcher, the ordinal likelihood."""

import collections
import os
import re

import numpy as np
import pytest

from condensery.llm import common, minhash_dedup, quality_classifier, token_files, token_rollup, toxicity

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x.keys() & y.keys())


def near_pairs(bags, least=0.8):
    """All pairs of probability Jaccard ``least`` or more. It is at most the mass that two bags share, so two that reach it share
    a shingle among the rarest ones that hold more than 1 - least of each one's mass."""
    df = collections.Counter(s for b in bags.values() for s in b)
    heads = collections.defaultdict(list)
    for i, b in bags.items():
        mass, total = 0, sum(b.values())
        for s in sorted(b, key=lambda s: (df[s], s)):
            if mass > (1 - least) * total + 1e-9:
                break
            heads[s].append(i)
            mass += b[s]
    met = {(i, j) for ids in heads.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    found = set()
    for i, j in met:
        x, y = bags[i], bags[j]
        nx, ny = sum(x.values()), sum(y.values())
        if sum(min(x[s] / nx, y[s] / ny) for s in x.keys() & y.keys()) >= least - 1e-9 and similarity(x, y) >= least:
            found.add((i, j))
    return found


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="the given tables are not there")
def test_near_duplicates_of_a_given_table(spark):
    docs = spark.read.parquet(DOCUMENTS)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    # Equal bags are one class; the others are compared as one each.
    classes = collections.defaultdict(list)
    for i, t in texts.items():
        if b := bag(t):
            classes[frozenset(b.items())].append(i)
    pairs = near_pairs({min(ids): collections.Counter(dict(b)) for b, ids in classes.items()})
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got.keys() == texts.keys() and len(pairs) > 3
    assert all(len({got[i] for i in ids}) == 1 for ids in classes.values())
    assert all(got[i] == got[j] for i, j in pairs)
    # Nothing is put together that chains of near pairs do not hold together.
    root = {i: min(ids) for ids in classes.values() for i in ids}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert all(find(i) == find(g) for i, g in got.items())


def test_fold_by_hand():
    wanted = {"StuPID": "stupid", "5tup1d": "stupid", "ѕtuріd": "stupid", "stúpid": "stupid", "$tup!d!": "tupid", "s$upid": "ssupid", "a-b": "a b", "": ""}
    assert {k: toxicity.fold(k) for k in wanted} == {k: f" {v} " for k, v in wanted.items()}


def test_matcher_against_every_place():
    entries = ((" bad ", 2.0), (" ba", 0.5), (" badly", 1.5), (" mo", 1.0), (" moron ", 3.0))
    phrases = ("bad luck", "moron joke")
    machine = toxicity.automaton(entries, phrases)
    rng = np.random.default_rng(8)
    vocabulary = ["bad", "badly", "luck", "moron", "joke", "mo", "ba", "fine", "abad"]
    for _ in range(200):
        text = f" {' '.join(rng.choice(vocabulary, rng.integers(0, 9)))} "
        free = [(m.start(), m.start() + len(p) + 2) for p in phrases for m in re.finditer(f"(?= {p} )", text)]
        weight = n = 0
        for at in range(len(text)):
            own = max(((len(t), w) for t, w in entries if text.startswith(t, at)), default=None)
            if own and not any(a <= at and at + own[0] <= b for a, b in free):
                weight, n = weight + own[1], n + 1
        assert toxicity.matched(text, machine) == (weight, n), text


def test_ordinal_likelihood_and_gradient(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        kinds = np.sort(rng.choice(12, rng.integers(0, 6), replace=False))
        rows.append((int(rng.integers(0, 3)), kinds.tolist(), [round(float(x), 3) for x in rng.random(len(kinds))]))
    features = spark.createDataFrame(rows, "y int, classes array<int>, shares array<float>")
    w, cuts = rng.normal(size=12), np.array([-0.7, 0.9])

    def likelihood(w, cuts):
        out = 0.0
        for y, kinds, shares in rows:
            z = sum(w[k] * float(np.float32(s)) for k, s in zip(kinds, shares, strict=True))
            above = [1.0, *(1 / (1 + np.exp(c - z)) for c in cuts), 0.0]
            out -= np.log(above[y] - above[y + 1])
        return out

    gw, gc, loss, n = quality_classifier.gradient(features, w, cuts)
    assert n == 40 and loss == pytest.approx(likelihood(w, cuts))
    step = 1e-5
    for k in range(12):
        e = np.eye(12)[k] * step
        assert gw[k] == pytest.approx((likelihood(w + e, cuts) - likelihood(w - e, cuts)) / (2 * step), abs=1e-5)
    for k in range(2):
        e = np.eye(2)[k] * step
        assert gc[k] == pytest.approx((likelihood(w, cuts + e) - likelihood(w, cuts - e)) / (2 * step), abs=1e-5)


def test_token_files_of_null_and_repeated_ids(spark, tmp_path):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    schema = "doc_id long, text string, start long, n_tokens long, block int"
    docs = spark.createDataFrame([(None, "one two", 1, 1, 1), (5, "one two", 1, 1, 1), (5, "one two", 1, 1, 1), (5, None, 1, 1, 1), (2, "long words " * 20_000, 1, 1, 1)], schema)
    token_files.write_tokens(docs, str(tmp_path / "a"), vocabulary)
    got = token_files.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 2, 5, 5, 5]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    short = [r["n_tokens"] for r in got if r["doc_id"] == 5]
    assert sorted(short)[0] == 1 and sorted(short)[1] == sorted(short)[2] == got[0]["n_tokens"]
    token_files.write_tokens(docs.limit(0), str(tmp_path / "b"), vocabulary)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_rollup_changes_of_null_texts(spark):
    docs = spark.createDataFrame([(None, None, None, 1, 2), ("a b", "en", "s", 3, 4), ("a b", "en", "s", 3, 4)], "text string, lang string, source string, batch int, tokens int")
    got = token_rollup.changes(docs, token_rollup.whitespace_tokens(), "v").groupBy("source", "tokenizer").sum("docs", "tokens").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, "v", 1, 0), ("s", "v", 2, 4)], key=str)
    assert token_rollup.changes(docs.limit(0), token_rollup.whitespace_tokens(), "v").count() == 0


def test_words_are_hashed_alike_in_any_slice():
    import pyarrow as pa

    texts = pa.array(["one two three", "", "two", "é one"])
    flat, offsets = common.hashed_words(texts)
    assert offsets.tolist() == [0, 3, 3, 4, 6] and flat[1] == flat[3] and flat[0] == flat[5]
