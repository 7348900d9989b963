"""SimHash fingerprints and their components against brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from condensery.llm import simhash_dedup

SCHEMA = "doc_id long, text string, print long, root long, n long"


def plain_print(text, words=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, bits=4):
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= bits:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {p: top(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = " ".join(f"w{k}" for k in rng.integers(0, 500, 400))
    near = [base.replace(base.split()[k], f"new{k}", 1) for k in range(60)]
    return ["", None, " \n\t", "One", "one", "two words", "Ünë Über", "ünë über", "a b c d", "A B\nC  D", "a b c d e", base, *near, base.upper(), "x " * 3000, "same same", " ".join(f"{k}" for k in range(70_000)), "nb sp   wide"]


def test_fingerprints(texts):
    want = [plain_print(t) for t in texts]
    assert simhash_dedup.simhashes(pa.array([t or "" for t in texts])).tolist() == want
    assert simhash_dedup.simhashes(pa.array([], pa.string())).tolist() == []
    assert want[0] == want[2] == 0 and want[8] == want[9]


def test_simhash_components(spark, texts):
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[11], (None, texts[12], 1, 2, 3), (None, "nobody else says this here", 1, 2, 3)]
    prints = {r[1]: plain_print(r[1]) for r in rows}
    roots = plain_roots(set(prints.values()))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[roots[prints[t]]] = min(i, least.get(roots[prints[t]], i))
    want = sorted((str(i), f"{prints[t]:016x}", str(least.get(roots[prints[t]]))) for i, t, *_ in rows)
    for leaves in (simhash_dedup.LEAVES, 4):
        got = simhash_dedup.simhash_components(spark.createDataFrame(rows, SCHEMA), leaves=leaves)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(a), b, str(c)) for a, b, c in got.collect()) == want
    assert simhash_dedup.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def clustered(seed, centres, each, flips):
    """Random prints, and dense clusters of others around some of them."""
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 1 << 63, centres).tolist():
        c = c * 2 + 1
        out.add(c)
        for _ in range(each):
            x = c
            for b in rng.choice(64, rng.integers(1, flips + 1), replace=False).tolist():
                x ^= 1 << b
            out.add(x)
    return sorted(out | {int(x) for x in rng.integers(0, 1 << 63, 300)} | {0, (1 << 64) - 1})


@pytest.mark.parametrize(("seed", "centres", "each", "flips", "leaves"), [(1, 40, 5, 9, 1024), (2, 3, 150, 7, 6), (3, 2, 250, 12, 16)])
def test_print_components(spark, seed, centres, each, flips, leaves):
    """Every link of four bits or fewer counts, also where nodes are opened again and again."""
    prints = clustered(seed, centres, each, flips)
    want = plain_roots(prints)
    got = {r["print"]: r["root"] for r in simhash_dedup.print_components(spark.createDataFrame([(signed(p),) for p in prints], "print long"), leaves=leaves).collect()}
    assert got.keys() == {signed(p) for p in prints}
    classes, expected = {}, {}
    for p in prints:
        classes.setdefault(got[signed(p)], set()).add(p)
        expected.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_tries_cover_every_pair():
    """Any two prints with four differing bits share the top of some trie: two of six blocks are free of them."""
    blocks = simhash_dedup.blocks_of(4)
    assert sum(w for _, w in blocks) == 64 and len(blocks) == 6 and min(w for _, w in blocks) >= 10
    for hit in itertools.combinations(range(6), 4):
        assert any(not set(pair) & set(hit) for pair in itertools.combinations(range(6), 2))


def test_joined_finds_all_pairs():
    """One node pair of two nodes, traversed from its level with bits spent already, and one of a node with itself."""
    rng = np.random.default_rng(9)
    low = np.unique(np.concatenate([rng.integers(0, 1 << 20, 60), (1 << 19) ^ (1 << rng.integers(0, 20, 40))])).astype(np.uint64)
    two = np.unique(low[::2] ^ np.uint64(5)) | np.uint64(1 << 40)
    turned = np.concatenate([low, two, low])
    bounds, sides = np.array([0, len(low) + len(two), len(turned)]), np.array([len(low), len(low) + len(two)])
    i, j = simhash_dedup.joined(turned, np.arange(len(turned)), bounds, sides, np.array([30, 20]), np.array([1, 0]), 4)
    got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    n, m = len(low), len(low) + len(two)
    want = {(a, b) for a in range(n) for b in range(n, m) if (int(turned[a]) ^ int(turned[b])).bit_count() <= 4}
    want |= {(a, b) for a in range(m, len(turned)) for b in range(a + 1, len(turned)) if (int(turned[a]) ^ int(turned[b])).bit_count() <= 4}
    assert got == want and len(want) > 50
