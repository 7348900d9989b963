"""The pipeline's stages and op3's ratio against brute force, on a table with nulls, empties, repeats and clashing columns."""

import collections
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from test_corpus import bag, brute_jp, words

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from condensery.llm import quality_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long, kept boolean"
BUCKETS = quality_rules.BUCKETS


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 7, 9, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    base = [" ".join(words(700 + i, 130)) for i in range(14)]
    shared = " ".join(words(799, 70))
    texts = [*base, base[0], base[0], base[1].replace(base[1].split()[60], "changed"), shared + " " + base[2], base[3] + " " + shared, "### $$$ BUY!!! " * 40, "short text", "", None, "a b c " * 60, base[4] + " " + " ".join(words(5, 2000))]
    return [*enumerate(texts), (3, base[3]), (None, " ".join(words(600, 90)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    d = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(14)] + [(19, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def grams(text):
    """The classes of a text's n-grams, by the public definition of chained XXH64."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    forms = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]+", "0", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", re.sub("[a-zß-öø-ÿ]{4,}", "a", text or ""))))

    def place(kind, *parts):
        h = xxhash.xxh64_intdigest(struct.pack("<i", kind), 42)
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return h % BUCKETS

    return [place(1, x.lower()) for x in w] + [place(2, f) for f in forms] + [place(3, f, g) for f, g in zip(forms, ["^", *forms], strict=False)]


def brute_llr(rows, good):
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    weight = {c: math.log((target[c] * raw.total() / n + quality_rules.PRIOR) / (target.total() + quality_rules.PRIOR)) for c, n in raw.items()}
    return [sum(weight[c] for c in g) / len(g) if (g := grams(t)) else 0.0 for _, t in rows]


def verdicts(rows, good):
    out = []
    for (_, t), llr in zip(rows, brute_llr(rows, good), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        often = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        out.append(len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and llr >= quality_rules.THRESHOLD)
    return out


def test_ratio_by_brute_force(spark, rows, folder):
    got = quality_rules.quality_verdicts(frame(spark, rows), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    want = collections.Counter((i, round(x, 6), k) for (i, _), x, k in zip(rows, brute_llr(rows, set(range(14))), verdicts(rows, set(range(14))), strict=True))
    assert collections.Counter((r["doc_id"], round(r["llr"], 6), r["kept"]) for r in got) == want


def near_kept(rows):
    """One row of each class; rows of a null id stay."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and bags[a] and bags[b] and (bags[a] == bags[b] or bags[a].keys() & bags[b].keys() and brute_jp(bags[a], bags[b]) >= 0.8):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, t) for k, (i, t) in enumerate(rows) if i is None or i == least[find(k)]]


def cut(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    out = []
    for (i, t), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else t))
    return out


def pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, to in enumerate(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)):
            out.append((i, k, at, to - at, zlib.crc32(ids[at:to])))
            at = to
    return out


def test_stages_by_brute_force(spark, rows, folder):
    pairs = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "minhash_dedup", "suffix_dedup", "packing"]
    want = [x for x, k in zip(rows, verdicts(rows, set(range(14))), strict=True) if k]
    docs = stages["quality_rules"](spark, frame(spark, rows), folder)
    assert pairs(docs) == collections.Counter(want) and docs.columns == frame(spark, rows).columns
    keep = {}
    for i, t in want:
        keep[t or ""] = max((i is not None, i or 0), keep.get(t or "", (False, 0)))
    want = list(dict.fromkeys((i, t) for i, t in want if keep[t or ""] == (i is not None, i or 0)))
    docs = stages["exact_dedup"](spark, frame(spark, [x for x, k in zip(rows, verdicts(rows, set(range(14))), strict=True) if k]), folder)
    assert pairs(docs) == collections.Counter(want) and docs.columns == frame(spark, rows).columns
    docs, want = stages["minhash_dedup"](spark, frame(spark, want), folder), near_kept(want)
    assert pairs(docs) == collections.Counter(want) and docs.columns == frame(spark, rows).columns
    docs, want = stages["suffix_dedup"](spark, frame(spark, want), folder), cut(want)
    assert pairs(docs) == collections.Counter(want) and docs.columns == frame(spark, rows).columns
    packed = stages["packing"](spark, frame(spark, want), folder).collect()
    assert collections.Counter(tuple(r)[:5] for r in packed) == collections.Counter(pieces(want))
    places = collections.defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        assert [o for o, _ in sorted(held)] == [0, *np.cumsum([n for _, n in sorted(held)])[:-1]] and sum(n for _, n in held) <= 1024
    # All of it, as run() does it.
    assert collections.Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()) == collections.Counter(pieces(want))


def test_empty_table(spark, folder):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_complete_packing_is_least():
    from condensery.llm import packing

    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(1, 21, 8).tolist()
        least = next(n for n in range(1, 9) if any(all(sum(s for s, b in zip(sizes, put, strict=True) if b == k) <= 20 for k in range(n)) for put in itertools.product(range(n), repeat=8))) if sum(sizes) <= 60 else None
        found = packing.bin_patterns(dict(collections.Counter(sizes)), 20, None)
        better = packing.improved(packing.bin_patterns(dict(collections.Counter(sizes)), 20), 20)
        for patterns in (found, better):
            assert collections.Counter(s for p, n in patterns for s in p * n) == collections.Counter(sizes) and all(sum(p) <= 20 for p, _ in patterns)
        assert least is None or sum(n for _, n in found) == least
        assert sum(n for _, n in better) >= sum(n for _, n in found)
