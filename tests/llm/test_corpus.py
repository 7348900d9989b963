"""The corpus operators against brute force on small tables with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from condensery.llm import common, components, exact_dedup, minhash_dedup, packing, piece_lattice, quality_classifier, quality_rules, suffix_dedup, token_files, token_rollup, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), 7, 9) for i, t in enumerate(texts)], SCHEMA)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"{'abcdefghij'[a]}{'klmnop'[b]}{c}x" for a, b, c in zip(rng.integers(0, 10, n), rng.integers(0, 6, n), rng.integers(0, 50, n), strict=True)]


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(words(i, 120)) for i in range(12)]
    near = [base[0].replace(base[0].split()[50], "changed"), base[1] + " one two", "\n".join([base[2][:300]] * 3)]
    shared = " ".join(words(99, 60))
    return [*base, *near, base[3], base[3], base[4].upper(), shared + " " + base[5], base[6] + " " + shared, "", None, "", "tiny text", "tiny text", "é" * 150 + base[7], "a" * 1000, "ab" * 600 + " end", " ".join(words(7, 3000)), "x  y\n\n z. A,\n"]


def test_exact_groups(spark, texts):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = {(i, max(m), len(m), i == max(m), hashlib.sha256(t.encode()).hexdigest()) for t, m in groups.items() for i in m}
    assert {tuple(r) for r in exact_dedup.exact_groups(table(spark, texts)).collect()} == want
    # Winners and the rest give the same rows as each other.
    assert {tuple(r) for r in exact_dedup.exact_groups(table(spark, texts), heavy_rows=2).collect()} == want
    left = exact_dedup.drop_exact(table(spark, texts).union(table(spark, texts[:2])))
    assert left.columns == table(spark, texts).columns and sorted(r["doc_id"] for r in left.collect()) == sorted(max(m) for m in groups.values())


def bag(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else collections.Counter([tuple(w)] if w else [])


def brute_jp(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x.keys() & y.keys())


def test_near_duplicates(spark, texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if bags[i] and bags[j] and bags[i].keys() & bags[j].keys() and brute_jp(bags[i], bags[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert got[12] == 0 and got[13] == 1
    left = minhash_dedup.drop_near(table(spark, texts))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({find(i) for i in range(len(texts))})


def test_near_duplicates_of_repeated_ids(spark):
    base, other, third = (" ".join(words(500 + i, 120)) for i in range(3))
    near = base.replace(base.split()[50], "changed")
    rows = [(1, base), (5, near), (5, other), (7, third), (5, third), (None, base), (8, other + " one two"), (9, base), (9, "alone"), (9, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7, 9) for i, t in rows], SCHEMA)
    got = collections.Counter(tuple(r)[:3] + (r["kept"],) for r in minhash_dedup.near_duplicates(docs).collect())
    want = [(1, 1, 3, True), (5, 1, 3, False), (5, 5, 2, True), (7, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (8, 5, 2, False), (9, 1, 3, False), (9, 9, 2, True), (9, 9, 2, True)]
    assert got == collections.Counter(want)
    left = minhash_dedup.drop_near(docs)
    assert left.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == collections.Counter(x for x, w in zip(rows, want, strict=True) if w[3])


def test_signatures_estimate_jp():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
    ids = common.mix64(np.arange(300, dtype=np.uint64))
    z = minhash_dedup.signatures(np.repeat([0, 1], 200), np.concatenate([ids[:200], ids[100:]]), np.concatenate([x, y]), 2, 4096)
    a, b = dict(zip(range(200), x.tolist(), strict=True)), dict(zip(range(100, 300), y.tolist(), strict=True))
    want = brute_jp(collections.Counter(a), collections.Counter(b))
    assert abs((z[0] == z[1]).mean() - want) < 0.03
    exact = minhash_dedup.probability_jaccard(np.sort(ids[:200]), x[np.argsort(ids[:200])], np.sort(ids[100:]), y[np.argsort(ids[100:])])
    assert abs(exact - want) < 1e-9


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark, texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    want = {}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.passages(table(spark, texts)).collect()}
    assert got == want
    kept = suffix_dedup.drop_passages(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    assert all(len((r["text"] or "").encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] for r in kept.collect())


def test_passages_over_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    data = (" ".join(words(5, 900)) + " ").encode()
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": [data.decode(), "", data.decode()[:50]]})
    pieces = list(suffix_dedup.segments(batch, 200))
    starts = [int(a[0]) + s for d, _, _, a in pieces if len(d) >= 200 for s in range(len(d) - 199)]
    assert sorted(starts) == list(range(len(data) - 199))


def test_passages_across_segments(spark):
    # Long texts alone, with a copied passage, and one whose passage lies over a cut; the small segment goes to the tasks as an argument.
    shared = " ".join(words(98, 300))
    long = [" ".join(words(300 + i, 1500)) for i in range(6)]
    rows = [*long, long[0][:4000] + shared + long[1][:3000], " ".join(words(320, 400)) + shared, "ab" * 2000, "", None]
    raw = [(t or "").encode() for t in rows]
    seen = collections.Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    for segment in (500, 777, 1000):
        got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.passages(table(spark, rows), segment=segment).collect()}
        for i, b in enumerate(raw):
            gone = np.zeros(len(b), bool)
            for s in range(len(b) - 199):
                if seen[b[s : s + 200]] > 1:
                    gone[s : s + 200] = True
            assert got[i] == int(gone.sum()), (segment, i)
    assert got[2] == 0


def test_quality(spark, texts):
    junk = ["BUY NOW!!! ### $$$ " * 40, "| A | B | " * 60]
    good = [" ".join(words(200 + i, 90)) for i in range(30)]
    docs = table(spark, [*texts, *junk, *good])
    n = len(texts) + 2
    labels = spark.createDataFrame([(n + i, 1, 0) for i in range(30)] + [(len(texts), 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs, labels).collect()}
    for i, t in enumerate([*texts, *junk, *good]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        often = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)
    assert all(got[n + i]["kept"] for i in range(30)) and not got[len(texts)]["kept"]
    assert quality_rules.keep_quality(docs, labels).columns == docs.columns


def test_toxicity(spark):
    plain = str.maketrans("0123456789", "qrstuvwyzk")
    rows = [" ".join(words(i, 40)).translate(plain) + (" you stуp1d moron" if i % 3 == 0 else "") for i in range(150)] + ["", None, "MOR0N!"]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(150))
    assert got[152]["hits"] and got[150]["score"] == got[151]["score"] < 0.5
    a = toxicity.automaton(((" moron ", 3.0),), ("moron joke",))
    assert toxicity.matched(toxicity.fold("a moron joke"), a) == (0, 0) and toxicity.matched(toxicity.fold("a moron"), a)[1] == 1


def test_rollup(spark, tmp_path):
    ledger = token_rollup.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("a", "en", "v", 1, 10, 7), (None, "en", "v", 1, 5, 7)], "source string, lang string, tokenizer string, docs long, tokens long, batch long")
    gone = rows.filter("source = 'a'").selectExpr("source", "lang", "tokenizer", "-docs AS docs", "-tokens AS tokens")
    total = lambda: sorted(map(tuple, ledger.totals().collect()), key=str)
    ledger.commit("1", rows)
    ledger.commit("1", rows)
    ledger.commit("2", gone)
    assert total() == [(None, "en", "v", 1, 5)]
    ledger.commit("2", gone.limit(0))
    assert total() == sorted([("a", "en", "v", 1, 10), (None, "en", "v", 1, 5)], key=str)
    ledger.compact()
    ledger.commit("1", rows)
    ledger.commit("3", gone)
    assert total() == [(None, "en", "v", 1, 5)]
    ledger.compact()
    ledger.commit("3", gone)
    assert total() == [(None, "en", "v", 1, 5)] and ledger.current().select("batch").distinct().count() == 1
    with pytest.raises(ValueError):
        ledger.commit("base-9", rows)
    empty = token_rollup.Ledger(spark, str(tmp_path / "empty"))
    empty.commit("1", rows.limit(0))
    assert empty.totals().count() == 0


def test_ordinal_classifier(spark):
    rows = [" ".join(words(i, 40)) if i % 2 else " ".join(words(i, 40)).upper() + " !!" for i in range(200)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.ordinal_quality(table(spark, rows), labels).collect()}
    held = [i for i in range(200) if got[i]["held_out"]]
    assert sum(got[i]["kept"] == bool(i % 2) for i in held) >= 0.95 * len(held) and len(got) == 202
    assert all(r["p_best"] <= r["p_usable"] for r in got.values())


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    got = collections.defaultdict(list)
    filled = collections.defaultdict(list)
    for r in packing.pack(table(spark, texts), path).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        assert sorted(got[i]) == [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) <= -(-total // 1024) + 2


def test_bin_patterns_match_brute_force():
    def fewest(items, room=10):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[k] <= room and bins[b] not in bins[:b]:
                    bins[b] += items[k]
                    place(k + 1, bins)
                    bins[b] -= items[k]
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(3)
    for _ in range(60):
        items = sorted(rng.integers(1, 11, rng.integers(1, 11)).tolist(), reverse=True)
        patterns = packing.bin_patterns(dict(collections.Counter(items)), 10)
        assert sorted((x for p, n in patterns for x in list(p) * n), reverse=True) == items and all(sum(p) <= 10 for p, _ in patterns)
        assert sum(n for _, n in patterns) == fewest(items)


def test_simple8b_round_trips():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0), np.zeros(1000), rng.integers(0, 50000, 5000), rng.integers(0, 3, 700), np.array([2**60, 5, 2**63, 0, 1] * 70)):
        ids = ids.astype(np.uint64)
        block = token_files.encode_block(ids)
        assert (token_files.decode_block(block) == ids).all()
        if len(ids) > 600:
            assert (token_files.decode_block(block, 2) == ids[512:]).all()


def test_token_files(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    token_files.write_tokens(table(spark, texts).repartition(3), str(tmp_path / "t"), path)
    at = 0
    for i, r in enumerate(sorted(token_files.read_tokens(spark, str(tmp_path / "t"), True).collect(), key=lambda r: r["doc_id"])):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (i, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)


def test_piece_lattice(spark, texts):
    search = piece_lattice.lattice(P.path("piece_bpe_32k.model"))
    word = "▁thing"

    def every(rest):
        if not rest:
            yield 0.0, []
        for k in range(1, len(rest) + 1):
            if rest[:k] in search.scores:
                for s, tail in every(rest[k:]):
                    yield s + search.scores[rest[:k]], [rest[:k], *tail]

    ranked = sorted((s for s, _ in every(word)), reverse=True)[:4]
    assert [s for s, _ in search.n_best(word, 4)] == pytest.approx(ranked)
    best, ids, gap = search.best(word)
    assert best == pytest.approx(ranked[0]) and gap == pytest.approx(ranked[0] - ranked[1])
    assert search.decode(np.frombuffer(ids, "<u4").tolist()) == "thing"
    rows = {r["doc_id"]: r for r in piece_lattice.n_best_texts(table(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    assert all(r["round_trip"] for r in rows.values()) and len(rows) == len(texts)
    whole = search.n_best("▁tiny▁text", 4)
    assert rows[texts.index("tiny text")]["n_best"] == pytest.approx([round(s, 4) for s, _ in whole])


def test_segmentations_match_brute_force(spark):
    path = P.path("piece_bpe_32k.model")
    search = piece_lattice.lattice(path)

    def every(rest):
        if not rest:
            yield 0.0, []
        for k in range(1, len(rest) + 1):
            if rest[:k] in search.scores:
                for s, tail in every(rest[k:]):
                    yield s + search.scores[rest[:k]], [search.ids[rest[:k]], *tail]
            elif k == 1:
                for s, tail in every(rest[k:]):
                    yield s + search.unknown, [*(search.bytes[b] for b in rest[:k].encode()), *tail]

    rows = ["tiny text", "a a a a a", "the thing is it", "so  aa\nbb", "on \U0001f9ff it", "x", "é\U0001f9ff", " to be ", "", None]
    got = {r["doc_id"]: r for r in piece_lattice.segmentations(table(spark, rows), path).collect()}
    judged = {r["doc_id"]: r for r in piece_lattice.n_best_texts(table(spark, rows), path).collect()}
    for i, t in enumerate(rows):
        want = {(): 0.0}
        for w in piece_lattice.split_words(" " + t) if t else []:
            own = list(every(w.replace(" ", piece_lattice.MARK)))
            want = {(*ids, *more): s + x for ids, s in want.items() for x, more in own}
            # Prefixes beyond the four best and their equals can be in none of the four best.
            least = sorted(want.values(), reverse=True)[:4][-1] - 1e-9
            want = {ids: s for ids, s in want.items() if s >= least}
        ids = [tuple(x) for x in got[i]["ids"]]
        assert len(set(ids)) == len(ids) == min(4, len(want))
        assert got[i]["scores"] == pytest.approx(sorted(want.values(), reverse=True)[:4])
        assert [want[x] for x in ids] == pytest.approx(got[i]["scores"])
        r = judged[i]
        assert r["n_best_crc32"] == [zlib.crc32(np.array(x, "<u4")) for x in ids] and r["ids_crc32"] == r["n_best_crc32"][0] and r["n_pieces"] == len(ids[0]) and r["round_trip"]
    flat = piece_lattice.segmentations(table(spark, rows), path).selectExpr("doc_id", "text AS was", "explode(ids) AS ids")
    back = piece_lattice.decoded(flat, path).collect()
    assert len(back) == sum(len(r["ids"]) for r in got.values()) and all(r["text"] == (r["was"] or "") for r in back)
    odd = spark.createDataFrame([(1, [search.bytes[0xC3]]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in piece_lattice.decoded(odd, path).orderBy("doc_id").collect()] == ["\ufffd", None, ""]


def test_null_ids_and_empty_tables(spark, texts):
    docs = table(spark, ["same text here " * 30, "same text here " * 30]).union(spark.createDataFrame([(None, "same text here " * 30, None, None, None, None, None)] * 2, SCHEMA))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = docs.limit(0)
    for f in (exact_dedup.exact_groups, minhash_dedup.near_duplicates, suffix_dedup.passages, lambda d: quality_rules.quality_verdicts(d, labels), lambda d: toxicity.toxicity(d, labels), lambda d: quality_classifier.ordinal_quality(d, labels, steps=1), lambda d: packing.pack(d, P.path("byte_bpe_50k.json")), lambda d: piece_lattice.n_best_texts(d, P.path("piece_bpe_32k.model"))):
        assert f(empty).count() == 0
        assert f(docs).count() == 4
    assert exact_dedup.drop_exact(docs).filter("doc_id IS NOT NULL").count() == 1


def test_lattice_cuts_no_strings_to_look_up():
    """A word's edges come character by character: a string cut and hashed for every place and length was most of the search's time."""

    class Whole(str):
        def __getitem__(self, k):
            assert isinstance(k, int), "a string was cut"
            return str.__getitem__(self, k)

    search = piece_lattice.lattice(P.path("piece_bpe_32k.model"))
    for word in ("▁information", "▁x", "▁日本語͸", "▁▁tionthe"):
        edges, best, _ = search.forward(Whole(word))
        every = [(i, j, search.scores.get(word[i:j])) for i in range(len(word)) for j in range(i + 1, len(word) + 1)]
        assert sorted(edges) == sorted((i, j, search.unknown if s is None else s) for i, j, s in every if s is not None or j == i + 1)
        assert best[-1] == max(score for score, _ in search.n_best(word, 1))
