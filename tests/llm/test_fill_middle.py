"""The fill-in-middle transformation against string slicing, and its inverse."""

import hashlib

import numpy as np
import pytest

from condensery.llm import fill_middle

SCHEMA = "doc_id long, text string, h1 string, output string, form string"


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows_of():
    rng = np.random.default_rng(5)
    letters = list("ab <>PSM\n") + ["é", "漢", "😀", "́"]
    texts = ["", None, "a", "é", "😀" * 7, "has <P> inside", "<S>", "<M", "<P", "S>", "a<", "P>", "x" * 50_000, "漢字" * 30_000] + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(600)]
    rows = [(i, t, "h", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[20], (None, "no id at all", "h", "o", "f"), (-7, "negative id", "h", "o", "f")]


@pytest.mark.parametrize("block", [fill_middle.BLOCK, 7])
def test_arranged_and_rebuilt(monkeypatch, block):
    """The scatter and the gather in whole and in tiny blocks."""
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rows = [r for r in rows_of() if block > 7 or len(r[1] or "") < 100]
    want = [plain_version(r[0], r[1]) for r in rows]
    held, at = fill_middle.bytes_of(pa.array([r[1] or "" for r in rows]))
    before = fill_middle.code_points(held, at)
    assert np.diff(before).tolist() == [w[1] for w in want]
    low = np.array([w[3] or 0 for w in want])
    high = low + np.array([w[4] or 0 for w in want])
    cuts = np.minimum(fill_middle.places(held, (before[:-1, None] + np.stack([low, high], 1)).reshape(-1)).reshape(-1, 2), at[1:, None])
    forms = np.array([["plain", "psm", "spm"].index(w[2]) for w in want])
    out, to = fill_middle.arranged(held, at, cuts[:, 0], cuts[:, 1], forms)
    assert [bytes(out[a:b]).decode() for a, b in zip(to[:-1], to[1:])] == [w[5] for w in want]
    back, places = fill_middle.rebuilt(out, to, forms)
    assert back.tobytes() == held.tobytes() and places.tolist() == at.tolist()


def test_rebuilt_refuses_what_is_no_output():
    import pyarrow as pa

    with pytest.raises(ValueError, match="sentinel"):
        fill_middle.rebuilt(*fill_middle.bytes_of(pa.array(["<P>a<S>b", "c"])), np.array([1, 0]))


def test_fill_in_middle(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [plain_version(r[0], r[1]) for r in rows]
    got = fill_middle.fill_in_middle(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fill_middle.restored(got.withColumn("text", got.n))
    assert back.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "text"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.digests(docs).collect()}
    assert digests == {(w[0], sha(w[5]), sha(r[1] or "")) for w, r in zip(want, rows, strict=True)}


def test_empty_table_and_other_parameters(spark):
    assert fill_middle.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(i, "some words to cut", "", "", "") for i in range(50)], SCHEMA)
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, plain=100).collect()} == {"plain"}
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, plain=0, suffix_first=100).collect()} == {"spm"}
    assert fill_middle.fill_in_middle(docs, seed=2).collect() != fill_middle.fill_in_middle(docs, seed=1).collect()
