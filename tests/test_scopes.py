"""Closures by pointers, bins of lines, several repositories and diffs in one table, and rows that their keys do not tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from condensery.operators import diffs, graph
from condensery.plans import compress as C


def closure(spark, kept, edges, **options):
    k = spark.createDataFrame([("f", a) for a in kept], "doc_id string, idx int")
    e = spark.createDataFrame([("f", a, "f", b) for a, b in edges], "doc_id string, idx int, to_doc string, to_idx int")
    rows = graph.dependency_closure(k, e, **options).collect()
    assert len({r["idx"] for r in rows}) == len(rows)
    return {r["idx"]: r["restored"] for r in rows}


def reachable(kept, edges):
    out, todo = dict.fromkeys(kept, False), list(kept)
    while todo:
        a = todo.pop()
        for x, b in edges:
            if x == a and b not in out:
                out[b] = True
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closures_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(30 + 15 * seed)} | {(k, k + 1) for k in range(50, 70)} | {(70, 50), (10, 52), (60, 80), (80, 81)}
    kept = rnd.sample(range(40), 3)
    assert closure(spark, kept, edges, steps=1) == reachable(kept, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    plain = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (made.append(name), plain(df, name))[1])
    edges = [(k, k + 1) for k in range(1000)]
    assert closure(spark, [0], edges) == {k: k > 0 for k in range(1001)}
    assert made.count("frontier") <= 4 + 12 and made.count("pointers") <= 12


def test_no_edges_and_nothing_kept(spark):
    assert closure(spark, [3], []) == {3: False} and closure(spark, [], [(1, 2)]) == {}


def test_blocks_meet_hunks_in_bins(spark):
    rnd = random.Random(6)
    blocks = [(f"p{rnd.randrange(3)}", i, s := rnd.randrange(1, 500), s + rnd.choice([0, 3, 70, 300])) for i in range(60)]
    hunks = [("d", f"p{rnd.randrange(4)}", s := rnd.randrange(0, 600), s + rnd.choice([0, 1, 64, 200])) for _ in range(15)]
    got = diffs.touched_blocks(spark.createDataFrame(blocks, "doc_id string, idx int, start_line int, end_line int"), spark.createDataFrame(hunks, "diff_id string, path string, new_start int, new_end int"))
    want = {i for p, i, a, b in blocks if any(p == q and a <= d and c <= b for _, q, c, d in hunks)}
    assert sorted(r["idx"] for r in got.collect()) == sorted(want) and 5 < len(want) < 60
    assert got.columns == ["doc_id", "idx", "start_line", "end_line"]


USE, HELP = "def use():\n    return helper() + 1\n", "def helper():\n    return 2\n\n\ndef other_thing_entirely():\n    value = 'long unrelated body of text here'\n    return value * 3\n"


def test_references_stay_in_their_repository(spark):
    files = spark.createDataFrame([("one", "a.py", USE), ("one", "b.py", HELP), ("two", "a.py", USE), ("three", "b.py", HELP), (None, "a.py", USE)], "repo string, doc_id string, text string")
    rows = {(r["repo"], r["path"]): r for r in C.compress_repo(files, 0.9).collect()}
    assert len(rows) == 5 and rows["one", "b.py"]["dependency_blocks_restored"] + rows["three", "b.py"]["dependency_blocks_restored"] <= 1
    alone = {r["path"]: r for r in C.compress_repo(files.filter("repo = 'one'").drop("repo"), 0.9).collect()}
    assert {c: rows["one", p][c] for p in alone for c in ("compressed_text", "blocks_total")}.items() and all(rows["one", p]["compressed_text"] == alone[p]["compressed_text"] for p in alone)
    assert {r["repo"]: r["files"] for r in C.totals(C.compress_repo(files, 0.9)).collect()} == {"one": 2, "two": 1, "three": 1, None: 1}


def test_repeated_and_null_paths(spark):
    files = spark.createDataFrame([("a.py", USE), ("a.py", USE), ("a.py", HELP), (None, None), (None, "text")], "doc_id string, text string")
    rows = C.compress_repo(files).collect()
    assert sorted(str(r["path"]) for r in rows) == ["None", "None", "a.py", "a.py", "a.py"]
    assert sum(r["blocks_total"] for r in rows if r["path"]) == 4


def hunks_of(spark, *rows):
    return spark.createDataFrame(list(rows), "diff_id string, path string, new_start int, new_lines int, new_end int")


def test_two_diffs_of_one_path(spark):
    hunks = hunks_of(spark, ("d1", "b.py", 1, 1, 1), ("d2", "b.py", 5, 1, 5), ("d2", "gone.py", 1, 1, 1))
    files = spark.createDataFrame([("b/b.py", "never taken"), ("b.py", HELP), ("other.py", USE)], "doc_id string, text string")
    rows = {(r["diff_id"], r["path"]): r for r in C.compress_diff(hunks, files, 0.5).collect()}
    assert rows.keys() == {("d1", "b.py"), ("d2", "b.py")}
    assert rows["d1", "b.py"]["changed_blocks_kept"] == rows["d2", "b.py"]["changed_blocks_kept"] == 1
    assert "def helper" in rows["d1", "b.py"]["compressed_text"] and "def other_thing" in rows["d2", "b.py"]["compressed_text"]
    assert [tuple(r) for r in diffs.skipped_files(hunks, files).collect()] == [("d2", "gone.py")]


def test_contents_of_each_diff(spark):
    hunks = hunks_of(spark, ("d1", "b.py", 1, 1, 1), ("d2", "b.py", 1, 1, 1))
    files = spark.createDataFrame([("d1", "b.py", HELP), ("d2", "b.py", USE)], "diff_id string, doc_id string, text string")
    rows = {r["diff_id"]: r for r in C.compress_diff(hunks, files, 0.5).collect()}
    assert rows["d1"]["blocks_total"] == 2 and rows["d2"]["blocks_total"] == 1 and "use" in rows["d2"]["compressed_text"]
    assert diffs.skipped_files(hunks, files.filter("diff_id = 'd1'")).first()["diff_id"] == "d2"


TEXT = "The red fox runs far over the hills. The blue sky hangs over the bay. The red fox runs far over the hills."


def test_documents_without_keys_of_their_own(spark):
    rows = [(None, TEXT), (1, TEXT), (1, "Something else is said here. And here as well, at more length."), (1, TEXT), (None, None)]
    got = C.compress(spark.createDataFrame(rows, "doc_id long, text string"), 0.5).collect()
    want = {r["doc_id"]: r for r in C.compress(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), 0.5).collect()}
    flat = lambda i, r: (str(i), r["compressed_text"], r["chunks_total"], r["near_duplicates_removed"], r["original_tokens"])
    assert sorted(flat(r["doc_id"], r) for r in got) == sorted(flat(i, want[k]) for k, (i, _) in enumerate(rows))


def test_turns_without_keys_of_their_own(spark):
    rows = [(1, 0, "user", TEXT), (1, 0, "assistant", "Yes."), (1, 1, "user", TEXT), (None, 0, "user", TEXT), (None, None, "user", "Short."), (1, 2, "user", "Thanks.")]
    out = C.compress_session(spark.createDataFrame(rows, "conv_id long, turn int, role string, content string"), 1).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), r["role"]) for r in out) == sorted((str(c), str(t), r) for c, t, r, _ in rows)
    assert [r["turn"] for r in out if r["action"] == "dropped_duplicate"] == [1]
    assert {r["action"] for r in out if r["conv_id"] is None} == {"compressed", "protected_recent"}
