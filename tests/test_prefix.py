"""Windows over a document's lines in two levels: many small parts give what one part gives."""

import random

import pytest
from pyspark.sql import functions as F

from condensery.operators import chunking, prefix, structural


def lines_of(spark):
    rnd = random.Random(1)
    rows = []
    for doc in ("a", "b", None):
        # Places with gaps, as filters leave them.
        places = sorted(rnd.sample(range(400), 150))
        lines = []
        while len(lines) < 150:
            kind = rnd.random()
            lines += [""] * rnd.randint(1, 3) if kind < 0.3 else [f"2024-01-01 10:00:{k:02} job {k} runs" if x == 0 else f"  detail {k}" for k in range(rnd.randint(1, 6)) for x in range(2)] if kind < 0.7 else [f"INFO {rnd.randint(0, 9)}", "  plain"]
        rows += [(doc, i, t) for i, t in zip(places, lines[:150], strict=True)]
    rows.append(("one", 5, "INFO x"))
    return spark.createDataFrame(rows, "doc_id string, idx int, text string").repartition(5)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("block", [1, 7, 100])
def test_parts_of_any_size(spark, block):
    lines = lines_of(spark)
    for f in (chunking.records, structural.collapse_blank_runs, structural.summarize_repeated_blocks):
        assert rows(f(lines, block=block)) == rows(f(lines)), f.__name__


def test_against_a_plain_loop(spark):
    lines = lines_of(spark)
    got = {(r["doc_id"], r["idx"]): (r["before"], r["total"]) for r in prefix.running(prefix.previous(lines, 9, before=F.when(F.length("text") > 7, F.col("text"))), "total", F.length("text"), 9).collect()}
    at, want = {}, {}
    for doc, idx, text in sorted(lines.collect(), key=lambda r: (str(r[0]), r[1])):
        before, total = at.get(doc, (None, 0))
        want[doc, idx] = before, total + len(text)
        at[doc] = text if len(text) > 7 else None, total + len(text)
    assert got == want and any(b for b, _ in want.values())


def test_one_long_log_is_many_tasks_work(spark):
    """A log of one document over 50 parts: no task's window takes more than a part."""
    n = 50_000
    lines = spark.range(n).select(F.lit("log").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("2024-01-01 INFO "), (F.col("id") % 2).cast("string"))).otherwise("  detail").alias("text"))
    out = chunking.records(lines, block=1000)
    assert out.agg(F.max("record_id")).first()[0] == (n + 2) // 3
    sizes = prefix.parted(lines, 1000).groupBy("doc_id", "_part").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(sizes) == (1000, 50)
    # All records are equal up to numbers: one run, of which the first stays.
    kept = structural.summarize_repeated_blocks(lines, block=1000).collect()
    assert [r["idx"] for r in sorted(kept, key=lambda r: r["idx"])][:3] == [0, 1, 2] and max(r["n_blocks"] for r in kept) >= n // 3 - 2


def test_indented_spans():
    """Worked out by hand: a block ends where the text comes back to its first line's depth or above, after a deeper line; lines of the same depth go on."""
    lines = ["a:", "  b", "", "  c", "d:", "e:", "    f", "  g", "h"]
    assert chunking.indented(lines) == [(1, 4, []), (5, 8, []), (9, 9, [])]
    assert chunking.indented(["  x", "    y", "z", "w"]) == [(1, 2, []), (3, 4, [])]
    assert chunking.indented([]) == [] and chunking.indented(["", "a", " b", "c"]) == [(1, 3, []), (4, 4, [])]


def test_other_files_by_indentation(spark):
    """Files that aren't Python, or only named so, null and empty texts."""
    docs = spark.createDataFrame([("a.yaml", "k:\n  v\nm:\n  w"), ("b.py", "x = 1\ndef f():\n    return 2"), ("c.py", "k:\n  v\nm"), ("d.txt", None), ("e.txt", "")], "doc_id string, text string")
    got = sorted((r["doc_id"], r["idx"], r["text"], r["start_line"], r["strategy"]) for r in chunking.code_blocks(docs, True).collect())
    assert got == [
        ("a.yaml", 0, "k:\n  v", 1, "indentation"), ("a.yaml", 1, "m:\n  w", 3, "indentation"), ("b.py", 0, "x = 1", 1, "ast"),
        ("b.py", 1, "def f():\n    return 2", 2, "ast"), ("c.py", 0, "k:\n  v", 1, "indentation"), ("c.py", 1, "m", 3, "indentation"),
    ]
