import json

import pytest
from pyspark.sql import functions as F

from condensery.functions import text as T
from condensery.functions.dims import preset
from condensery.operators import chunking, diffs, sessions, similarity, structural
from condensery.plans import compress as C


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(df):
    return df.collect()[0]


def rows_of(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")


def test_lines_equal_up_to_numbers_collapse(spark):
    lines = [f"GET /cart {200 + i % 3} in {30 + i} ms" for i in range(12)] + ["worker seven went away", "disk almost full"]
    r = one(C.compress(docs(spark, "\n".join(lines)), 0.2, content_type="logs"))
    assert (r["chunks_total"], r["structural_lines_collapsed"], r["near_duplicates_removed"]) == (3, 11, 11)
    assert "GET /cart 200 in 30 ms  [x12 similar lines collapsed]" in [d["text"] for d in r["diff_lines"]]
    assert r["compressed_tokens"] < r["original_tokens"]


def test_density_by_hand(spark):
    # Three (two) terms of one chunk each: mass is the root of their number, as is the divisor; the third is a filler.
    scored = similarity.density_scores(rows_of(spark, "the of and to", "zebra quartz violin", "import os", "x")).collect()
    assert {r["idx"]: r["score"] for r in scored} == {0: 0.0, 1: 1.0, 2: 0.1, 3: 0.0}
    alone = similarity.density_scores(rows_of(spark, "the of and to", "of it")).collect()
    assert [r["score"] for r in alone] == [1.0, 1.0]


def test_empty_null_and_short(spark):
    rows = {r["doc_id"]: r for r in C.compress(docs(spark, "", None, "One short sentence that is all."), 0.99).collect()}
    assert rows[0]["original_tokens"] == rows[1]["original_tokens"] == 0 and rows[0]["compressed_text"] == ""
    assert rows[2]["compressed_text"].strip()


def test_unknown_preset(spark):
    with pytest.raises(ValueError):
        preset("nope")
    assert preset("conservative")[0] < preset("balanced")[0] < preset("aggressive")[0]


def test_token_counts_round_half_even(spark):
    got = [r[0] for r in spark.createDataFrame([("",), ("   ",), ("ab cd",), ("x" * 10,)], "t string").select(T.token_count(F.col("t"))).collect()]
    assert got == [0, 1, 2, 2]


def test_runs_of_equal_records(spark):
    lines = [x for k in (1, 2, 3) for x in (f"2024-05-01 10:00:0{k} job {k} begins", f"   reads {k * 7} rows")] + ["2024-05-01 11:30:00 done"]
    out = [(r["idx"], r["text"], r["n_blocks"]) for r in structural.summarize_repeated_blocks(rows_of(spark, *lines)).orderBy("idx").collect()]
    assert out == [(0, lines[0], 0), (1, lines[1] + "  [repeated block x3, 2024-05-01 10:00:01 .. 2024-05-01 10:00:03]", 2), (6, lines[6], 0)]
    # Two are too few.
    assert structural.summarize_repeated_blocks(rows_of(spark, *lines[:4])).count() == 4


def test_python_blocks_and_fallback(spark):
    source = "import os\n\n@wrap\ndef f(x):\n    return g(x)\n\nA = 1\n"
    rows = chunking.code_blocks(docs(spark, source, "if (a) {\n  b;\n}\nc;\n")).orderBy("doc_id", "idx").collect()
    assert [(r["start_line"], r["end_line"], r["defines"]) for r in rows if r["doc_id"] == "0"] == [(1, 1, []), (2, 3, []), (4, 5, ["f"]), (7, 7, ["A"])]
    assert {r["strategy"] for r in rows if r["doc_id"] == "1"} == {"indentation"}


def test_closure_across_files(spark):
    files = spark.createDataFrame([("a.py", "def use():\n    return helper() + 1\n"), ("b.py", "def helper():\n    return 2\n\n\ndef other_thing_entirely():\n    value = 'long unrelated body of text here'\n    return value\n")], "doc_id string, text string")
    diff = spark.createDataFrame([("d", "--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n-x\n+y\n--- a/b.py\n+++ b/b.py\n@@ -5,1 +5,2 @@\n+z\n--- a/c.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n")], "diff_id string, text string")
    hunks = diffs.parse_hunks(diff)
    assert {r["path"] for r in hunks.collect()} == {"a.py", "b.py"}
    rows = {r["path"]: r for r in C.compress_diff(hunks, files, 0.9).collect()}
    assert "def helper" in rows["b.py"]["compressed_text"]


def test_keep_first_is_not_components(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.9), (1, 2, 3, 0.9)], "doc_id long, i int, j int, similarity double")
    assert sorted(r["idx"] for r in similarity.keep_first_drops(pairs).collect()) == [1, 3]


def test_adaptive_threshold_by_hand(spark):
    t = lambda *texts: one(similarity.adaptive_thresholds(rows_of(spark, *texts)))["threshold"]
    # Similarities 0, 0 and 1: the place 1.9 of 0 to 2 lies nine tenths of the way from 0 to 1.
    assert t("red fox runs", "red fox runs", "blue sky") == 0.9
    assert t("red fox runs", "red fox runs") == 0.6 and t("a", "b", "c") == 0.6
    assert t(*["same words here"] * 4) == 0.95


def test_similar_pairs_against_brute_force(spark):
    import itertools
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab cd ef gh ij kl mn op qr st".split(), k=rng.randint(2, 7))) for _ in range(40)]
    bags = [Counter(t.split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    weight = [{w: c * (math.log(41 / (1 + df[w])) + 1) for w, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in weight]
    for threshold in (0.6, 0.85):
        want = {(i, j) for i, j in itertools.combinations(range(40), 2) if round(sum(x * weight[j].get(w, 0) for w, x in weight[i].items()) / norm[i] / norm[j], 9) >= threshold}
        assert {(r["i"], r["j"]) for r in similarity.similar_pairs(rows_of(spark, *texts), threshold).collect()} == want


def test_small_functions(spark):
    got = one(spark.sql("SELECT '<a href=\"x\">&\\'</a>' AS h, 'https://github.com/some/thing.git/pull/12' AS u, 'who/what#7' AS s, 'none' AS z").select(
        T.html_escape(F.col("h")), T.pull_request(F.col("u")), T.pull_request(F.col("s")), T.pull_request(F.col("z")), T.short_count(F.lit(999)), T.short_count(F.lit(1500)), T.short_count(F.lit(2_000_000)), T.ratio(F.lit(0), F.lit(0)), T.ratio(F.lit(4), F.lit(1))))
    assert got[0] == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;"
    assert [tuple(got[k]) for k in (1, 2, 3)] == [("some", "thing", 12), ("who", "what", 7), (None, None, None)]
    assert list(got[4:]) == ["999", "1.5K", "2.0M", 0.0, 0.75]


def test_sessions(spark):
    q = "What is the meaning of the quarterly revenue report for the northern region?"
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", q), (1, 2, "assistant", "It is up."), (1, 3, "user", q), (1, 4, "assistant", "As said."), (1, 5, "user", "Thanks.")]
    out = {r["turn"]: r["action"] for r in C.compress_session(spark.createDataFrame(rows, "conv_id long, turn int, role string, content string"), 1).collect()}
    assert out == {0: "protected_system", 1: "compressed", 2: "compressed", 3: "dropped_duplicate", 4: "compressed", 5: "protected_recent"}


def test_export_formats(spark):
    raws = ['[{"role": "user", "content": "hi"}]', '{"chat_messages": [{"sender": "human", "text": "a"}, {"sender": "assistant", "text": "b"}]}',
            '{"current_node": "n", "mapping": {"r": {"parent": null, "children": ["n"], "message": null}, "n": {"parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["yo"]}}}}}', "nonsense"]
    got = {r["conv_id"]: (r["format"], [(t["role"], t["content"]) for t in r["turns"] or []]) for r in sessions.parse_exports(spark.createDataFrame(list(enumerate(raws)), "conv_id long, raw string")).collect()}
    assert got == {0: ("generic", [("user", "hi")]), 1: ("claude", [("user", "a"), ("assistant", "b")]), 2: ("chatgpt", [("user", "yo")]), 3: (None, [])}


def test_exports_of_several_conversations(spark):
    tree = lambda *names: json.dumps({"current_node": names[-1], "mapping": {n: {"parent": p, "children": [], "message": {"author": {"role": "user"}, "content": {"parts": [f"says {n}"]}}} for p, n in zip((None, *names), names)}})  # noqa: E731, B905
    chat = lambda *texts: json.dumps({"chat_messages": [{"sender": "human", "text": t} for t in texts]})
    raws = [f"[{tree('a')}, {tree('b', 'c', 'd')}, {tree('x', 'y', 'z')}]", f" [{chat('one')}, {chat('two', 'three')}]", "[]"]
    got = {r["conv_id"]: (r["format"], [t["content"] for t in r["turns"] or []]) for r in sessions.parse_exports(spark.createDataFrame(list(enumerate(raws)), "conv_id long, raw string")).collect()}
    assert got == {0: ("chatgpt", ["says b", "says c", "says d"]), 1: ("claude", ["two", "three"]), 2: (None, [])}


def test_sessions_by_their_own_threshold(spark):
    asks = ["How tall is the north tower of the old castle?", "Which train goes to the harbour on Sunday?", "Is the swimming pool open during winter?", "Where can I buy bread after nine?"]
    rows = [(1, i, "user", t) for i, t in enumerate([*asks, asks[1], "Thanks."])]
    out = {r["turn"]: r["action"] for r in sessions.turn_actions(spark.createDataFrame(rows, "conv_id long, turn int, role string, content string"), 1, None).collect()}
    assert [k for k, v in out.items() if v == "dropped_duplicate"] == [4]


def test_stream_collapses(spark, tmp_path):
    from condensery.streaming.logs import collapse_stream

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, concat('INFO id=', id) AS text FROM range(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = collapse_stream(stream).writeStream.outputMode("complete").format("memory").queryName("collapsed").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n_similar"] for r in spark.table("collapsed").collect()] == [20]


def test_command_line(spark, tmp_path):
    from condensery import cli

    (tmp_path / "a.txt").write_text("The red fox runs far. The red fox runs far. Blue sky over the bay.")
    read = lambda *args: cli.run(spark, cli.parser().parse_args([str(tmp_path / "a.txt"), *args]))
    # Without a threshold a file takes 0.85; a preset has its own; 1.1 keeps all.
    assert [one(read(*args))["near_duplicates_removed"] for args in ((), ("--preset", "balanced"), ("--dedup-threshold", "1.1"))] == [1, 1, 0]
    result = read("--target", "0.5")
    r = one(result)
    assert cli.summary_line(result) == f"1 texts, {r['original_tokens']} -> {r['compressed_tokens']} tokens ({100 * r['compression_ratio']:.1f}% reduction)"
    assert cli.summary_line(result.limit(0)) == "0 texts, 0 -> 0 tokens (0.0% reduction)"
    assert cli.summary_line(result.select("compressed_text")) is None
    assert cli.parser().parse_args(["x", "--quiet"]).quiet
    with pytest.raises(ValueError):
        cli.run(spark, cli.parser().parse_args([]))


def test_blocks_leave_in_bounded_batches(spark, monkeypatch):
    """Of a batch of files, however many, no more blocks are rows at once than are handed on."""
    import pyarrow as pa

    from condensery.operators import chunking

    docs = spark.createDataFrame([("a.py", "")], "doc_id string, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    cut = chunking.code_blocks(docs)
    source = "".join(f"def f{k}():\n    return {k}\n\n" for k in range(1500))
    batches = list(cut(iter([pa.RecordBatch.from_pydict({"doc_id": ["a.py", "b.py", "c.py", "d.txt"], "text": [source, source, source, None]})])))
    assert [b.num_rows for b in batches] == [4096, 404]
    assert batches[1].column("text")[403].as_py() == "def f1499():\n    return 1499" and batches[1].column("defines")[403].as_py() == ["f1499"]


def test_prose_in_one_pass_equals_the_general_way(spark):
    """Copies, near copies, fillers, trivial and single chunks, empty texts and documents longer than a batch."""
    import random

    rng = random.Random(7)
    words = "red fox hill lamp stone river is the of and to cloud seven iron".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12))).capitalize() + "."
    texts = ["", None, "Ok.", "One two three four five six.", "# first\n# second line\nthird of them\n\nthird of them"]
    for n in (2, 5, 9, 40):
        own = [sentence() for _ in range(n)]
        own += [rng.choice(own) for _ in range(n // 2)] + ["No.", "A.", "Import os now.", "... -."] + [s.replace("fox", "fox fox", 1) for s in own[: n // 3]]
        rng.shuffle(own)
        texts += [" ".join(own)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for threshold in (0.7, 2.0):
            rows = [{r["doc_id"]: r for r in C.compress(docs(spark, *texts), dedup_threshold=threshold, content_type=kind).collect()} for kind in ("prose", "auto")]
            assert rows[0] == rows[1] and len(rows[0]) == len(texts)
            assert (sum(r["near_duplicates_removed"] for r in rows[0].values()) > 0) == (threshold < 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sessions_take_few_jobs_and_only_vectors_that_meet(spark):
    """Prose has no line pass, blocks or closure, and a chunk without a partner no vector."""
    q = "What is the meaning of the quarterly revenue report for the northern region? "
    rows = [(c, t, ("user", "assistant")[t % 2], q + f"Answer {t} of {c} is {'low' if t % 3 else 'high'}.") for c in range(3) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string").coalesce(1)
    context = spark.sparkContext
    context.setJobGroup("session-jobs", "totals")
    try:
        totals = C.session_totals(C.compress_session(turns)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["conv_id"] for r in totals) == [0, 1, 2] and all(r["turns_total"] == 9 for r in totals)
    assert len(context.statusTracker().getJobIdsForGroup("session-jobs")) <= 40
    alone = similarity.compared_chunks(rows_of(spark, "Red fox runs home.", "Blue sky over bays.", "Ten green lamps."), 0.85)
    assert alone.count() == 0
