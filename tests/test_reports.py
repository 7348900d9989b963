"""Notes, summaries, reports, rankings and price tables, each with results worked out by hand."""

from pyspark.sql import functions as F

from condensery.functions import text as T
from condensery.functions.dims import COMMON_BUDGETS, model_table
from condensery.operators import diffs, leaderboard as board, reports, structural
from condensery.plans import compress as C
from condensery.plans.queries import report_of


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def lines_of(spark, *rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id long, idx int, text string")


def test_notes_of_each_kind_of_text(spark):
    logs = "\n".join(["2025-02-03 start", "", "", ""] + [f"INFO job {k} done" for k in range(5)])
    code = "def one():\n    return 1\n\n\ndef two():\n    return one()\n\n\ndef three():\n    return 3\n"
    docs = texts(spark, logs, "", None, "   ")
    notes = {r["doc_id"]: r["notes"] for r in C.compress(docs, content_type="logs").collect()}
    assert notes[0][:2] == ["detected content type: logs", "structural pass: removed 2 blank-line runs, collapsed 4 repeated lines/blocks"]
    assert notes[0][2].startswith("semantic dedup: removed ") and notes[1] == notes[2] == []
    whole = C.compress(texts(spark, code), content_type="code").first()["notes"]
    assert "chunking: 3 logical code blocks (block-aware)" in whole
    plain = C.compress(texts(spark, code), content_type="code", use_code_blocks=False).first()["notes"]
    assert any(n.endswith("(block-aware chunking unavailable)") for n in plain)
    prose = C.compress(texts(spark, "Short."), dedup_threshold=None).first()["notes"]
    assert prose == [
        "detected content type: prose", "structural pass: skipped (prose content)", "semantic dedup: removed 0 near-duplicate chunks (adaptive threshold)",
        "guardrail: compression would have increased size, returned original text",
    ]


def test_collapse_notes_put_blocks_first_and_stop_at_ten(spark):
    blocks = [x for k in range(3) for x in (f"2025-02-03 10:00:0{k} job {k}", f"  read {k}")]
    pairs = [x for k in "abcdefghijkl" for x in (f"INFO {k} 1", f"INFO {k} 2")]
    notes = structural.collapse_notes(lines_of(spark, *pairs, *blocks), True).first()["notes"]
    assert notes[0] == "3x block starting: 2025-02-03 10:00:00 job 0" and notes[1] == "2x: INFO a 1" and len(notes) == 10
    assert structural.collapse_notes(lines_of(spark, "INFO a", "INFO b")).count() == 0
    # 64 characters, of which 60 are shown.
    long = "INFO " + "x" * 59
    assert structural.collapse_notes(lines_of(spark, long, long)).first()["notes"] == ["2x: " + long[:60]]


def test_reports_of_empty_texts_and_signs(spark):
    done = C.compress(texts(spark, "", "Is 1 < 2 & 'so'?"))
    pages = {r["doc_id"]: r["report"] for r in report_of(done, reports.html).collect()}
    assert '<ul class="notes"></ul>\n<h2>Diff</h2>\n<div class="diff"></div>' in pages[0] and "0 -&gt; 0 tokens (0.0% reduction)" in pages[0]
    assert '<span class="kept">Is 1 &lt; 2 &amp; &#x27;so&#x27;?</span>' in pages[1] and pages[1].endswith("</html>\n")
    plain = {r["doc_id"]: r["report"] for r in report_of(done, reports.markdown).collect()}
    assert plain[0].startswith("# Document 0\n\n**0 -> 0 tokens") and plain[1].endswith("```diff\n+ Is 1 < 2 & 'so'?\n```\n")


def test_summaries(spark):
    totals = spark.createDataFrame([(3, 80, 79, 2, 0.0125)], "files long, original_tokens long, compressed_tokens long, restored long, compression_ratio double")
    # 1.25 is a tie, which goes to the even digit.
    assert reports.repo_summary(totals).first()["summary"] == "3 files, 80 -> 79 tokens (1.2% reduction), 2 cross-file symbol(s) restored"
    assert reports.diff_summary(totals).first()["summary"] == "3 changed file(s), 80 -> 79 tokens (1.2% reduction)"
    assert reports.repo_notes(totals, "/src").first()["notes"] == ["scanned 3 files under /src", "cross-file dependency closure restored 2 block(s)"]
    hunks = diffs.parse_hunks(spark.createDataFrame([(1, "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+a\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n+a\n")], "diff_id long, text string"))
    skipped = spark.createDataFrame([("y.py",)], "path string")
    assert reports.diff_notes(totals, hunks, skipped).first()["notes"] == ["parsed diff: 2 changed file(s)", "cross-file dependency closure restored 2 block(s)", "skipped 1 file(s) with unavailable content: y.py"]
    assert reports.diff_notes(totals.withColumn("restored", F.lit(None).cast("long")), hunks, skipped.limit(0)).first()["notes"] == ["parsed diff: 2 changed file(s)"]
    turns = spark.createDataFrame([(1, "claude", a) for a in ("protected_system", "dropped_duplicate", "compressed", "compressed", "protected_recent")], "conv_id long, format string, action string")
    assert reports.session_notes(turns).first()["notes"] == ["parsed 5 turn(s) as 'claude' format", "protected 1 system turn(s) + 1 recent turn(s) verbatim", "dropped 1 duplicate older turn(s)", "compressed 2 older turn(s)"]
    sums = spark.createDataFrame([(1, 5, 4, 1, 100, 25, 0.75)], "conv_id long, turns_total long, turns_kept long, turns_dropped_duplicate long, original_tokens long, compressed_tokens long, compression_ratio double")
    assert reports.session_summary(sums).first()["summary"] == "100 -> 25 tokens (75.0% reduction), 4/5 turns kept, 1 duplicate turn(s) dropped"


def test_percentages_round_the_exact_value(spark):
    # 98.65 and 97.55 are no doubles: the nearest ones lie above and below, and decide.
    pairs = spark.createDataFrame([(2000, 27), (2000, 49), (80, 79), (2000, 2000), (1, 0)], "o long, f long")
    got = [r[0] for r in pairs.select(reports.reduction(F.col("o"), F.col("f"), T.ratio(F.col("o"), F.col("f")))).collect()]
    shares = ["98.7", "97.5", "1.3", "0.0", "100.0"]
    shares[2] = f"{(1 - 79 / 80) * 100:.1f}"
    assert got == [f"{o} -> {f} tokens ({s}% reduction)" for (o, f), s in zip([(2000, 27), (2000, 49), (80, 79), (2000, 2000), (1, 0)], shares, strict=True)]


def test_leaderboard(spark):
    rows = [
        (1, "a", "x", 100, 40, 0.5, None), (2, "a", "y", 300, 60, None, None), (3, "a", "z", 50, 50, 1.0, "too long"),
        (1, "b", "x", 0, 0, None, "no key"), (2, "b", "y", 10, 1, 0.25, ""), (1, "c", "x", 0, 0, None, None), (1, "d", "x", 10, 2, None, None),
    ]
    results = spark.createDataFrame(rows, "seq int, adapter string, dataset string, original_tokens long, compressed_tokens long, retention double, skipped_reason string")
    got = [tuple(r) for r in board.ranked(board.leaderboard(results)).collect()]
    assert got == [("d", None, 1, 0.8, None), ("a", None, 2, 0.75, 0.5), ("c", None, 1, None, None), ("b", "no key", 1, 0.9, 0.25)]
    assert board.datasets(results).first()[0] == 3
    assert board.leaderboard(results.limit(0)).count() == 0 and board.datasets(results.limit(0)).first()[0] == 0


def test_judgement(spark):
    replies = [
        ('{"agrees": true, "reason": "same"}', True, "same"), ('{"agrees": false}', False, ""), ('{"reason": "none"}', False, "none"), ('{"agrees": "false"}', True, ""), ('{"agrees": ""}', False, ""),
        ('{"agrees": 0}', False, ""), ('{"agrees": 2.5}', True, ""), ('{"agrees": []}', False, ""), ('{"agrees": {"a": 1}}', True, ""), ('{"agrees": null}', False, ""),
    ]
    loose = [("It is True.", True), ("I would say that this is true", False), ("[true]", True), ("", False), (None, False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(replies + loose)], "i int, raw string").select("i", T.judgement(F.col("raw")).alias("j")).select("i", "j.*").orderBy("i").collect()
    assert [(r["agrees"], r["reason"]) for r in df[: len(replies)]] == [r[1:] for r in replies]
    assert [r["agrees"] for r in df[len(replies) :]] == [r[1] for r in loose] and all(r["reason"].endswith("keyword match") for r in df[len(replies) :])


def test_prices_windows_and_estimates(spark):
    models = {r["model"]: r for r in model_table(spark).select("model", "window", T.cost(F.lit(2_000_000), F.col("price")).alias("cost"), T.budget_percent(F.lit(4_096), F.col("window")).alias("percent")).collect()}
    assert len(models) == 6 and models["gpt-4"]["percent"] == 50 and models["gpt-4"]["cost"] == 60.0 and models["gpt-4o"]["cost"] == 5.0
    row = spark.range(1).select(
        T.budget_percent(F.lit(5), F.lit(200)).alias("tie"), T.budget_percent(F.lit(10**6), F.lit(COMMON_BUDGETS["8K"])).alias("most"), T.estimated_tokens(F.lit(5), 0.5).alias("half"), T.estimated_tokens(F.lit(5), 2.0).alias("none"),
    ).first()
    assert tuple(row) == (3, 999, 3, 0)
