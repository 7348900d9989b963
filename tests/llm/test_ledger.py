"""The ledger while it is compacted, again and again."""

import os

from condensery.llm import token_rollup

ROWS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def test_a_commit_during_compaction_counts_once(spark, tmp_path):
    ledger = token_rollup.Ledger(spark, str(tmp_path / "ledger"))
    rows = lambda *tokens: spark.createDataFrame([("s", None, "t", 1, n, "clash") for n in tokens], ROWS)
    tokens = lambda: [(r["docs"], r["tokens"]) for r in ledger.totals().collect()]
    ledger.commit("a", rows(10))
    ledger.commit("b/c=d e", rows(100))
    ids = ledger.pending()
    # Another batch comes between the listing and the sum.
    ledger.commit("late", rows(1000))
    ledger.fold(ids)
    assert tokens() == [(3, 1110)]
    ledger.commit("a", rows(7))
    assert tokens() == [(3, 1110)]
    ledger.commit("late", rows(2000))
    assert tokens() == [(3, 2110)]
    ledger.compact()
    assert ledger.pending() == ["base-000000000002"] and tokens() == [(3, 2110)]
    ledger.vacuum()
    assert [x for x in os.listdir(tmp_path / "ledger") if x.startswith("batch=")] == ["batch=base-000000000002"]
    ledger.commit("b/c=d e", rows(5))
    ledger.commit("late", rows())
    assert tokens() == [(3, 2110)]
    ledger.commit("new", rows(1))
    assert tokens() == [(4, 2111)] and ledger.pending() == ["base-000000000002", "new"]
