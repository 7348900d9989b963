"""The leaderboard as one JSON file."""

import json

from condensery.operators import leaderboard as board

RESULTS = "seq int, adapter string, dataset string, original_tokens long, compressed_tokens long, retention double, skipped_reason string"


def test_leaderboard_file(spark, tmp_path):
    rows = [(1, "a", "x.txt", 100, 40, 0.5, None), (2, 'b"', "x.txt", None, None, None, "not there"), (3, "a", "y.txt", 100, 20, None, ""), (4, "c", "y.txt", 0, 0, 1.0, None)]
    results = spark.createDataFrame(rows, RESULTS)
    board.write_document(results, str(tmp_path / "board.json"), 0.5, True)
    got = json.loads((tmp_path / "board.json").read_text())
    assert (got["target_compression"], got["quality_eval_ran"]) == (0.5, True)
    assert [(r["adapter_key"], r["dataset"], r["original_tokens"], r["compression_ratio"], r["retention"]) for r in got["per_dataset"]] == [("a", "x.txt", 100, 0.6, 0.5), ('b"', "x.txt", 0, 0.0, None), ("a", "y.txt", 100, 0.8, None), ("c", "y.txt", 0, 0.0, 1.0)]
    assert list(got["leaderboard"]) == ["a", "c", 'b"'] and got["leaderboard"]["a"] == {"skipped_reason": None, "datasets_evaluated": 2, "overall_compression_ratio": 0.7, "avg_retention": 0.5}
    assert got["leaderboard"]['b"']["skipped_reason"] == "not there" and got["per_dataset"][1]["adapter_name"] is None
    assert json.loads("\n".join(board.document(results.limit(0), 0.7, False))) == {"target_compression": 0.7, "quality_eval_ran": False, "per_dataset": [], "leaderboard": {}}
