"""The command line from files to files, the mirrored sink, contents from git, and contents of exports."""

import json
import os
import subprocess

import pytest
from pyspark.sql.types import Row

from condensery import cli
from condensery.operators import sessions
from condensery.sources import files as S
from condensery.sources.mirror import MirrorWriter, safe, write_mirror

LONG = "def main():\n    return helper() + helper()\n\n\ndef unused_one():\n    text = 'a long body that nobody asks for in any place'\n    return text * 3\n"
HELP = "def helper():\n    return 1\n\n\ndef unused_two():\n    text = 'another long body that nobody asks for in any place'\n    return text * 3\n"


def called(capsys, *args):
    capsys.readouterr()
    code = cli.main([str(a) for a in args])
    out = capsys.readouterr()
    return code, out.out, out.err


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "code"
    (root / "sub/deep").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, text in (("main.py", LONG), ("sub/deep/help.py", HELP), ("node_modules/x.py", HELP), ("notes.txt", "no code")):
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", "main.py", "sub")
    git("commit", "-qm", "one")
    (root / "main.py").write_text(LONG.replace("helper() + helper()", "helper() + 2"))
    return root


def test_every_text_is_printed(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / f"in/{k:02}.txt").write_text(f"Text number {k} is short.")
    code, out, err = called(capsys, tmp_path / "in", "--target", "0.1")
    assert code == 0 and out.splitlines() == [f"Text number {k} is short." for k in range(30)] and err.startswith("30 texts, ")
    assert called(capsys, tmp_path / "in", "--quiet")[2] == ""


def test_files_take_the_fixed_threshold(spark, tmp_path):
    # Similarities 0, 0 and 1 would make 0.9 the text's own threshold; nothing here lies between 0.85 and that, so look at the notes.
    (tmp_path / "a.txt").write_text("The red fox runs far. The red fox runs far. Blue sky over the bay.")
    notes = lambda *a: cli.run(spark, cli.parser().parse_args([str(tmp_path / "a.txt"), *a])).first()["notes"]
    assert "semantic dedup: removed 1 near-duplicate chunks" in notes() and not any("adaptive" in n for n in notes())


def test_folder_round_trip(spark, folder, tmp_path, capsys):
    code, out, err = called(capsys, "--repo", folder, "--out", tmp_path / "out", "--target", "0.5")
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert code == 0 and found == {"main.py", "sub/deep/help.py"}
    assert "def main" in (tmp_path / "out/main.py").read_text() and "def helper" in (tmp_path / "out/sub/deep/help.py").read_text()
    assert err.startswith("2 files, ") and f"  scanned 2 files under {folder}" in err
    _, out, _ = called(capsys, "--repo", folder, "--target", "0.5")
    banners = [x for x in out.splitlines() if x.startswith("----- ")]
    assert len(banners) == 2 and banners[0].endswith(" tokens) -----") and "main.py (" in banners[0]
    _, _, err = called(capsys, "--repo", folder, "--max-files", "1")
    assert "  left out 1 file(s) beyond the first 1" in err and err.startswith("1 files, ")


def test_diff(spark, folder, tmp_path, capsys):
    code, out, err = called(capsys, "--repo", folder, "--diff", "HEAD")
    assert code == 0 and "changed block(s) kept" in out and "helper() + 2" in out and "helper() + helper()" not in out
    assert err.startswith("1 changed file(s), ") and "  parsed diff: 1 changed file(s)" in err
    changed = subprocess.run(["git", "diff"], cwd=folder, capture_output=True, text=True).stdout
    (tmp_path / "x.diff").write_text(changed + "--- a/gone.py\n+++ b/gone.py\n@@ -1 +1 @@\n-a\n+b\n")
    _, out, err = called(capsys, "--diff-file", tmp_path / "x.diff", "--repo", folder)
    assert "helper() + 2" in out and "skipped 1 file(s) with unavailable content: gone.py" in err


def test_contents_from_git(spark, folder):
    paths = spark.createDataFrame([("main.py",), ("sub/deep/help.py",), ("sub",), ("not/there.py",), ("notes.txt",), ("a\nb",), (None,)], "path string")
    at = lambda ref: {r["doc_id"]: r["text"] for r in S.files_at(paths, str(folder), ref).collect()}
    assert at("HEAD") == {"main.py": LONG, "sub/deep/help.py": HELP}
    assert at(None)["main.py"] != LONG and at(None)["notes.txt"] == "no code"


def test_sessions(spark, tmp_path, capsys):
    turns = [{"role": "system", "content": "Be brief."}, *({"role": ("user", "assistant")[k % 2], "content": f"Turn {k} says something of its own, {k * 7}."} for k in range(8))]
    (tmp_path / "chat.json").write_text(json.dumps(turns))
    code, out, err = called(capsys, "--session", tmp_path / "chat.json", "--protect-recent", "2")
    assert code == 0 and [m["role"] for m in json.loads(out)][:2] == ["system", "user"]
    assert "9/9 turns kept" in err and "  parsed 9 turn(s) as 'generic' format" in err
    (tmp_path / "bad.json").write_text('{"what": 1}')
    with pytest.raises(Exception, match="unrecognised conversation format"):
        called(capsys, "--session", tmp_path / "bad.json")
    assert called(capsys)[0] == 1


def test_mirror(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "one"), ("c.txt", None), ("/abs/d.txt", "é\n")], "path string, text string")
    write_mirror(rows, str(tmp_path / "m"))
    assert (tmp_path / "m/a/b.txt").read_text() == "one" and (tmp_path / "m/c.txt").read_text() == "" and (tmp_path / "m/abs/d.txt").read_text() == "é\n"
    assert sorted(os.listdir(tmp_path / "m")) == ["a", "abs", "c.txt"]
    for bad in ([("../up.txt", "x")], [("x", "1"), ("x", "2")], [(None, "x")]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            write_mirror(spark.createDataFrame(bad, "path string, text string"), str(tmp_path / "n"))
    assert not (tmp_path / "up.txt").exists() and not [x for x in (os.listdir(tmp_path / "n") if (tmp_path / "n").exists() else []) if x != "x"]


def test_attempts_of_the_mirror(tmp_path):
    """A repeated attempt counts once, an aborted write leaves nothing."""
    writer = MirrorWriter(str(tmp_path / "m"))
    first, again = writer.write(iter([Row(path="a.txt", text="lost attempt")])), writer.write(iter([Row(path="a.txt", text="kept")]))
    assert not (tmp_path / "m/a.txt").exists() and first.folder != again.folder
    writer.commit([again])
    assert os.listdir(tmp_path / "m") == ["a.txt"] and (tmp_path / "m/a.txt").read_text() == "kept"
    failed = MirrorWriter(str(tmp_path / "m"))
    failed.write(iter([Row(path="b.txt", text="x")]))
    failed.abort([None])
    assert os.listdir(tmp_path / "m") == ["a.txt"]
    with pytest.raises(ValueError):
        safe("../x")


def test_shapes_of_contents(spark):
    """Strings stay as they are, whatever they look like."""
    contents = ['{"text": "quoted"}', '["a"]', ["a", {"type": "text", "text": "b"}], {"text": "t"}, {"other": 1}, [{"type": "tool_use", "name": "n"}, {"type": "image"}, "", {"text": 5}], None, 7]
    want = ['{"text": "quoted"}', '["a"]', "a\nb", "t", '{"other":1}', "[tool_use: n]\n5", "", "7"]
    raws = [json.dumps([{"role": "user", "content": c} for c in contents] + [{"role": "user"}]), json.dumps({"chat_messages": [{"sender": "human", "content": c} for c in contents]})]
    tree = {"mapping": {"n": {"parent": None, "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["x", {"text": "y"}, {"image": 1}]}}}}}
    raws.append(json.dumps(tree))
    got = {r["conv_id"]: [t["content"] for t in r["turns"]] for r in sessions.parse_exports(spark.createDataFrame(list(enumerate(raws)), "conv_id long, raw string")).collect()}
    assert got[0] == [*want, ""] and got[1] == [w for w in want if w] and got[2] == ["x\ny"]
