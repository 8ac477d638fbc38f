"""Calls as commands, transcripts, verdicts, signals and the cache guard, by hand in the shapes that clients send."""

import json

from pyspark.sql import functions as F

from tracelake.functions import calls
from tracelake.operators import adjudicate as A
from tracelake.operators import steps
from tracelake.sources import lines


def call(spark, column, tool, args):
    d = spark.createDataFrame([(tool, json.dumps(args))], "tool string, args string").select("tool", F.parse_json("args").alias("v"))
    return d.select(column(F.col("tool"), F.col("v")).alias("x")).first().x


def test_twins_by_hand(spark):
    cases = [
        ("Bash", {"command": "ls -la"}, "ls -la"), ("bash", {"command": "  "}, None), ("Read", {"file_path": "/a/b.py"}, "cat /a/b.py"), ("Read", {"file_path": "/a/b.py", "offset": 10, "limit": 5}, "sed -n '10,14p' /a/b.py"),
        ("Read", {"file_path": "b", "offset": 10}, "sed -n '10,2009p' b"), ("Read", {"file_path": "b", "offset": 0, "limit": 9}, "cat b"), ("Read", {"file_path": "b", "offset": "x", "limit": 3}, "cat b"), ("Read", {"file_path": "b", "offset": 3, "limit": "no"}, "cat b"),
        ("Read", {"file_path": "b", "offset": 2.9, "limit": "1_0"}, "sed -n '2,11p' b"), ("Read", {"file_path": "b", "offset": True}, "sed -n '1,2000p' b"), ("Read", {"file_path": 7, "path": "b"}, None), ("Read", {"file_path": "", "path": "b"}, "cat b"),
        (" View ", {"filename": "b"}, "cat b"), ("Edit", {"file_path": "a/b/c.py"}, "edit c.py"), ("Grep", {"pattern": "it's", "path": "src"}, "grep 'it s' src"), ("Glob", {"pattern": "*.py"}, "grep '*.py'"), ("rg", {"q": "x" * 300, "include": "y"}, f"grep '{'x' * 200}' y"),
        ("Grep", {}, "grep ''"), ("Task", {"a": 1}, None), ("Grep", {"pattern": True}, "grep 'True'"),
    ]
    assert [(t, a, call(spark, calls.twin_command, t, a)) for t, a, _ in cases] == cases
    assert call(spark, calls.call_command, "Task", {"b": "x" * 200, "a": 1, "c": [1, 2]}) == f"Task a=1 b={'x' * 160}… c=[1,2]"
    assert call(spark, calls.call_command, "run", {"command": " "}) == " " and len(call(spark, calls.call_command, "T", {f"k{i}": "v" * 90 for i in range(9)})) == 400
    assert call(spark, calls.shown_action, "Write", {"file_path": "a.py"}) == "Write a.py" and call(spark, calls.shown_action, "", {}) == "tool" and call(spark, calls.shown_action, "Glob", {"pattern": "x"}) == "Glob x"
    assert call(spark, calls.edited_source, "MultiEdit", {"path": "'Src/A.PY'"}) == "src/a.py" and call(spark, calls.edited_source, "Edit", {"path": "tests/a.py"}) is None and call(spark, calls.edited_source, "Read", {"path": "a.py"}) is None


def line(kind, content, **more):
    return json.dumps({"type": kind, "message": {"role": kind, "content": content}} | more)


ROWS = [
    line("user", "  "), line("user", "go"), "not json", line("assistant", [{"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]),
    line("user", [{"type": "tool_result", "content": [{"text": "x" * 1500}, {"type": "image"}, 5, {"text": "y" * 1500}]}, {"type": "text", "text": "aside"}, {"type": "tool_result", "content": None}, {"type": "tool_result", "content": True}]),
    line("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": ""}, {"type": "text", "text": "a "}, {"type": "text", "text": "b"}]), line("user", [{"type": "text", "text": "side"}], isSidechain=True), json.dumps({"type": "summary"}), line("assistant", []), line("assistant", "plain"),
]


def test_transcripts_keep_calls_and_every_result(spark):
    d = spark.createDataFrame([("c", i, x) for i, x in enumerate(ROWS)], "conv string, line_no long, line string")
    got = [(r.pos, r.part, r.role, r.text, r.commands) for r in lines.transcript(d).orderBy("pos", "part").collect()]
    assert got == [
        (1, 0, "user", "go", []), (3, 0, "assistant", "", ["ls"]), (4, 0, "tool", ("x" * 1500 + "  " + "y" * 1500)[:2000], []), (4, 1, "tool", "", []), (4, 2, "tool", "True", []), (5, 0, "assistant", "hm\na \nb", []), (8, 0, "assistant", "", []),
    ]
    assert [r.pos for r in lines.transcript(d, most=3).orderBy("pos", "part").collect()] == [4, 5, 8]
    full = [(r.pos, r.part, r.role, r.text, r.reasoning, r.commands) for r in lines.full_transcript(d).orderBy("pos", "part").collect()]
    assert full == [
        (0, 0, "user", "  ", "", []), (1, 0, "user", "go", "", []), (3, 0, "assistant", "", "", ["ls"]), (4, 0, "tool", "x" * 1500 + "y" * 1500, "", []), (4, 1, "user", "aside", "", []), (4, 2, "tool", "", "", []), (4, 3, "tool", "True", "", []),
        (5, 0, "assistant", "a b", "hm", []), (8, 0, "assistant", "", "", []), (9, 0, "assistant", "plain", "", []),
    ]
    assert lines.transcript(d.limit(0)).count() == lines.full_transcript(d.limit(0)).count() == 0


def run(spark, *steps):
    """steps: (role, text, action, edited)."""
    rows = [(1, i, *(s + (None,) * (4 - len(s)))) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "conv long, seq long, role string, text string, action string, edited array<string>")


def verdict(spark, *steps):
    r = A.verdicts(run(spark, *steps)).first()
    return r.verdict, r.rung, r.reverted, r.stalled


def test_verdicts(spark):
    loop = [("assistant", "", "make t")] * 6
    diff, head = ("tool", "diff --git a b"), ("tool", "--- a\n+++ b\n@@ -1 @@")
    asked = ("assistant", "", "git diff")
    assert verdict(spark, *loop, asked, diff) == ("SUBMIT", "disk_true", False, True)
    assert verdict(spark, asked, diff) == ("CONTINUE", "disk_true", False, False)
    assert verdict(spark, diff, *loop, asked, ("tool", "")) == ("CONTINUE", "disk_false", True, True)
    assert verdict(spark, *loop, head) == ("SUBMIT", "shown_diff", False, True)
    assert verdict(spark, *loop, ("user", " [SUPERVISOR] diff --git x")) == ("CONTINUE", "none", False, True)
    assert verdict(spark, *loop, ("assistant", "diff --git mine", "make t", ["a.py"])) == ("SUBMIT", "struct_edit", False, True)
    # the diff must come in the three messages after the call; a later call decides
    assert verdict(spark, asked, ("assistant", "", "x"), ("assistant", "", "y"), ("assistant", "", "z"), diff)[1:3] == ("disk_false", True)
    assert verdict(spark, asked, diff, asked, ("tool", "clean"))[1:3] == ("disk_false", True)
    assert verdict(spark, ("user", None), ("assistant", None, None)) == ("CONTINUE", "none", False, False)
    assert A.shown_diffs(run(spark, ("tool", "a " + head[1]))).first().diff == head[1]


def test_signals(spark):
    rows = [(1, k, 100_000, 150_000.0 * k, k, k - 1, k == 3, [0.4, 0.5, 0.9, 0.6][k - 1], 100_000.0) for k in range(1, 5)] + [(2, 1, 900_000, 230_168.0, 49, 0, True, 1.0, None), (3, 1, 5, 0.0, 1, 1, True, None, 0.0)]
    d = spark.createDataFrame(rows, "session long, seq long, billed long, cum_tok double, n_steps long, n_src long, stalled boolean, doom double, median double")
    got = {(r.session, r.seq): tuple(r)[2:] for r in A.signals(d).collect()}
    assert [got[1, k][:3] for k in (1, 2, 3, 4)] == [(100_000, 1.0, False), (200_000, 2.0, False), (300_000, 3.0, False), (400_000, 4.0, True)]
    assert [got[1, k][3:] for k in (1, 3, 4)] == [(False, False, False, False, False), (False, True, False, True, False), (False, True, True, False, False)]
    assert got[2, 1] == (900_000, 0.0, False, True, False, False, False, True) and got[3, 1][1] == 0.0


def test_cache_guard(spark):
    rows = [(1, 0, ["a", "b"], [50, 50]), (1, 1, ["a", "b", "c"], [50, 50, 900]), (1, 2, ["a", "x", "c", "d"], [50, 70, 30, 5]), (1, 3, ["a", "x"], [50, 70]), (2, 0, ["q"], [9999]), (2, 1, ["z"], [99]), (2, 2, ["z"], [99])]
    d = spark.createDataFrame(rows, "session long, seq long, hashes array<string>, tokens array<long>")
    got = [(r.rewritten, r.tripped) for r in A.cache_guard(d, 99).orderBy("session", "seq").collect()]
    assert got == [(0, False), (0, False), (100, True), (0, True), (0, False), (99, False), (0, False)]


def test_steps_pair_assistants_with_what_answers_them(spark):
    rows = [("user", "task", []), ("assistant", "one", ["a"]), ("assistant", "two", ["b", "c"]), ("system", "s", None), ("tool", "r1", None), ("tool", "r2", None), ("user", None, None), ("assistant", None, None), ("user", "u", []), ("assistant", "last", ["z"])]
    d = spark.createDataFrame([(1, i, 0, r, t, "why" if r == "assistant" else None, c) for i, (r, t, c) in enumerate(rows)], "conv long, pos long, part int, role string, text string, reasoning string, commands array<string>")
    assert [tuple(r)[1:] for r in steps.paired(d).orderBy("step").collect()] == [(0, "b ; c", "r1", "two", "why"), (1, "", "u", "", "why")]
    assert [tuple(r)[1:] for r in steps.observed(d).orderBy("step").collect()] == [(0, "", ""), (1, "b ; c", "r1"), (2, "b ; c", "r2"), (3, "b ; c", ""), (4, "", "u")]
    assert steps.paired(d.limit(0)).count() == steps.observed(d.limit(0)).count() == 0
