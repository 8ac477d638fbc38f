"""Shell commands as reads and edits, elision and the gate: by hand, against a lexer that walks characters, and streams against tables."""

import json
import random
import re

from pyspark.sql import functions as F

from tracelake.functions import lexer as X
from tracelake.operators import commands, reads
from tracelake.streaming import gates, keyed

BIG = 1_000_000_000


def cut(text, is_end):
    """Parts of `text` between separators outside quotes; is_end(text, i) gives a separator's length or 0."""
    parts, quote, i = [""], None, 0
    while i < len(text):
        c = text[i]
        n = 0 if quote else is_end(text, i)
        if n:
            parts.append("")
            i += n
            continue
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        parts[-1] += c
        i += 1
    return parts


def stage_range(stage):
    def num(p, k=1):
        m = re.search(p, stage)
        return int(m[k]) if m and int(m[k]) < 2**63 else None

    if re.search(X.SED_LINES, stage):
        r = (num(X.SED_LINES), num(X.SED_LINES, 2), None)
    elif re.search(X.HEAD, stage):
        r = (1, num(X.HEAD), None)
    elif re.search(X.TAIL, stage):
        n = num(X.TAIL)
        return (1, BIG, n) if n is not None else None
    elif re.search(X.AWK, stage):
        r = (num(X.AWK_ONE),) * 2 + (None,) if re.search(X.AWK_ONE, stage) else (num(X.AWK_FROM), num(X.AWK_TO), None)
    else:
        return (1, BIG, None) if re.search(X.READERS, stage) else None
    return r if None not in r[:2] else None


def full(path, cwd):
    path = path.strip().strip("'\"").replace("\\", "/")
    joined = path if path.startswith("/") or re.match("[A-Za-z]:/", path) else cwd.replace("\\", "/").rstrip("/") + "/" + path
    out = []
    for s in joined.split("/"):
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    return "/" + "/".join(out)


def stage_files(stage, cwd):
    written = re.findall(X.REDIRECT, stage)
    named = [t for t in re.findall(X.PATH, stage) if t not in written and t.lower().endswith(tuple("." + e for e in X.READABLE))]
    return [p for p in (full(t, cwd) for t in named) if not re.search(X.SCRATCH, p.lower())]


def walked(cmd, cwd):
    out = {}
    for st in cut(cmd, lambda t, i: 1 if t[i] in ";\n" else 2 if t[i : i + 2] == "&&" else 0):
        if re.search(X.SEARCH_PIPE, st):
            continue
        parts = cut(st.split("<<")[0], lambda t, i: t[i] == "|")
        for i, s in enumerate(parts):
            r = stage_range(s)
            files = stage_files(s, cwd) if r else []
            if files and r[0] == 1 and r[1] >= BIG and r[2] is None:
                for later in parts[i + 1 :]:
                    n = stage_range(later)
                    if n and not stage_files(later, cwd) and not (n[0] == 1 and n[1] >= BIG and n[2] is None):
                        r = n
            out |= dict.fromkeys(files, r)
    return sorted((p, *r) for p, r in out.items())


def command_samples():
    words = ["cat ", "head -n 5 ", "tail -30 ", "sed -n '3,9p' ", 'sed -n "4 , 8 p" ', "awk 'NR==7' ", "awk 'NR>=2 && NR<=9' ", "nl ", "grep foo ", "python -m pytest ", "a.py ", "src/b.TS ", "../x/./c.md ", "/tmp/d.py ", "'q;r.py' "]
    words += ['"s | t.py" ', "C:\\w\\e.py ", "> out.md ", ">> log.txt ", "| ", "|", "; ", "&& ", "&", "\n", "'", '"', "<<EOF\n", "| grep x ", "head ", "tail -n ", "99999999999999999999 ", "é.py ", "a.py.bak ", "ünder/f.rs "]
    rng = random.Random(7)
    return ["", *("".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(1500))]


def test_reads_against_a_walk_over_characters(spark):
    cmds = command_samples()
    d = spark.createDataFrame([*enumerate(cmds), (-1, None)], "i long, cmd string").repartition(8)
    got = {r.i: [tuple(x) for x in r.r] for r in d.select("i", X.shell_reads(F.col("cmd"), F.lit("/repo/w")).alias("r")).collect()}
    assert got.pop(-1) == [] and got == {i: walked(c, "/repo/w") for i, c in enumerate(cmds)}
    assert sum(map(bool, got.values())) > 200


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reads_by_hand(spark):
    r = lambda c: [tuple(x) for x in one(spark, X.shell_reads(F.lit(c), F.lit("/repo")))]
    assert r("cat src/app.py") == [("/repo/src/app.py", 1, BIG, None)]
    assert r("cat src/app.py | grep foo") == r("cargo test 2>&1 | tail -50") == r('grep -n "def test_" src/foo.py | head -20') == []
    assert r("cat notes.md > out.md") == [("/repo/notes.md", 1, BIG, None)]
    assert r("cat src/app.py 2>&1 | tail -30") == [("/repo/src/app.py", 1, BIG, 30)]
    assert r("cat a.py; head -5 a.py") == [("/repo/a.py", 1, 5, None)]
    e = lambda c: one(spark, X.shell_edits(F.lit(c)))
    assert e("sed -i 's/x/y/' /repo/A.py") == ["a.py"] and e("echo x > tests/b.py") == [] and e("echo x > src/b.py >> /tmp/c.py") == ["b.py"] and e(None) == []
    assert one(spark, X.mutates_all(F.lit("git checkout -- ."))) and not one(spark, X.mutates_all(F.lit("git status"))) and one(spark, X.mutates_all(F.lit(None).cast("string"))) is False
    p = lambda a, b: one(spark, X.absolute(F.lit(a), F.lit(b)))
    assert p("C:\\repo\\src\\app.py", "C:\\other") == "/C:/repo/src/app.py" and p("..\\lib\\util.py", "C:\\repo\\src") == "/C:/repo/lib/util.py" and p("../../../x", "/a") == "/x"
    t = lambda a, o, n: one(spark, X.tool_range(F.lit(a).cast("string"), F.lit(o).cast("long"), F.lit(n).cast("long"), F.lit("/r")))
    assert tuple(t("a.py", 5, 10)) == ("/r/a.py", 5, 14, None) and tuple(t("a.py", 5, None))[1:3] == (5, BIG) and tuple(t("a.py", None, 7))[1:3] == (1, 7) and t("/tmp/a.py", None, None) is None and t(None, 1, 2) is None


def test_long_commands_do_not_overflow(spark):
    long = "cat " + "x" * 200_000 + "/a.py '" + "y|;" * 50_000
    assert one(spark, F.size(X.shell_reads(F.lit(long), F.lit("/r")))) == 1
    assert one(spark, X.scraped_command(F.lit(None).cast("array<string>"), F.lit('f(cmd: "' + "a\\n" * 50_000 + '")'))) == "a\n" * 50_000


def test_range_tokens(spark):
    ends = [40 * k for k in range(1, 201)]
    t = lambda lo, hi, tail=None, e=ends: one(spark, reads.range_tokens(F.lit(e) if e is not None else F.lit(None).cast("array<int>"), F.lit(lo), F.lit(hi), F.lit(tail).cast("long")))
    assert (t(1, BIG), t(1, 10), t(191, 300), t(300, 400), t(9, 3), t(1, BIG, 20), t(1, BIG, 900), t(-5, 2), t(1, 5, None, None)) == (2000, 100, 100, 0, 0, 200, 2000, 20, 0)


def test_elision_sweep_equals_the_definition(spark):
    rng = random.Random(3)
    span = lambda k: (a := rng.randrange(40), a + rng.randrange(-1, k))
    asks = [(k, i, *span(15)) for k in range(40) for i in range(20)]
    rows = [(k, rng.choice(["dropped", "served"]), *span(rng.choice([4, 25]))) for k in range(40) for _ in range(rng.randrange(8))]
    got = reads.elided_ranges(spark.createDataFrame(asks, "key long, id long, lo long, hi long"), spark.createDataFrame(rows, "key long, kind string, lo long, hi long"))

    def gone(k, lo, hi):
        for q, kind, a, b in rows:
            x, y = max(lo, a), min(hi, b)
            if q == k and kind == "dropped" and x <= y and not any(q2 == k and kind2 == "served" and a2 <= x and b2 >= y for q2, kind2, a2, b2 in rows):
                return True
        return False

    want = {(k, i): gone(k, lo, hi) for k, i, lo, hi in asks}
    assert {(r.key, r.id): r.elided for r in got.collect()} == want and 50 < sum(want.values()) < 750
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


CALLS = "session long, seq long, tool string, cmd string, path string, lo long, hi long, cwd string"


def decisions(spark, calls, files=(), curated=(), overrides=()):
    """calls: (tool, cmd or path, lo, hi)."""
    rows = [(1, i, t, x if t == "bash" else None, None if t == "bash" else x, lo, hi, "/repo") for i, (t, x, lo, hi) in enumerate(c + (None,) * (4 - len(c)) for c in calls)]
    spans = "array<struct<lo:bigint,hi:bigint>>"
    d = reads.gate_rows(
        spark.createDataFrame(rows, CALLS), spark.createDataFrame([(1, p, s, i, [41 * k for k in range(1, 31)]) for p, s, i in files], "session long, path string, seq long, identity long, ends array<long>"),
        spark.createDataFrame([(1, *c) for c in curated], f"session long, base string, seq long, dropped {spans}, served {spans}"), spark.createDataFrame([(1, *o) for o in overrides], "session long, seq long, cmd string"),
    )
    return keyed.over_table(d, "session", "seq", gates.gate_step, gates.GATE).orderBy("seq").collect()


def allowed(*a, **k):
    return [r.allowed for r in decisions(*a, **k)]


A, B = "/repo/a.py", "/repo/b.py"
FILES = [(A, 0, 1), (B, 0, 1)]


def test_gate_grant_is_per_file_and_refunds(spark):
    rows = decisions(spark, [("read", A), ("read", A), ("bash", "cat a.py"), ("read", A), ("read", A, 1, 3)], FILES)
    assert [r.allowed for r in rows] == [True, False, True, False, True]
    assert [(r.tokens_saved, r.blocked_rereads) for r in rows] == [(0, 0), (307, 1), (0, 0), (307, 1), (0, 0)]
    assert rows[1].path == A and rows[1].reason == "read before"
    assert allowed(spark, [("read", A, 1, 10), ("read", A, 11, 30), ("read", A, 1, 3), ("read", "/repo/none.py"), ("read", "/repo/none.py")], FILES) == [True] * 5


def test_compound_command_passes_whole_on_reissue(spark):
    rows = decisions(spark, [("read", A), ("read", B), ("bash", "cat a.py; cat b.py"), ("bash", "cat a.py; cat b.py"), ("read", B)], FILES)
    assert [r.allowed for r in rows] == [True, True, False, True, False] and [r.tokens_saved for r in rows] == [0, 0, 307, 0, 307]


def test_gate_loops_and_edits(spark):
    make = ("bash", "make  t")
    assert allowed(spark, [make] * 8) == [True, True, True, False, True, False, True, False]
    # an edit resets the count, not whose turn it is
    assert allowed(spark, [make] * 4 + [("bash", "sed -i 's/x/y/' src/app.py")] + [make] * 6) == [True, True, True, False, True, True, True, True, True, False, True]
    assert allowed(spark, [("read", A), ("edit", "a.py"), ("read", A), ("bash", "git stash"), ("read", A), ("read", A)], FILES) == [True] * 5 + [False]
    assert allowed(spark, [("read", A), ("read", A)], [(A, 0, 1), (A, 1, 2)]) == [True, True]
    assert allowed(spark, [("bash", "cat a.py | sed -i s/x/y/ a.py"), ("read", A), ("read", A)], FILES) == [True, True, False]


def test_override_repeats_are_exempt(spark):
    calls = [("bash", "cargo  test -p x")] * 3 + [("bash", "cargo test  -p x")] * 3
    assert allowed(spark, calls) == [True, True, True, False, True, False]
    assert allowed(spark, calls, overrides=[(3, "cargo test -p x")]) == [True] * 6


def test_elided_lines_are_no_reread(spark):
    cut_, back = [(1, 30)], [(1, 30)]
    assert allowed(spark, [("read", A)] * 3, FILES, curated=[("a.py", 1, cut_, [])]) == [True] * 3
    assert allowed(spark, [("read", A)] * 3, FILES, curated=[("a.py", 1, cut_, []), ("a.py", 2, cut_, back)]) == [True, True, False]


def session(n):
    rng = random.Random(5)
    cmds = ["cat a.py; cat b.py", "cat a.py | head -20", "make t", "make u", "sed -i s/x/y/ a.py", "git reset", "cat b.py | grep x", "tail -n 25 b.py > o.txt"]
    return [rng.choice([("bash", rng.choice(cmds)), ("read", rng.choice([A, B]), *rng.choice([(None, None), (1, 20), (15, 30)])), ("edit", "b.py")] if rng.random() < 0.9 else [("bash", "make t")]) for _ in range(n)]


def test_gate_stream_equals_table(spark, tmp_path):
    rows = [(s, i, t, x if t == "bash" else None, None if t == "bash" else x, lo, hi, "/repo") for s in range(3) for i, (t, x, lo, hi) in enumerate(c + (None,) * (4 - len(c)) for c in session(80 + s))]
    files = spark.createDataFrame([(s, p, k, k, [41 * k for k in range(1, 31)]) for s in range(3) for p in (A, B) for k in (0, 50)], "session long, path string, seq long, identity long, ends array<long>")
    spans = "array<struct<lo:bigint,hi:bigint>>"
    curated = spark.createDataFrame([(0, "b.py", 30, [(1, 9)], [])], f"session long, base string, seq long, dropped {spans}, served {spans}")
    d = reads.gate_rows(spark.createDataFrame(rows, CALLS), files, curated, spark.createDataFrame([(1, 40, "make u")], "session long, seq long, cmd string")).persist()
    want = sorted(map(tuple, keyed.over_table(d, "session", "seq", gates.gate_step, gates.GATE).collect()), key=lambda r: r[:2])
    assert len(want) == len(rows) and any(not r[3] for r in want) and any(r[4] == "loop" for r in want)
    for k in range(3):
        d.filter(f"seq >= {k * 30} AND seq < {[30, 60, 999][k]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.over_stream(stream, "session", "seq", gates.gate_step, gates.GATE).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("gate").collect()), key=lambda r: r[:2]) == want
    assert json.loads(d.first().targets) is not None


def test_breaker_equals_the_gate(spark):
    """The closed form of the loop breaker and the step function decide alike."""
    rng = random.Random(9)
    rows = [(s, i, rng.choice(["make t", "make u", "e"]) if rng.random() < 0.8 else "make t") for s in range(5) for i in range(1, 60)]
    d = spark.createDataFrame([(s, i, c, c == "e") for s, i, c in rows], "session long, seq long, cmd string, edit boolean")
    got = {(r.session, r.seq): r.blocked for r in commands.loop_breaker(d).collect()}
    states = {}
    for s, i, c in rows:
        row = {"session": s, "seq": i, "tool": "bash", "norm": c, "targets": "[]", "edits": '["x.py"]' if c == "e" else "[]", "mutates": False, "override": False}
        assert gates.gate_step(states.setdefault(s, {}), row)[3] != got[s, i]
    assert any(got.values())


def test_action_edits_skip_scratch_scripts(spark):
    e = lambda a: one(spark, X.action_edits(F.lit(a).cast("string")))
    script = "cat > /tmp/fix.py <<'EOF'\nopen('src/a.py', 'w')\nEOF\n"
    assert e(script) == [] and e(script + "tee lib/b.py") == ["lib/b.py"] and e(script.replace("/tmp", "src")) == ["src/a.py", "src/fix.py"]
    assert e("cat > /tmp/x <<-END\nsed -i src/a.py\n  END and tee src/b.py") == ["src/b.py"] and e("cat > /tmp/x <<END\nsed -i src/a.py\nENDING") == []
    assert e("cat > /TMP/x <<eof\nsed -i src/a.py\nEOF") == [] and e("sed -i x B.py A.py a.py tests/c.py > /tmp/d.py > tmp/e.py") == ["a.py", "b.py"]
    assert e(None) == [] and e("") == [] and e("cat src/a.py > o.txt") == []
