"""Columns that follow from a key are computed once for each of its values, and only the form asked for."""

from pyspark.sql import functions as F

from tracelake.functions import lexer as X
from tracelake.functions.text import one_of
from tracelake.operators import reads, shell
from tracelake.plans import adjudicate as plans


def test_keys_are_judged_once_with_nulls_and_copies(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", None), (4, "a", "x"), (5, None, "x")], "id long, cmd string, path string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judge(cmd, path):
        seen.add(1)
        return f"{cmd}/{path}"

    got = shell.judged_once(d, ["cmd", "path"], out=judge("cmd", "path"))
    assert got.columns == ["id", "cmd", "path", "out"]
    assert {r.id: r.out for r in got.collect()} == {1: "a/None", 2: "None/None", 3: "a/None", 4: "a/x", 5: "None/x"}
    assert seen.value == 4
    assert shell.judged_once(d.limit(0), ["cmd"], out=F.upper("cmd")).count() == 0


def test_only_the_form_asked_for_is_computed(spark):
    d = spark.createDataFrame([(0,), (1,), (None,), (7,)], "n int")
    got = [r[0] for r in d.select(one_of(F.col("n"), [F.lit("a"), F.lit("b"), F.raise_error(F.lit("form 2")).cast("string")])).collect()]
    assert got == ["a", "b", None, None]


def test_a_call_is_parsed_once_and_its_twin_made_once(spark):
    rows = [(i, "Read", x) for i, x in enumerate(['{"path":"a.py","offset":0.0,"limit":2}', '{"path":"a.py","offset":2.7,"limit":true}', '{"path":"a.py","offset":{}}', '{"path":[],"file":"b.py","offset":"1_0"}', '{"path":false,"file":-0}'])]
    rows += [(5, "grep", '{"pattern":0.50,"path":true}'), (6, "grep", '{"pattern":0.0,"q":[1],"glob":null,"include":"*"}'), (7, "Edit", '{"file":"x/Y.py","path":""}'), (8, None, '{"b":1,"a":null}')]
    d = spark.createDataFrame(rows, "k long, tool string, input string").withColumns({"id": F.lit(1), "p": F.lit("")})
    out = plans.twins(d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1
    want = ["cat a.py", "sed -n '2,2p' a.py", "cat a.py", "sed -n '10,2009p' b.py", None, "grep '0.5' True", "grep '[1]' *", "edit Y.py", None]
    assert [r.twin for r in out.orderBy("k").collect()] == want


def test_arrays_are_made_once_before_they_are_dealt_out(spark):
    """No filter on the array's size comes before the generator, and an action is judged where it stands, without a shuffle."""
    d = spark.createDataFrame([(1, "sed -i s/x/y/ a/b.py", "sed -n '1,2p' a.py"), (2, "tee é/ß.py < c.rs > /tmp/d.py", "cat éß.py | head -n 3"), (3, None, "ls"), (4, "tee x.py x.py", None)], "id long, action string, cmd string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    edits, seen = reads.action_edits(d.select("id", "action")), reads.shell_reads(d.select("id", "cmd"))
    assert sorted(map(tuple, edits.collect())) == [(1, 0, "a/b.py"), (2, 0, "c.rs"), (2, 1, "é/ß.py"), (4, 0, "x.py")]
    assert sorted((r.id, r.path, r.lo, r.hi) for r in seen.collect()) == [(1, "/Repo/a/a.py", 1, 2), (2, "/Repo/a/éß.py", 1, 3)]
    count = lambda x: plan(x).count("regexp_extract_all")
    assert count(edits) == count(d.select(X.action_edits(F.col("action")).alias("x")))
    assert count(seen) == count(d.select(X.shell_reads(F.col("cmd"), F.lit(reads.CWD)).alias("x")))
    assert "Exchange" not in edits._jdf.queryExecution().executedPlan().toString()


def test_targets_of_calls_are_made_once(spark):
    calls = spark.createDataFrame([(1, 1, "bash", "cat a.py", None, None, None, "/r")], "session long, seq long, tool string, cmd string, path string, lo long, hi long, cwd string")
    count = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    out = reads.call_targets(calls)
    assert [(r.path, r.lo) for r in out.collect()] == [("/r/a.py", 1)]
    assert count(out) == count(calls.select(X.shell_reads(F.col("cmd"), F.col("cwd")).alias("x")))
