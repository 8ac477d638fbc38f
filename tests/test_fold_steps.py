"""The full fold: against the closed form for own thresholds, a replay by hand, streams and failed steps."""

import json
import random

from pyspark.sql import functions as F

from tracelake.operators import shell
from tracelake.streaming import fold, keyed

CHUNK = "conv long, gi long, step long, owner long, kind string, text string, tokens long, score long, tau long, cmd string, direct boolean, own struct<file:string,lo:bigint,hi:bigint>, reads array<struct<file:string,lo:bigint,hi:bigint>>, held boolean"


def chunk(gi, step, score, tau=500, cmd="", direct=True, tokens=20, kind="read", text=None, span=None, owner=None, conv=1, held=False):
    return (conv, gi, step, step if owner is None else owner, kind, text or f"t{gi}", tokens, score, tau, cmd, direct, span, [span] if span else [], held)


def run(spark, rows, **how):
    d = fold.births(spark.createDataFrame(rows, CHUNK))
    return keyed.over_table(d, "conv", "step", fold.fold_step(**how), fold.FOLD)


def cut_of(df):
    return sorted(r.gi for r in fold.decisions(df).collect() if r.cut)


def test_valve_serves_an_identical_call_once(spark):
    rows = [chunk(k, k, 100, cmd=c) for k, c in enumerate(["x", "x", "x", "y", "x"])]
    d = run(spark, rows).collect()
    assert [(r.cut, r.insisted) for r in sorted(d, key=lambda r: r.step)] == [([0], []), ([], [1]), ([2], []), ([3], []), ([], [4])]
    assert json.loads(next(r.registry for r in d if r.registry))["cmds"] == ["y"]
    # an observation that only inherits the call is judged as any other, and does not end the elision
    inherited = [chunk(0, 0, 100, cmd="x"), chunk(1, 1, 100, cmd="x", direct=False), chunk(2, 2, 900, cmd="x", direct=False), chunk(3, 3, 100, cmd="x")]
    assert cut_of(run(spark, inherited)) == [0, 1]
    # what survives takes its call out again
    assert cut_of(run(spark, [chunk(0, 0, 100, cmd="x"), chunk(1, 1, 900, cmd="x"), chunk(2, 2, 100, cmd="x")])) == [0, 2]


def test_runs_keys_and_held_chunks(spark):
    rows = [chunk(0, 0, 100, tokens=4), chunk(1, 0, 100, tokens=6), chunk(2, 0, 900), chunk(3, 0, 100, tokens=9), chunk(4, 0, 100, tokens=9, owner=7), chunk(5, 0, 100, held=True), chunk(6, 0, 900, text="t0")]
    assert cut_of(run(spark, rows)) == [0, 1, 6]  # equal texts of one owner fall together
    r = json.loads(run(spark, [chunk(0, 0, 100, span=("f", 1, 9)), chunk(1, 1, 900, span=("f", 5, 7))]).filter("registry IS NOT NULL").first().registry)
    assert r["dropped_ranges"] == {"f": [[1, 9]]} and r["served_ranges"] == {"f": [[5, 7]]}


def test_thresholds_by_kind_keep_what_was_fought_for(spark):
    rows = [chunk(0, 0, 100, span=("f", 1, 9)), chunk(1, 1, 100, span=("f", 5, 12)), chunk(2, 2, 100, span=("f", 10, 20)), chunk(3, 3, 100, span=("f", 30, 40)), chunk(4, 3, 100, kind="asst", owner=9), chunk(5, 4, 100, span=("f", 5, 5))]
    # 1 meets cut lines and is kept; 2 meets 1, which is kept, so it is cut; the latest copy of 5 is kept
    assert cut_of(run(spark, rows, taus={"read": 500})) == [0, 2, 3, 5]


def random_chunks(n):
    rng = random.Random(4)
    rows = []
    for conv in range(4):
        gi = 0
        for step in range(n):
            for _ in range(rng.randrange(1, 4)):
                rows.append(chunk(gi, step, rng.randrange(1000), 500, rng.choice(["x", "y", "z", ""]), tokens=rng.choice([5, 30]), conv=conv, text=f"t{rng.randrange(40)}-{gi}"))
                gi += 1
            cmd = rows[-1][9]
            rows = [r[:9] + (cmd,) + r[10:] if r[0] == conv and r[2] == step else r for r in rows]
    return rows


def test_closed_form_gives_the_same(spark):
    rows = random_chunks(25)
    got = {(r.conv, r.gi): (r.cut, r.insisted) for r in fold.decisions(run(spark, rows)).collect()}
    calls = spark.createDataFrame(rows, CHUNK).select("conv", "gi", "step", "owner", F.expr("nullif(cmd, '')").alias("cmd"), "tokens", F.col("score").alias("score_q"))
    assert {(r.conv, r.gi): (r.cut, r.insisted) for r in shell.fold(calls, 500).collect()} == got
    assert any(i for _, i in got.values())


def test_stream_equals_table_also_where_the_scorer_fails(spark, tmp_path):
    d = fold.births(spark.createDataFrame(random_chunks(24), CHUNK), F.col("step") % 5 == 2).persist()
    want = sorted(map(tuple, keyed.over_table(d, "conv", "step", fold.fold_step(), fold.FOLD).collect()), key=lambda r: r[:2])
    assert all(not r[2] for r in want if r[1] % 5 == 2) and max(r[6] for r in want) == 5
    for k in range(3):
        d.filter(f"step >= {k * 8} AND step < {k * 8 + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.over_stream(stream, "conv", "step", fold.fold_step(), fold.FOLD).writeStream.format("memory").queryName("fold").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("fold").collect()), key=lambda r: r[:2]) == want
    # a failed step leaves no trace: without failures the decisions are the same
    whole = fold.births(spark.createDataFrame(random_chunks(24), CHUNK))
    same = {(r.conv, r.gi): r.cut for r in fold.decisions(keyed.over_table(whole, "conv", "step", fold.fold_step(), fold.FOLD)).collect()}
    late = {(r.conv, r.gi): r.cut for r in fold.decisions(spark.createDataFrame(want, fold.FOLD)).collect()}
    assert late.items() <= same.items() and len(late) > 0.8 * len(same)


def test_live_sets(spark):
    rows = [chunk(0, 0, 100, cmd="x"), chunk(1, 1, 900, cmd="y"), chunk(2, 2, 100, cmd="x"), chunk(3, 3, 100, cmd="z")]
    d = spark.createDataFrame(rows, CHUNK)
    got = fold.live_sets(d.select("conv", "gi", "step"), fold.decisions(run(spark, rows))).orderBy("step").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 1, 0, 1), (1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 0, 1)]


def test_empty(spark):
    assert run(spark, []).count() == 0
