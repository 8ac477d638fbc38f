"""Folds: by hand, by brute force, and streams against tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import decisions, graph, shell
from tracelake.sources import lines
from tracelake.streaming import gates, keyed

def test_fold_equals_replay(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), g, g // 2, g, f"c{rng.randrange(2)}" if rng.random() < 0.9 else None, rng.choice([5, 30]), rng.randrange(1_000_000)) for g in range(300)]
    d = spark.createDataFrame(rows, "conv long, gi long, step long, owner long, cmd string, tokens long, score_q long")
    got = {(r.conv, r.gi): (r.insisted, r.cut) for r in shell.fold(d, 600_000).collect()}
    held = {}
    for conv, gi, _, _, cmd, tokens, score in rows:
        would = score < 600_000 and tokens >= 10
        insisted = cmd is not None and held.get((conv, cmd), False)
        held[conv, cmd] = would and not insisted
        assert got[conv, gi] == (insisted, would and not insisted)
    would = d.withColumn("would", (F.col("score_q") < 600_000) & (F.col("tokens") >= 10)).filter("cmd IS NOT NULL").withColumn("seq", F.col("gi"))
    valve = keyed.over_table(would.select("conv", "seq", "step", "owner", "cmd", "would"), "conv", "seq", gates.valve_step, gates.VALVE)
    assert all(r.insisted == got[r.conv, r.owner][0] for r in valve.collect())


def test_purity(spark):
    d = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["x", "b", "c"]), (1, 3, ["x"]), (1, 4, ["x", "y"])], "conv long, seq long, hashes array<string>")
    assert [r.reset for r in decisions.purity_resets(d).orderBy("seq").collect()] == [False, False, True, True, False]


def test_pagerank(spark):
    e = [(1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "b", "a", 1.0), (1, "b", "a", 1.0), (1, "d", "c", 1.0), (2, "x", "y", 1.0)]
    got = {(r.conv, r.node): r.rank for r in graph.pagerank(spark.createDataFrame(e, "conv long, src string, dst string, weight double")).collect()}
    names = "abcd"
    m = np.zeros((4, 4))
    for c, s, t, w in e:
        if c == 1:
            m[names.index(t), names.index(s)] += w
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 0.25)
    r = np.full(4, 0.25)
    for _ in range(200):
        r = 0.15 / 4 + 0.85 * m @ r
    assert [got[1, n] for n in names] == pytest.approx(list(r), abs=1e-6) and sum(v for k, v in got.items() if k[0] == 1) == pytest.approx(1)


def test_hourly_stream(spark, tmp_path):
    rows = spark.range(50).selectExpr("timestamp_seconds(1700000000 + id * 600) AS ts", "id AS cf", "id % 7 AS billed")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {r.hour: (r.n, r.cf, r.billed) for r in gates.hourly_ledger(rows).collect()}
    q = gates.hourly_ledger(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.hour: (r.n, r.cf, r.billed) for r in spark.table("hours").collect()} == want


def test_readers_skip_what_they_cannot_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","message":{"role":"user","content":"hi"}}\nnot json\n\n{"type":"summary"}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"thinking","thinking":"t"},{"type":"text","text":"x"}]}}\n{"type":"user","message":{"content":[]}}\n')
    d = lines.text_lines(spark, str(tmp_path))
    assert [(r.pos, r.role, r.text) for r in lines.transcript(d).orderBy("pos").collect()] == [(0, "user", "hi"), (4, "assistant", "t\nx")]
    assert [(r.role, r.text, r.reasoning) for r in lines.full_transcript(d).orderBy("pos").collect()] == [("user", "hi", ""), ("assistant", "x", "t")]
    assert lines.rollout(d).count() == 0
    b = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"messages":[{"content":"a"}]}')], "conv long, body string")
    assert [(r.conv, r.role, r.text) for r in lines.wire_messages(b).collect()] == [(3, "user", "a")]
