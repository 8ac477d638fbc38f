"""Partitions follow the rows of the source table, with equal results, and ranges meet in one join."""

import pytest

from tests.oracle import compare, duck
from tracelake.operators import dealt, needed, ranges, shell
from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["readmit", "elided_ranges", "targets_after", "rereq_events", "is_needed_now", "render_kept", "loop_fracs"])
def test_partitions_follow_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(dealt, "ROWS", 100)
    query = registry.queries()[name]
    assert query(spark, SF).rdd.getNumPartitions() >= (10 if name == "loop_fracs" else 60)
    compare(spark, SF, query, registry.oracle_sql()[name], duck(SF))


def test_ranges_meet_in_one_join(spark):
    rows = [(1, 0, 0, "a", 1, 9), (1, 1, 1, "a", None, None), (1, 2, 2, "a", 60, 140), (1, 3, 3, "a", 100, 90_000), (1, 4, 4, "b", 1, 9), (1, 5, 5, "a", 128, 300), (1, 6, 6, "a", -5, 0)]
    d = spark.createDataFrame(rows, "conv long, gi long, step long, file string, lo long, hi long")
    at = {g: (f, 1 if lo is None else lo, ranges.WHOLE if hi is None else hi) for _, g, _, f, lo, hi in rows}
    want = sorted((a, b) for a in at for b in at if at[a][0] == at[b][0] and at[a][1] <= at[b][2] and at[b][1] <= at[a][2])
    for n in (None, 3):
        met = ranges.overlaps(d, d, n)
        assert sorted((r.gi, r.gi2) for r in met.collect()) == want
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_bare_observations_need_no_join(spark):
    rows = [(1, "sed -n 1,5p a.py", None), (2, "grep -rn x src", " \n\t"), (3, "run", ""), (4, "run", "\x85 "), (5, "cat a.py", "a\n\nb"), (6, "grep -rn x src", "a.py:3: x\n\nb")]
    d = spark.createDataFrame(rows, "id long, cmd string, obs string")
    out = shell.chunk_observations(d)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.n, r.kind, r.text) for r in out.collect() if r.id < 5) == [(1, 0, "read", None), (2, 0, "other", " \n\t"), (3, 0, "other", ""), (4, 0, "other", "\x85 ")]
    assert [r.n for r in out.filter("id > 4").orderBy("id", "n").collect()] == [0, 0, 1]
    whole = shell.chunk_observations(d, atom=None).filter("id IN (1, 5)").orderBy("id", "n").collect()
    assert [(r.id, r.text) for r in whole] == [(1, None), (5, "a\n\nb")]


def test_levels_share_one_join(spark):
    """Every level's verdicts from one join equal those of the level by itself, with lines and whole files that are not known too."""
    chunks, reads, commands, hunks = needed.derived(ranges.derived_ranges(spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_suppkey < 4")))
    hunks = hunks.unionByName(spark.createDataFrame([(1, "f1.py", None, 3), (2, "f2.py", 40, None), (3, "f3.py", None, None)], hunks.schema))
    args = (chunks, reads, commands, hunks)
    got = needed.needed_by_level(*args, list(needed.LEVELS.values()))
    want = {k: {(r.conv, r.gi): r.needed for r in needed.needed(*args, level).collect()} for k, level in needed.LEVELS.items()}
    rows = {(r.conv, r.gi): r.needed for r in got.collect()}
    assert {k: {x: v[i] for x, v in rows.items()} for i, k in enumerate(needed.LEVELS)} == want
    assert len(set(map(tuple, rows.values()))) > 5
    kept = needed.kept_by_level(*args)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert {(r.conv, r.level): r.kept for r in kept.collect()} == {(c, k): sum(v for (x, _), v in m.items() if x == c) for k, m in want.items() for c in {x for x, _ in m}}


def test_keep_set_follows_the_input_too(spark, monkeypatch):
    monkeypatch.setattr(dealt, "ROWS", 500)
    query = registry.queries()["keep_set"]
    assert query(spark, SF).rdd.getNumPartitions() >= 12
    compare(spark, SF, query, registry.oracle_sql()["keep_set"], duck(SF))
