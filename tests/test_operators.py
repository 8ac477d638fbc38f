"""Small cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.text import splitlines
from tracelake.operators import commands, decisions, ledger, ranges, trace


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb c", "x\x1cy\x85"])
def test_splitlines_is_pythons(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(splitlines(F.col("t")).alias("x")).first().x
    assert got == text.splitlines()


def test_overlap_at_the_threshold(spark):
    d = spark.createDataFrame([("c", 0, 1, "f", 1, 10, 5), ("c", 1, 2, "f", 5, 14, 5), ("c", 2, 3, "f", 11, 20, 5)], "conv string, gi long, step long, file string, lo long, hi long, tokens long")
    assert {(r.src, r.dst) for r in ranges.supersession(d).collect()} == {(0, 1)}
    assert [(r.lo, r.hi) for r in ranges.merge_ranges(d).collect()] == [(1, 20)]


def test_long_overlap_counts_once(spark):
    d = spark.createDataFrame([("c", 0, 1, "f", 1, 500, 5), ("c", 1, 2, "f", 1, 500, 5)], "conv string, gi long, step long, file string, lo long, hi long, tokens long")
    assert [r.prior for r in ranges.rerequests(d).orderBy("gi").collect()] == [0, 1]


def test_runs_hold_enough_tokens(spark):
    d = spark.createDataFrame([(1, 1, g, t, c) for g, (t, c) in enumerate([(5, True), (6, True), (9, False), (4, True)])], "conv_id long, turn long, gi long, tokens long, cut boolean")
    assert [r.gi for r in trace.long_runs(d).orderBy("gi").collect()] == [0, 1]


def test_causal_features_ignore_the_future(spark):
    m = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"text {t} " * 9) for t in range(8)], "conv_id long, turn long, role string, text string")
    whole = {r.gi: r for r in trace.causal_features(trace.chunks(m)).collect()}
    part = {r.gi: r for r in trace.causal_features(trace.chunks(m.filter("turn < 5"))).collect()}
    assert part and all(whole[g] == r for g, r in part.items() if g < len(part) - 1)


def test_unmeasured_is_not_zero(spark):
    d = spark.createDataFrame([("s", None, 5), ("t", 3, 5)], "session_id string, cf long, billed long")
    assert {r.session_id: r.saved for r in ledger.by_session(d).collect()} == {"s": None, "t": -2}


def test_breaker_refuses_the_fourth_run_and_starts_anew_after_an_edit(spark):
    d = spark.createDataFrame([("s", i, c, c == "e") for i, c in enumerate("aaaaaeaaaa", 1)], "session string, seq long, cmd string, edit boolean")
    assert [r.blocked for r in commands.loop_breaker(d).orderBy("seq").collect()] == [False, False, False, True, False, False, False, False, False, True]


def test_whole_file_ranges_meet_without_being_dealt(spark):
    rows = [("c", 0, 1, "f", None, None, 5), ("c", 1, 2, "f", 10, 12, 5), ("c", 2, 3, "f", 1, 1_000_000_000, 6), ("c", 3, 4, "f", 5000, 9000, 5), ("c", 4, 5, "g", 1, 3, 5)]
    d = spark.createDataFrame(rows, "conv string, gi long, step long, file string, lo long, hi long, tokens long")
    got = {r.gi: (r.prior, r.last_gi) for r in ranges.rerequests(d).collect()}
    assert got == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (2, 2), 4: (0, None)}
    assert {r.gi: (r.event, r.same_file, r.last_cut) for r in ranges.rerequest_columns(d).collect()} == {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 2, 1), 4: (0, 0, 0)}


def test_null_text_is_not_a_role(spark):
    m = spark.createDataFrame([(1, 0, "user", None), (2, 0, None, "user")], "conv_id long, turn long, role string, text string")
    assert [r.prefix_len for r in trace.prefix_lengths(m).collect()] == [0]


def test_similar_commands_against_all_pairs(spark):
    rng = random.Random(5)
    cmds = [None, "", " ", "a b c", "a  b c", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    rows = [(s, q, rng.choice(cmds)) for s in (1, 2, 3) for q in range(70)]
    words = lambda c: set(c.split()) if c is not None else set()
    want = {}
    for s, q, c in rows:
        old = [x for t, p, x in rows if t == s and p < q and x is not None]
        like = c is not None and (c in old or any(words(c) & words(x) and len(words(c) & words(x)) >= 0.6 * len(words(c) | words(x)) for x in old))
        want[s, q] = float(like)
    d = spark.createDataFrame(rows, "session long, seq long, cmd string")
    for n in (None, 3):
        got = {(r.session, r.seq): r.lf for r in decisions.similar_commands(d, n=n).collect()}
        assert got == {(s, q): round(sum(f) / len(f), 9) for s, q in want for f in [[want[s, k] for k in range(max(0, q - 5), q + 1)]]}


def test_similar_commands_hand_on_no_pairs(spark):
    """1,000 commands of one word in common: pairs that share a word stay inside the join."""
    d = spark.range(1000).selectExpr("0L AS session", "id AS seq", "concat('-q w', id, ' v', id) AS cmd")
    plan = decisions.similar_commands(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "common" not in plan
