"""What is needed later, and fields of requests, on nulls and empty tables."""

import random

from pyspark.sql import functions as F

from tracelake.operators import needed, wire


def test_needed_with_empty_sides(spark):
    chunks = spark.createDataFrame(
        [("a", 1, 0, "obs", "x.py", 1, 9, 0.0, ["abcdefgh"], "t1"), ("a", 2, 1, "reasoning", None, None, None, None, None, "t2"), ("a", 3, 1, "obs", "plan.md", None, None, 0.9, [], "t3"), ("a", 4, 2, None, None, None, None, None, ["abcdefgh"], None)],
        "conv string, gi long, step long, kind string, file string, lo long, hi long, sup double, spans array<string>, text string",
    )
    reads = spark.createDataFrame([], "conv string, step long, file string, lo long, hi long")
    commands = spark.createDataFrame([], "conv string, step long, spans array<string>")
    hunks = spark.createDataFrame([], "conv string, file string, lo long, hi long")
    keep = needed.needed(chunks, reads, commands, hunks)
    assert {r.gi: r.needed for r in keep.collect()} == {1: False, 2: True, 3: True, 4: False}
    patched = spark.createDataFrame([("a", "x.py", 9, 9)], hunks.schema)
    assert {r.gi: r.needed for r in needed.needed(chunks, reads, commands, patched).collect()}[1]
    assert [r.text for r in needed.rendered(chunks, keep).collect()] == ["t2\nt3"]
    assert needed.needed(chunks.limit(0), reads, commands, hunks).count() == 0


def test_request_fields_of_nulls(spark):
    d = spark.createDataFrame([(None, None), ("", "abc"), ("axc", "abc"), ("abab", "ab")], "a string, b string")
    got = [tuple(r.s) for r in d.filter("a IS NOT NULL").select(wire.split_texts(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [("", "", "abc", ""), ("a", "x", "b", "c"), ("ab", "ab", "", "")]
    assert [r[0] for r in d.select(wire.digest(F.col("a"))).collect()] == [None, "", "axc", "abab"]
    assert tuple(d.limit(1).select(wire.billed_usage(F.lit(5), F.lit(9), F.lit(None).cast("long"))).head()[0]) == (0, 5, 0, 0)


def brute_keep(chunks, reads, commands, hunks, level):
    """chunks: dicts; the keep set by the definition, one alive set after the other."""
    steps = 1 + max(x["step"] for x in [*chunks, *reads, *commands])
    if steps < 6 or len(chunks) < 6:
        return set()

    def judged(c, t, sup, alive):
        later = [r for r in reads if r["step"] > t]
        soon = [r for r in later if level.horizon is None or r["step"] <= t + level.horizon]
        if c["kind"] == "reasoning":
            return True
        if sup is not None and sup >= level.sup:
            return False
        if c["file"] is None:
            df = lambda w: sum(w in x["spans"] for x in alive)
            rare = {w for w in c["spans"] if len(w) >= level.chars and df(w) <= max(2, len(alive) * level.rare)}
            return any(rare & set(x["spans"]) for x in commands if t < x["step"] and (level.horizon is None or x["step"] <= t + level.horizon))
        mine, patch = [r for r in soon if r["file"] == c["file"]], [h for h in hunks if h["file"] == c["file"]]
        meets = lambda r: c["lo"] <= r["hi"] + level.near and r["lo"] - level.near <= c["hi"]
        if c["lo"] is None:
            return any(level.whole or r["lo"] is not None for r in mine) or bool(patch)
        cov = sum(max(0, min(c["hi"], r["hi"]) - max(c["lo"], r["lo"]) + 1) for r in later if r["file"] == c["file"] and r["lo"] is not None)
        if cov and cov >= level.refetch * (c["hi"] - c["lo"] + 1) and not any(map(meets, patch)):
            return False
        return any(map(meets, patch)) or any(level.whole if r["lo"] is None else meets(r) for r in mine)

    admitted = {c["gi"] for c in chunks if judged(c, c["step"], c["sup"], chunks)}
    keep = set()
    for age in (0, 1):
        for t in range(1 + age, steps - 1):
            alive = [c for c in chunks if c["step"] <= t and (c["step"] == t or age == 1 and c["step"] == t - 1 or c["gi"] in admitted)]
            if len(alive) >= 6:
                keep |= {c["gi"] for c in alive if c["step"] == t - age and c["kind"] != "reasoning" and judged(c, t, c["sup_next"] if age else 0.0, alive)}
    return keep


def trace(rng, conv, steps):
    words = ["alphabet", "betatest", "gammaray", "deltawing", "short", "epsilonic", "zetapotential"]
    pick = lambda: [rng.choice(words) for _ in range(rng.randrange(3))]
    span = lambda: (lo := rng.choice([None, rng.randrange(60)]), None if lo is None else lo + rng.randrange(12))
    row = lambda **k: {"conv": conv} | k
    chunks, reads, commands, hunks = [], [], [], []
    for s in range(steps):
        for _ in range(rng.randrange(4)):
            lo, hi = span()
            chunks.append(row(gi=len(chunks), step=s, kind=rng.choice(["obs", "obs", "reasoning"]), file=rng.choice([None, "a.py", "b.py"]), lo=lo, hi=hi, sup=rng.random(), sup_next=rng.random(), spans=pick()))
        lo, hi = span()
        reads.append(row(step=s, file=rng.choice(["a.py", "b.py"]), lo=lo, hi=hi))
        commands.append(row(step=s, spans=pick()))
    if rng.random() < 0.5:
        hunks.append(row(file="a.py", lo=20, hi=25))
    return chunks, reads, commands, hunks


def test_keep_set_against_alive_sets_one_by_one(spark):
    rng = random.Random(6)
    traces = [trace(rng, c, n) for c, n in enumerate([2, 5, 6, 9, 14, 14, 20, 20])]
    schemas = ["conv long, gi long, step long, kind string, file string, lo long, hi long, sup double, sup_next double, spans array<string>", "conv long, step long, file string, lo long, hi long", "conv long, step long, spans array<string>", "conv long, file string, lo long, hi long"]
    tables = [spark.createDataFrame([tuple(r.values()) for t in traces for r in t[k]], s) for k, s in enumerate(schemas)]
    for number in (1, 3, 5):
        got = {(r.conv, r.gi) for r in needed.keep_set(*tables, needed.LEVELS[number]).collect() if r.keep}
        assert got == {(c, gi) for c, t in enumerate(traces) for gi in (brute_keep(*t, needed.LEVELS[number]) if t[0] else ())}, number
        assert got
    assert needed.keep_set(*tables).count() == sum(len(t[0]) for t in traces)
    assert needed.keep_set(*[t.limit(0) for t in tables]).count() == 0


def test_keep_set_judges_first_once(spark, monkeypatch):
    monkeypatch.setattr(needed, "held", lambda d, name, keep=needed.held: seen.append(name) or keep(d, name))
    seen = []
    chunks, reads, commands, hunks = trace(random.Random(3), 1, 12)
    tables = [spark.createDataFrame([tuple(r.values()) for r in t] or [], s) for t, s in zip((chunks, reads, commands, hunks), SCHEMAS)]
    out = needed.keep_set(*tables)
    assert seen == ["judged", "points", "use"]
    assert out.count() == len(chunks)


SCHEMAS = ["conv long, gi long, step long, kind string, file string, lo long, hi long, sup double, sup_next double, spans array<string>", "conv long, step long, file string, lo long, hi long", "conv long, step long, spans array<string>", "conv long, file string, lo long, hi long"]
