"""Which chunks of a conversation are needed later: by later reads, by the final patch, by rare words of later commands.

Chunks are (conv, gi, step, kind, file, lo, hi, sup, spans): `file` null for what is no file, `lo` and `hi` null where the lines are
not known, `sup` the share of the chunk that a fresher copy serves, `spans` its distinctive words. Reads are (conv, step, file, lo, hi),
null lines for a whole file; commands (conv, step, spans); hunks (conv, file, lo, hi), the lines that the final patch touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import WHOLE, planning_doc
from .dealt import dealt, held
from .ranges import overlaps


@dataclass(frozen=True)
class Level:
    """How hard to trim: `near` lines around a target count as it; a copy of `sup` and over cuts; words in more than `rare` of the chunks
    (two at least) or under `chars` characters say nothing; what later reads cover to `refetch` is dead; `whole` reads may count as
    use; only the next `horizon` steps count as later; of the reasoning, the last `continuity` steps stay."""

    near: int = 0
    sup: float = 0.8
    rare: float = 0.05
    chars: int = 8
    refetch: float = 0.8
    whole: bool = False
    horizon: int | None = None
    continuity: int = 2


# The levels from keeping most to trimming hardest; the third is the measured one.
LEVELS = {
    1: Level(near=20, sup=0.95, rare=0.15, chars=6, refetch=1.0, whole=True),
    2: Level(near=10, sup=0.9, rare=0.10, refetch=0.9, whole=True),
    3: Level(),
    4: Level(sup=0.7, rare=0.03, chars=10, refetch=0.6, horizon=40),
    5: Level(sup=0.6, rare=0.02, chars=12, refetch=0.5, horizon=15),
}


def later(points: DataFrame, events: DataFrame, keys: list[str], horizon: int | None, n: str) -> DataFrame:
    """`points` with `n`: events of the same keys in the next `horizon` steps after the point's own, all later ones if None.

    Both sides shrink to one row a key and step before they meet, and no pairs are made.
    """
    on = [*keys, "step"]
    both = events.groupBy(*on).agg(F.count("*").alias("e")).unionByName(points.select(*on).distinct().withColumn("e", F.lit(0).cast("long")))
    steps = both.groupBy(*on).agg(F.sum("e").alias("e"))
    before = Window.unboundedPreceding if horizon is None else -horizon
    w = Window.partitionBy(*keys).orderBy(F.desc("step")).rangeBetween(before, -1)
    return points.join(steps.select(*on, F.coalesce(F.sum("e").over(w), F.lit(0)).alias(n)), on, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def targets_after(chunks: DataFrame, reads: DataFrame, hunks: DataFrame, horizon: int | None = None, n: int | None = None, others: tuple[int | None, ...] = ()) -> DataFrame:
    """File chunks with how often their file is a target later: `precise` and `whole` reads within the horizon, `patched` hunks; reads
    within each of `others` as `precise_1`, `whole_1` and so on.

    Chunks, reads and hunks of a file lie in one order, latest first, and running counts tell them: what came so far less what lies
    beyond the horizon. `n`: partitions.
    """
    own = chunks.filter("file IS NOT NULL")
    row = F.struct(*[c for c in own.columns if c not in ("conv", "file", "step")])
    d = own.select("conv", "file", "step", F.lit(0).alias("_what"), row.alias("_row"))
    events = reads.filter("step IS NOT NULL").select("conv", "file", "step", F.when(F.col("lo").isNotNull(), 1).otherwise(2).alias("_what"))
    events = events.unionByName(hunks.select("conv", "file", F.lit(None).cast("long").alias("step"), F.lit(3).alias("_what")))
    d = dealt(d.unionByName(events.filter("conv IS NOT NULL AND file IS NOT NULL"), allowMissingColumns=True), n, "conv", "file")
    of_file = Window.partitionBy("conv", "file")
    by_step = of_file.orderBy(F.desc_nulls_last("step"))

    def count(what: int, horizon: int | None = horizon) -> Column:
        upto = lambda k: F.coalesce(F.count_if(F.col("_what") == what).over(by_step.rangeBetween(Window.unboundedPreceding, -k)), F.lit(0))
        return F.when(F.col("step").isNull(), 0).otherwise(upto(1) if horizon is None else upto(1) - upto(horizon + 1)).cast("long")

    counts = {"precise": count(1), "whole": count(2), "patched": F.count_if(F.col("_what") == 3).over(of_file)}
    counts |= {f"{name}_{i}": count(what, h) for i, h in enumerate(others, 1) for name, what in (("precise", 1), ("whole", 2))}
    d = d.withColumns(counts).filter("_what = 0")
    return d.select(*[c if c in ("conv", "file", "step") else F.col(f"_row.{c}").alias(c) for c in own.columns], *counts)


def _range_facts(ranged: DataFrame, reads: DataFrame, hunks: DataFrame, levels: list[Level], n: int | None) -> DataFrame:
    """(conv, gi, hit_0, patch_0, .., cov) of ranges (conv, file, gi, step, lo, hi), in parts: for each level whether a later precise read
    or a hunk meets the lines, give or take `near`, and whether a hunk does; and how many lines later reads cover, each read counted for
    itself. All levels take their pairs from one join, with the largest `near`."""
    near = max(level.near for level in levels)
    own = [F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), (F.col("lo") - near).alias("lo"), (F.col("hi") + near).alias("hi")]
    targets = reads.filter("lo IS NOT NULL").select("conv", "file", "step", *own).unionByName(hunks.select("conv", "file", F.lit(None).cast("long").alias("step"), *own))
    common = F.greatest(F.lit(0), F.least("hi", "hi02") - F.greatest("lo", "lo02") + 1)
    patch = F.col("step2").isNull()

    def meets(level: Level) -> Column:
        if level.near == near:
            return F.lit(True)
        return (F.col("lo") <= F.coalesce(F.col("hi02") + level.near, F.lit(WHOLE))) & (F.coalesce(F.col("lo02") - level.near, F.lit(1)) <= F.col("hi"))

    soon = lambda level: F.lit(True) if level.horizon is None else F.col("step2") <= F.col("step") + level.horizon
    met = overlaps(ranged, targets, n, keep=("way", "b")).filter("step2 IS NULL OR step2 > step")
    facts = [F.bool_or(c & meets(level)).alias(f"{name}_{i}") for i, level in enumerate(levels) for name, c in (("hit", patch | soon(level)), ("patch", patch))]
    cov = F.sum(F.when(patch, 0).otherwise(common)).alias("cov")
    return met.groupBy("conv", "file", "way", "b", "gi").agg(*facts, cov).drop("file", "way", "b")


def _rare_use(chunks: DataFrame, commands: DataFrame, levels: list[Level], n: int | None) -> DataFrame:
    """(conv, gi, rare_0, ..), once or more, of the chunks to `ask` for that hold a rare word of a later command, for each level; `chunks` has
    their number `n` in the conversation.

    Words of chunks and commands lie in one order, latest first: the last one said before a chunk's in it is the next to come.
    """
    words = chunks.select("conv", "gi", "step", "n", "ask", F.explode(F.array_distinct("spans")).alias("span"))
    said = commands.filter("conv IS NOT NULL AND step IS NOT NULL").select("conv", "step", F.explode("spans").alias("span"), F.col("step").alias("said"))
    d = words.unionByName(said, allowMissingColumns=True).filter(F.char_length("span") >= min(level.chars for level in levels))
    of_word = Window.partitionBy("conv", "span").orderBy(F.desc_nulls_last("step"))
    following = F.last("said", ignorenulls=True).over(of_word.rangeBetween(Window.unboundedPreceding, -1))
    df = F.count("n").over(of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = dealt(d, n, "conv", "span").withColumns({"following": following, "df": df}).filter("ask AND step IS NOT NULL")

    def rare(level: Level) -> Column:
        soon = F.col("following").isNotNull() if level.horizon is None else F.col("following") <= F.col("step") + level.horizon
        return F.coalesce((F.char_length("span") >= level.chars) & (F.col("df") <= F.greatest(F.lit(2.0), F.col("n") * level.rare)) & soon, F.lit(False))

    found = [rare(level).alias(f"rare_{i}") for i, level in enumerate(levels)]
    return d.select("conv", "gi", *found).filter(" OR ".join(f"rare_{i}" for i in range(len(levels))))


def needed(chunks: DataFrame, reads: DataFrame, commands: DataFrame, hunks: DataFrame, level: Level = LEVELS[3], now: Column | None = None, use: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(conv, gi, needed). The first rule that applies decides: the step being acted on (`now`) and planning documents stay; reasoning
    stays (with `now`: for `continuity` steps); copies go; lines that are read again anyway go unless the patch touches them; file
    chunks stay if a target meets them, or their file if their lines are not known; other chunks stay for a rare word said later.

    An empty side gives no targets; null files and lines as above; rows of equal (conv, gi) are taken for one chunk. `use`: (conv, gi) of
    the chunks that hold a rare word said later, where that is known. `n`: partitions.

    What rules need no other row decide first; only the rest look for targets and words, and each finding is a row of its own, summed up
    by (conv, gi) at the end.
    """
    use = None if use is None else use.select("conv", "gi", F.lit(True).alias("rare_0"))
    return needed_by_level(chunks, reads, commands, hunks, [level], now, use, n).select("conv", "gi", F.col("needed")[0].alias("needed"))


def needed_by_level(chunks: DataFrame, reads: DataFrame, commands: DataFrame, hunks: DataFrame, levels: list[Level], now: Column | None = None, use: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(conv, gi, needed) as `needed`, an array with one verdict for each of `levels`: all from one join of ranges and one order of each
    file and word, so what is shuffled hardly grows with their number. `use`: (conv, gi, rare_0, ..)."""
    each = list(enumerate(levels))
    plan = F.col("file").isNotNull() & planning_doc(F.col("file"))

    def first_rules(level: Level) -> Column:
        reasoning = F.lit(True) if now is None else now - F.col("step") < level.continuity
        early = F.when(F.lit(False) if now is None else F.col("step") >= now, True).when(F.col("kind") == "reasoning", reasoning)
        return early.when(F.col("plan"), True).when(F.col("sup") >= level.sup, False)

    early = [f"early_{i}" for i, _ in each]
    d = chunks.withColumn("plan", plan)
    d = dealt(d.select("conv", "gi", "step", "file", "lo", "hi", *[first_rules(level).alias(early[i]) for i, level in each], *([] if use is not None else ["spans"])), n, "conv")
    d = d.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "gi").orderBy("gi"))).filter("copy = 1").drop("copy")
    left = " OR ".join(f"{c} IS NULL" for c in early)
    lines = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    files = d.filter(f"file IS NOT NULL AND ({left})").drop("spans", *early)
    horizons = list(dict.fromkeys(level.horizon for level in levels))

    def file_hit(level: Level) -> Column:
        k = horizons.index(level.horizon)
        of = lambda name: F.col(f"{name}_{k}" if k else name) > 0
        whole = of("whole") if level.whole else F.lit(False)
        return F.when(lines, whole).otherwise(of("precise") | (F.col("patched") > 0) | whole)

    of_file = targets_after(files, reads, hunks, horizons[0], n, tuple(horizons[1:]))
    of_file = of_file.select("conv", "gi", *[file_hit(level).alias(f"hit_{i}") for i, level in each], F.when(lines, F.col("hi") - F.col("lo") + 1).alias("size"))
    of_lines = _range_facts(files.filter(lines), reads, hunks, levels, n)
    if use is None:
        counted = d.withColumns({"n": F.count("*").over(Window.partitionBy("conv")), "ask": F.col("file").isNull() & F.expr(left)})
        use = _rare_use(counted, commands, levels, n)
    found = d.select("conv", "gi", *early, F.col("file").isNull().alias("plain")).unionByName(of_file, allowMissingColumns=True)
    found = found.unionByName(of_lines, allowMissingColumns=True).unionByName(use, allowMissingColumns=True)
    flags = ["plain", *[f"{name}_{i}" for i, _ in each for name in ("early", "hit", "patch", "rare")]]
    facts = [F.bool_or(c).alias(c) for c in flags] + [F.max("size").alias("size"), F.sum("cov").alias("cov")]
    known = dealt(found, n, "conv", "gi").groupBy("conv", "gi").agg(*facts).filter("plain IS NOT NULL")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))

    def rule(i: int, level: Level) -> Column:
        dead = F.coalesce((F.col("cov") > 0) & (F.col("cov") >= level.refetch * F.col("size")), F.lit(False)) & ~yes(f"patch_{i}")
        return F.when(F.col(early[i]).isNotNull(), F.col(early[i])).when(F.col("plain"), yes(f"rare_{i}")).when(dead, False).otherwise(yes(f"hit_{i}"))

    return known.select("conv", "gi", F.array(*[rule(i, level) for i, level in each]).alias("needed"))


#: A trace of fewer steps, or with fewer chunks, has no keep set, and an alive set of fewer chunks decides nothing.
LEAST = 6


def readouts(chunks: DataFrame, last: DataFrame) -> DataFrame:
    """(conv, gi, age, t, ...) of when each chunk that is no reasoning is looked at: at its own step and at the next, never at the first
    or the last step of all; `last` is (conv, steps)."""
    d = chunks.filter("coalesce(kind, '') <> 'reasoning'").join(last, "conv").withColumn("age", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("t", F.col("step") + F.col("age"))
    return d.filter("step >= 1 AND t < steps - 1").drop("steps")


def _alive_counts(admitted: DataFrame, points: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`points` (.., age, t) with how many rows of `admitted` (.., step, admitted) of the same keys are alive: those of step t, at age 1
    of the step before too, and the admitted ones of all earlier steps.

    Counts by step are summed up once and differences give every view of them; nothing is counted anew for a step.
    """
    at = points.select(*keys, F.col("t").alias("step")).distinct()
    zero = F.lit(0).cast("long")
    counts = admitted.groupBy(*keys, "step").agg(F.count_if("admitted").alias("a"), F.count_if(~F.col("admitted")).alias("b"))
    both = counts.unionByName(at.select(*keys, "step", zero.alias("a"), zero.alias("b"))).groupBy(*keys, "step").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("step")
    so_far, here, before = F.sum("a").over(w), F.col("b"), F.coalesce(F.sum("b").over(w.rangeBetween(-1, -1)), F.lit(0))
    views = both.select(*keys, F.col("step").alias("t"), (so_far + here).alias("_0"), (so_far + here + before).alias("_1"))
    d = points.join(views, [*keys, "t"], "left")
    return d.withColumn(name, F.when(F.col("age") == 0, F.col("_0")).otherwise(F.col("_1"))).drop("_0", "_1")


def keep_set(chunks: DataFrame, reads: DataFrame, commands: DataFrame, hunks: DataFrame, level: Level = LEVELS[3], n: int | None = None) -> DataFrame:
    """(conv, gi, keep) of every chunk: whether one of its readouts needs it.

    First every chunk is judged once over all chunks; those needed, and all reasoning, are admitted. Then each chunk is judged at its own
    step and at the next, as of that step: against later reads, commands and hunks from there on, with words rare among the chunks alive
    then, and with copies alive then (at its own step none is fresher; at the next, `sup_next` is the share that it serves again).
    Reasoning, first and last steps are never kept; nor is anything of a trace of fewer than six steps or chunks.

    `n`: partitions; with a number, rows are dealt by conversation before their words are, so counts and orders of words move nothing.
    """
    by_conv = lambda x: dealt(x, n, "conv")
    d = held(by_conv(chunks.select("conv", "gi", "step", "kind", "file", "lo", "hi", "sup", "sup_next", "spans")).dropDuplicates(["conv", "gi"]), "chunks")
    own = d.select("conv", "step").unionByName(reads.select("conv", "step")).unionByName(commands.select("conv", "step"))
    last = own.groupBy("conv").agg((F.max("step") + 1).alias("steps")).join(d.groupBy("conv").agg(F.count("*").alias("n")), "conv").filter((F.col("steps") >= LEAST) & (F.col("n") >= LEAST)).drop("n")
    first = needed(d, reads, commands, hunks, level, n=n).select("conv", "gi", F.col("needed").alias("admitted"))
    judged = by_conv(held(d.join(first, ["conv", "gi"]).select("conv", "gi", "step", "admitted", "spans"), "judged"))
    # words are asked for of what is no file alone
    looked = readouts(by_conv(d.withColumn("spans", F.when(F.col("file").isNull(), F.col("spans")))), by_conv(last))
    points = held(_alive_counts(judged, looked, ["conv"], "alive").filter(F.col("alive") >= LEAST), "points")
    points = points.withColumns({"sup": F.when(F.col("age") == 1, F.col("sup_next")).otherwise(F.lit(0.0)), "step": F.col("t"), "own": F.col("gi"), "gi": F.col("gi") * 2 + F.col("age")})
    long = lambda x: x.withColumn("span", F.explode(F.array_distinct("spans"))).filter(F.char_length("span") >= level.chars).drop("spans")
    plain = long(by_conv(points.filter("file IS NULL").select("conv", "gi", "age", "t", "alive", "spans")))
    rare = _alive_counts(long(judged), plain, ["conv", "span"], "df").filter(F.col("df") <= F.greatest(F.lit(2.0), F.col("alive") * level.rare))
    said = by_conv(commands.select("conv", "step", "spans")).select("conv", "step", F.explode("spans").alias("span"))
    use = held(later(rare.select("conv", "gi", "span", F.col("t").alias("step")), said, ["conv", "span"], level.horizon, "uses").filter("uses > 0").select("conv", "gi").distinct(), "use")
    out = needed(points.drop("age", "t", "alive", "own"), reads, commands, hunks, level, use=use, n=n)
    kept = out.filter("needed").select("conv", F.floor(F.col("gi") / 2).alias("gi"), F.lit(True).alias("keep")).distinct()
    return dealt(d.select("conv", "gi"), n, "conv", "gi").join(dealt(kept, n, "conv", "gi"), ["conv", "gi"], "left").select("conv", "gi", F.coalesce("keep", F.lit(False)).alias("keep"))


def kept_by_level(chunks: DataFrame, reads: DataFrame, commands: DataFrame, hunks: DataFrame, n: int | None = None) -> DataFrame:
    """(conv, level, kept): chunks that each level keeps."""
    d = needed_by_level(chunks, reads, commands, hunks, list(LEVELS.values()), n=n)
    counts = [F.struct(F.lit(k).alias("level"), F.count_if(F.col("needed")[i]).alias("kept")) for i, k in enumerate(LEVELS)]
    return dealt(d, n, "conv").groupBy("conv").agg(F.array(*counts).alias("levels")).select("conv", F.inline("levels"))


def rendered(chunks: DataFrame, keep: DataFrame, n: int | None = None) -> DataFrame:
    """(conv, text): the kept chunks' texts in order, a line break between; one row a conversation is the result itself."""
    kept = dealt(chunks.select("conv", "gi", "text"), n, "conv", "gi").join(keep.filter("needed").select("conv", "gi"), ["conv", "gi"])
    return dealt(kept, n, "conv").groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gi", "text"))), lambda x: x["text"]), "\n").alias("text"))


def derived(ranges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, reads, commands and hunks from a range table: four rows a step, every third a read, some a hunk."""
    d = held(ranges.withColumn("step", F.floor(F.col("gi") / 4)), "ranges")
    lines = F.col("gi") % 5 != 2
    chunks = d.filter("gi % 3 <> 0").select(
        "conv", "gi", "step", F.when(F.col("gi") % 11 == 0, "reasoning").otherwise("obs").alias("kind"), F.when(F.col("gi") % 13 == 0, "docs/my-plan.md").when(F.col("gi") % 7 != 1, F.col("file")).alias("file"),
        F.when(lines, F.col("lo")).alias("lo"), F.when(lines, F.col("hi")).alias("hi"), (F.col("tokens") % 100 / 100).alias("sup"), (F.col("tokens") % 90 / 100).alias("sup_next"),
        F.array(F.concat(F.lit("symbol_"), (F.col("tokens") % 40).cast("string")), F.concat(F.lit("longer_symbol_"), (F.col("gi") % 50).cast("string")), F.lit("short")).alias("spans"),
        F.concat_ws(" ", "file", F.col("lo").cast("string")).alias("text"),
    )
    read = d.filter("gi % 3 = 0")
    known = F.col("gi") % 9 != 0
    reads = read.select("conv", "step", "file", F.when(known, F.col("lo")).alias("lo"), F.when(known, F.col("lo") + 2).alias("hi"))
    commands = read.select("conv", "step", F.array(F.concat(F.lit("symbol_"), (F.col("tokens") % 60).cast("string")), F.concat(F.lit("longer_symbol_"), (F.col("gi") % 60).cast("string"))).alias("spans"))
    return chunks, reads, commands, d.filter("gi % 97 = 5").select("conv", "file", "lo", "hi")
