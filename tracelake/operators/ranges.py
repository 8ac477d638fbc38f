"""Line ranges of files: copies, overlaps, re-requests, merging. A row is (conv, gi, step, file, lo, hi, tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import WHOLE
from .dealt import dealt, held, parts

OVERLAP = 0.6
#: Lines per bucket of the range join: two ranges that meet share a bucket.
BUCKET = 64
#: Buckets over which a range is dealt at most.
SPREAD = 32


def derived_ranges(lineitem: DataFrame) -> DataFrame:
    """A range table from order lines: supplier as conversation, order as step, part as file, quantity as first line."""
    d = lineitem.select(
        F.col("l_suppkey").alias("conv"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").cast("long").alias("ln"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("file"),
        F.col("l_quantity").cast("long").alias("lo"), (F.col("l_quantity").cast("long") + 9).alias("hi"), (F.col("l_extendedprice").cast("long") % 200).alias("tokens"),
    )
    d = dealt(d, parts(lineitem), "conv")
    return d.withColumn("gi", F.row_number().over(Window.partitionBy("conv").orderBy("step", "ln", "lo", "file")).cast("long") - 1).drop("ln")


def whole_files(ranges: DataFrame) -> DataFrame:
    """`ranges` with a missing first line as 1 and a missing last line as the end of any file."""
    return ranges.withColumns({"lo": F.coalesce("lo", F.lit(1)).cast("long"), "hi": F.coalesce("hi", F.lit(WHOLE)).cast("long")})


def overlaps(left: DataFrame, right: DataFrame, n: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one conversation and file with common lines; all columns, the right's with suffix 2. `n`: partitions.

    Ranges are dealt to buckets of lines, so the join is by equality; a pair counts in the first bucket it shares. A range over more
    than `SPREAD` buckets, a whole file above all, is not dealt: such a row meets its file's others by conversation and file alone.
    These ways to meet are one join: `way` 0 by buckets `b`, 1 a narrow left with a wide right, 2 a wide left with any right; `keep`
    hands those two on.
    """

    def met_by(d: DataFrame, own_way: int, other_way: int) -> DataFrame:
        """A wide row takes `own_way` and, on the right, the other one too; a narrow row its buckets and `other_way`."""
        at = lambda way, b: F.struct(F.lit(way).alias("way"), b.cast("long").alias("b"))
        zero = F.lit(0)
        near = F.transform(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET)), lambda b: at(0, b))
        wide = F.array(at(own_way, zero)) if own_way == 2 else F.array(at(own_way, zero), at(other_way, zero))
        ways = F.when(F.col("hi") - F.col("lo") > SPREAD * BUCKET, wide).otherwise(F.concat(near, F.array(at(other_way, zero))))
        return whole_files(d).withColumn("_ways", ways).select("*", F.inline("_ways")).drop("_ways")

    keys = ["conv", "file", "way", "b"]
    one, two = met_by(left, 2, 1), met_by(right, 1, 2)
    two = two.select(*keys, *[F.col(c).alias(f"{c}2") for c in two.columns if c not in keys])
    met = dealt(one, n, *keys).join(dealt(two, n, *keys), keys).filter("lo <= hi2 AND lo2 <= hi")
    met = met.filter((F.col("way") > 0) | (F.col("b") == F.floor(F.greatest("lo", "lo2") / BUCKET)))
    return met.drop(*[c for c in ("way", "b") if c not in keep])


def _met(ranges: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs of one table's rows at different positions."""
    return overlaps(ranges, ranges, n, keep=("way", "b")).filter("gi <> gi2")


def _common():
    return F.least("hi", "hi2") - F.greatest("lo", "lo2") + 1


def range_duplicates(ranges: DataFrame) -> DataFrame:
    """Share of each range that a later step serves again (largest), and how many earlier ones cover at least 0.6 of it."""
    share = _common() / (F.col("hi") - F.col("lo") + 1)
    d = _met(ranges).groupBy("conv", "gi").agg(F.max(F.when(F.col("step2") > F.col("step"), share)).alias("s"), F.sum(F.when((F.col("step2") < F.col("step")) & (share >= OVERLAP), 1).otherwise(0)).alias("d"))
    return ranges.join(d, ["conv", "gi"], "left").select("conv", "gi", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("sup"), F.coalesce("d", F.lit(0)).cast("long").alias("dup"))


def supersession(ranges: DataFrame) -> DataFrame:
    """Edges from a range to each later one that covers at least 0.6 of it."""
    share = _common() / (F.col("hi") - F.col("lo") + 1)
    return _met(ranges).filter((F.col("step2") > F.col("step")) & (share >= OVERLAP)).select("conv", F.col("gi").alias("src"), F.col("gi2").alias("dst"))


def _earlier(ranges: DataFrame, n: int | None) -> DataFrame:
    """`ranges` (.., tokens) with `prior`, the earlier serves of any of a range's lines, and `last`, the most recent (first of its step)."""
    keys = ["conv", "gi"]
    met = _met(ranges.select(*keys, "step", "file", "lo", "hi", "tokens"), n).filter("step2 < step")
    one = F.struct("step2", (-F.col("gi2")).alias("g"), F.col("tokens2").alias("tokens"))
    d = met.groupBy(*keys, "file", "way", "b").agg(F.count("*").alias("prior"), F.max(one).alias("last"))
    d = dealt(d.select(*keys, "prior", "last"), n, *keys).groupBy(*keys).agg(F.sum("prior").alias("prior"), F.max("last").alias("last"))
    return dealt(ranges.select(*keys, "step", "file"), n, *keys).join(d, keys, "left").withColumn("prior", F.coalesce("prior", F.lit(0)).cast("long"))


def rerequests(ranges: DataFrame, n: int | None = None) -> DataFrame:
    """Earlier serves of any of a range's lines: how many, and the most recent one (first of its step)."""
    return _earlier(ranges, n).select("conv", "gi", "prior", F.col("last.step2").alias("last_step"), (-F.col("last.g")).alias("last_gi"))


def rerequest_columns(ranges: DataFrame, n: int | None = None) -> DataFrame:
    """(conv, gi, prior, event, same_file, all_events, last_cut): earlier serves of any of a range's lines and whether there is one; such
    events at earlier steps, on the same file and (as ln(1 + n)) at all; and whether the most recent serve was cut (`tokens` a third
    of the time: its cut flag, 0 without an earlier serve)."""
    before = lambda *k: Window.partitionBy(*k).orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("last.tokens") % 3 == 0, 1).otherwise(0)
    d = _earlier(ranges, n).select("conv", "gi", "step", "file", "prior", F.when(F.col("prior") > 0, 1).otherwise(0).alias("event"), cut.alias("last_cut"))
    count = lambda *k: F.coalesce(F.sum("event").over(before(*k)), F.lit(0))
    d = dealt(d, n, "conv").withColumns({"same_file": count("conv", "file"), "all_events": F.round(F.log1p(count("conv").cast("double")), 9)})
    return d.select("conv", "gi", "prior", "event", "same_file", "all_events", "last_cut")


def rerequest_base(lineitem: DataFrame) -> DataFrame:
    return rerequests(held(derived_ranges(lineitem), "ranges"), parts(lineitem))


def rerequest_events(lineitem: DataFrame) -> DataFrame:
    return rerequest_columns(held(derived_ranges(lineitem), "ranges"), parts(lineitem))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges of each file of a conversation; adjacent ones join."""
    w = Window.partitionBy("conv", "file").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = ranges.select("conv", "file", "lo", "hi").withColumn("new", F.when(F.col("lo") <= top + 1, 0).otherwise(1))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("conv", "file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def chains(ranges: DataFrame) -> DataFrame:
    """The next range of the same file by first line, and the next of the conversation."""
    return ranges.select("conv", "gi", F.lead("gi").over(Window.partitionBy("conv", "file").orderBy("lo", "gi")).alias("next_in_file"), F.lead("gi").over(Window.partitionBy("conv").orderBy("gi")).alias("next_in_time"))


def prune(ranges: DataFrame, target: float = 0.7) -> DataFrame:
    """Cut by rising score (here the first line, ties by gi) while the tokens before are under the target share."""
    w = Window.partitionBy("conv").orderBy("lo", "gi").rowsBetween(Window.unboundedPreceding, -1)
    d = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).withColumn("total", F.sum("tokens").over(Window.partitionBy("conv")))
    return d.groupBy("conv").agg(F.sum(F.when(F.col("before") < F.col("total") * target, 1).otherwise(0)).cast("long").alias("pruned"), F.sum(F.when(F.col("before") < F.col("total") * target, F.col("tokens")).otherwise(0)).cast("long").alias("pruned_tokens"))
