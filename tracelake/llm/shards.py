"""Shards of near equal bytes by sampled splitters.

A record's key is the hash of its text, then of its id: copies of a text lie side by side. Records of a shard's `PART`-th or more are
few; they go to the emptiest shard each, largest first. From the others a sample is drawn, each record with a chance in proportion to
its size; the sample's quantiles are the borders of ranges of text hashes. The ranges' sums are taken over all records, and a range
that came out overfull, as one text's copies may make it, is cut again by the second hash. Running sums inside the ranges, on top of
the sums of the ranges before, give each record's place in the whole; the places are cut where each shard's room ends, copies of one
text being kept together up to a `PART`-th of a shard.

Only DataFrame functions are used. The driver holds the borders and sums of at most `MAX_RANGES` ranges and the sizes of the few large
records, never rows. Nothing but the narrow key table is shuffled.

Law: `bytes`. Defined results: null text has no bytes and the checksum of none, 0; repeated rows and null ids are records like others
(rows equal in text and id share a key and meet in one range, in any order); a record larger than a shard's share fills a shard alone
and beyond; an empty table gives an empty one; other columns pass, and own columns named like the added ones give way.
"""

from __future__ import annotations

import bisect
import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, stored, table, text_or_empty

SHARDS = 24
OVERHEAD = 8
#: A record of a shard's PART-th or more is placed alone; smaller groups of copies stay together.
PART = 64
#: Ranges: so many for each shard at least, one for so many rows, and no more than the last number.
RANGES_A_SHARD, ROWS_A_RANGE, MAX_RANGES = 8, 1_000_000, 16_384
#: Sampled records for each range, on average; a range of this many times the mean is overfull.
SAMPLES, OVERFULL = 16, 2
_ADDED = ["size", "text_crc32", "shard", "slot"]


def record_size(text: Column) -> Column:
    return (F.octet_length(text_or_empty(text)) + OVERHEAD).cast("long")


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns `names` of each record with its size, text_crc32 and the two hashes of its key."""
    text = text_or_empty(F.col("text"))
    d = docs.select(*names, "doc_id", record_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"))
    return d.select(*names, "size", "text_crc32", "h1", F.xxhash64(F.lit(1), "doc_id", "h1").alias("h2"))


def range_count(rows: int, shards: int = SHARDS) -> int:
    return max(1, min(MAX_RANGES, max(RANGES_A_SHARD * shards, rows // ROWS_A_RANGE)))


def splitters(sample: list[tuple[int, int]], ranges: int) -> list[int]:
    """Borders of `ranges` ranges of about equal weight from (h1, weight) of a sample; equal borders fall together."""
    sample = sorted(sample)
    sums = list(accumulate(w for _, w in sample))
    return sorted({sample[bisect.bisect_left(sums, sums[-1] * k / ranges)][0] for k in range(1, ranges)}) if sample else []


def _lookup(rows: DataFrame, key: str, borders: list[int], name: str) -> DataFrame:
    """`rows` with how many borders lie at or below the key: a binary search that folds over the halved widths."""
    widths = [1 << k for k in reversed(range(len(borders).bit_length()))]
    if not widths:
        return rows.withColumn(name, F.lit(0))
    wall = _literals(borders, "long")
    found = F.aggregate(_literals(widths, "int"), F.lit(0), lambda low, w: F.when(F.get(wall, low + w - 1) <= F.col(key), low + w).otherwise(low))
    return rows.withColumn(name, found)


def emptiest(sizes: list[int], shards: int) -> list[int]:
    """A shard for each of the sizes, which fall: the one that holds the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size in sizes:
        held, s = heap[0]
        out.append(s)
        heapq.heapreplace(heap, (held + size, s))
    return out


def rooms(total: int, taken: list[int]) -> list[float]:
    """How much of `total` each shard gets on top of what it holds, so that all hold the same, but for those that hold more already."""
    open_, level = sorted(range(len(taken)), key=lambda s: taken[s]), 0.0
    while open_:
        level = (total + sum(taken[s] for s in open_)) / len(open_)
        if taken[open_[-1]] <= level:
            break
        open_.pop()
    return [max(0.0, level - t) if s in set(open_) else 0.0 for s, t in enumerate(taken)]


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _subdivided(placed: DataFrame, borders: list[int], sums: list, mean: int, rows: int) -> tuple[list[int], set[int]]:
    """Borders that also set apart each text whose copies fill a range, and cut what else is overfull evenly; and those texts' hashes.

    Such texts are fewer than the ranges that their bytes or rows would fill.
    """
    over = {r.range: (r.bytes, r.n) for r in sums if r.bytes > OVERFULL * mean or r.n > OVERFULL * rows}
    if not over:
        return borders, set()
    flags = F.get(_literals([i in over for i in range(len(borders) + 1)], "boolean"), F.col("range"))
    hot = placed.filter(flags).groupBy("range", "h1").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > mean) | (F.col("n") > rows)).collect()
    new = set(borders)
    for h in hot:
        new |= {h.h1, min(h.h1 + 1, 2**63 - 1)}
    wall = [-(2**63), *borders, 2**63 - 1]
    for i, (size, n) in over.items():
        size -= sum(h.bytes for h in hot if h.range == i)
        n -= sum(h.n for h in hot if h.range == i)
        parts = max(-(-size // mean), -(-n // rows))
        new |= {wall[i] + (wall[i + 1] - wall[i]) * k // parts for k in range(1, parts)}
    return sorted(new), {h.h1 for h in hot}


def placed_records(keys: DataFrame, shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """The records of `keyed`, each with its shard and slot; a stored table of its own columns, so keep them narrow."""
    spark = keys.sparkSession
    own = [c for c in keys.columns]
    rows = stored(keys, "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    big = max(1, total // (shards * PART))
    ranges = range_count(count, shards)

    # The large records: at most shards * PART, as their sizes add up to no more than the total.
    large, small = rows.filter(F.col("size") > big), rows.filter(F.col("size") <= big)
    sizes = sorted((r[0] for r in large.select("size").collect()), reverse=True)
    chosen, taken = emptiest(sizes, shards), [0] * shards
    for size, s in zip(sizes, chosen):
        taken[s] += size

    # The sample: a chance of size / step each, so about SAMPLES for each range.
    step = max(1, total // (ranges * SAMPLES))
    drawn = F.pmod(F.xxhash64(F.lit(2), "h1", "h2"), F.lit(step)) < F.col("size")
    borders = splitters([(h, max(step, size)) for h, size in small.filter(drawn).select("h1", "size").collect()], ranges)

    # Sums over all records, and over the ranges as subdivided.
    mean = max(1, (total - sum(sizes)) // ranges)
    placed, sums = _counted(small, borders)
    finer, hot = _subdivided(placed, borders, sums, mean, rows_a_range)
    cuts = [1] * (len(finer) + 1)
    if finer != borders:
        placed, sums = _counted(small, finer)
        for r in sums:
            cuts[r.range] = max(-(-r.bytes // mean), -(-r.n // rows_a_range)) if r.range and finer[r.range - 1] in hot else 1
    pieces = F.get(_literals(cuts, "int"), F.col("range"))
    piece = F.floor((F.col("h2").cast("double") / 2.0**64 + 0.5) * pieces).cast("int")
    placed = placed.withColumn("piece", F.least(piece, pieces - 1))
    if max(cuts) > 1:
        sums = sorted(tuple(r) for r in placed.groupBy("range", "piece").agg(F.sum("size")).collect())
    else:
        sums = sorted((r.range, 0, r.bytes) for r in sums)
    before = [0, *accumulate(b for _, _, b in sums)]
    starts = spark.createDataFrame([(a, b, x) for (a, b, _), x in zip(sums, before)], "range int, piece int, before long")

    # A record's place is where its text's copies begin in the range, but for whole `big`s that they fill.
    start = Window.unboundedPreceding
    up_to = F.sum("size").over(Window.partitionBy("range", "piece").orderBy("h1", "h2").rowsBetween(start, 0)) - F.col("size")
    at = placed.join(F.broadcast(starts), ["range", "piece"]).withColumn("at", F.col("before") + up_to)
    at = at.withColumn("first", F.first("at").over(Window.partitionBy("range", "piece", "h1").orderBy("h2").rowsBetween(start, 0)))
    at = at.withColumn("at", F.expr(f"first + ((at - first) div {big}L) * {big}L"))
    ends = list(accumulate(rooms(total - sum(sizes), taken)))
    at = _lookup(at, "at", [round(e) for e in ends[:-1]], "shard").select(*own, "shard", "range", "piece")

    # The large ones come first in their shards, as a range of their own.
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "h1", "h2"))
    alone = large.withColumn("shard", F.get(_literals(chosen, "int"), rank - 1)).select(*own, "shard", F.lit(-1).alias("range"), F.lit(0).alias("piece"))
    at = stored(at.unionByName(alone), "shard-places")
    parts = at.groupBy("shard", "range", "piece").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(start, -1))
    parts = parts.select("shard", "range", "piece", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    here = F.row_number().over(Window.partitionBy("range", "piece", "shard").orderBy("h1", "h2"))
    return at.join(F.broadcast(parts), ["shard", "range", "piece"]).select(*own, "shard", (F.col("earlier") + here - 1).alias("slot"))


def _counted(rows: DataFrame, borders: list[int]) -> tuple[DataFrame, list]:
    placed = _lookup(rows, "h1", borders, "range")
    return placed, placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def sharded(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """`docs` (a doc_id, a text, any more) with size, text_crc32, shard and slot, gapless from 0 in each shard.

    Records meet their places by key; where several records share a key, the k-th takes the k-th place.
    """
    docs = docs.drop(*_ADDED)
    whole = keyed(packed(docs, "doc_id", "text"), "_whole")
    twin = lambda *order: F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))
    places = placed_records(keyed(docs.select("doc_id", "text")), shards, **how).select("h1", "h2", "shard", "slot").withColumn("twin", twin("shard", "slot"))
    return whole.withColumn("twin", twin("size")).join(places, ["h1", "h2", "twin"]).select("_whole.*", *_ADDED)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = placed_records(keyed(docs.withColumn("_id", F.col("doc_id")), "_id"))
    return out.select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
