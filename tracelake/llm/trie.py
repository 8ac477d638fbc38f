"""Conversation prefix trie, summed from the leaves by messages.

Every distinct sequence of a conversation's first d turns is a node. A node is told by a sum of hashes of (role, text, place), kept
as four 32-bit parts: a running sum, so a conversation of any length is cut in blocks and never met by one task. Each node takes as
label the member of least hash; as members only fall away further down, the nodes of a label are one path from some depth to that
conversation's end. The paths form a tree of about ln(number of conversations) levels, whatever the depth of the trie: a path holds a
counter of the child paths still to come, a path whose counter is zero sends its totals to its parent, and so on until the root's path
finishes. Within a path the totals run up from the end, again by blocks.

Defined results: turns are ordered by turn (null first), ties by a hash of role and text; null roles and texts are empty; rows
without a conv_id belong to no conversation; repeated rows are turns of their own; other columns are not read; without any
conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

#: Turns of a conversation, or nodes of a path, summed in one go; longer ones are cut in blocks of this many.
BLOCK = 1024
#: Width of the ranges of conv_id that are joined to one string before a node's members are digested.
MEMBERS = 4096
MAX_ROUNDS = 1000
_SUMS = ["s1", "s2", "s3", "s4"]


def _hashes() -> list[Column]:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return [F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes")]


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as (conv_id, pos, t1, t2, bytes), pos from 0 in order of turn; and (conv_id, n), the number of turns of each.

    Turns are dealt by ranges of (conv_id, turn), so a long conversation lies in several tasks and each range counts on from the
    ranges before it.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *_hashes())
    order = ["turn", "t1", "t2"]
    ranged = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    turns = ranged.join(parts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    turns = turns.select("conv_id", (F.col("before") + here - 1).alias("pos"), "t1", "t2", "bytes")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: of each, the first h turns of the conversation with the next lower id that 5 divides, then its own after h.

    Same columns as `numbered`; a conversation may be left without turns.
    """
    turns, sizes = numbered(conversations)
    turns, sizes = stored(turns, "numbered"), stored(sizes, "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base"), h.alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    after = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    heads = turns.filter("pos < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    heads = heads.join(plan.select("conv_id", "base", "taken"), "base").filter("pos < taken")
    names = ["conv_id", "pos", "t1", "t2", "bytes"]
    return after.select(names).unionByName(heads.select(names)), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def running(rows: DataFrame, group: str, place: str, sums: list[str], down: bool = True, block: int = BLOCK) -> DataFrame:
    """`rows` with each of `sums` summed over the rows of the group up to this place (down) or from it on; one row for each place.

    Sums run inside blocks of places, then over the blocks' totals, so no task needs more than a block of a group's rows.
    """
    b = rows.withColumn("block", F.floor(F.col(place) / block))
    key = (lambda c: F.col(c).asc()) if down else (lambda c: F.col(c).desc())
    first = Window.unboundedPreceding
    inner = Window.partitionBy(group, "block").orderBy(key(place)).rowsBetween(first, 0)
    outer = Window.partitionBy(group).orderBy(key("block")).rowsBetween(first, -1)
    totals = b.groupBy(group, "block").agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(group, "block", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_{c}") for c in sums])
    b = b.withColumns({c: F.sum(c).over(inner) for c in sums}).join(totals, [group, "block"])
    return b.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("block", *[f"_{c}" for c in sums])


def _prefixes(turns: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, ends): each conversation's nodes, the root too, with keys of node and parent."""
    place = F.col("pos") + 1
    a, b = F.xxhash64("t1", "t2", place), F.xxhash64(F.lit(1), "t1", "t2", place)
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]
    steps = turns.select("conv_id", place.cast("long").alias("depth"), "bytes", *[x.alias(s) for s, x in zip(_SUMS, parts)], *[x.alias(f"own{s}") for s, x in zip(_SUMS, parts)])
    steps = running(steps, "conv_id", "depth", _SUMS, block=block)

    def key(depth: Column, sums: list[Column], names: tuple[str, str]) -> list[Column]:
        return [F.xxhash64(depth, *sums).alias(names[0]), F.xxhash64(F.lit(1), depth, *sums).alias(names[1])]

    node = key(F.col("depth"), [F.col(s) for s in _SUMS], ("k1", "k2"))
    parent = key(F.col("depth") - 1, [F.col(s) - F.col(f"own{s}") for s in _SUMS], ("p1", "p2"))
    steps = steps.join(sizes, "conv_id").select("conv_id", "depth", *node, *parent, "bytes", (F.col("depth") == F.col("n")).alias("ends"))
    zero = F.lit(0).cast("long")
    root = sizes.select("conv_id", zero.alias("depth"), *key(zero, [zero] * 4, ("k1", "k2")), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), (F.col("n") == 0).alias("ends"))
    return steps.unionByName(root)


def _tree(prefixes: DataFrame) -> DataFrame:
    """A row for each node: key, depth, least member, label, members, children, and the parent's least member and label."""
    draw = F.min(F.struct(F.xxhash64("conv_id").alias("draw"), "conv_id"))
    nodes = prefixes.groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), draw.alias("draw"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = stored(nodes.withColumn("label", F.col("draw.conv_id")).drop("draw"), "nodes")
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("label").alias("parent_label"))
    tree = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.join(parents, ["p1", "p2"], "left").withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    out = stored(tree.drop("p1", "p2", "bytes"), "tree")
    drop_stored(nodes)
    return out


def peeled(paths: DataFrame) -> DataFrame:
    """(parent, at, leaves, saved): the totals that every path sends to the node of `parent` at depth `at`.

    `paths` has (label, parent, at, leaves, saved), own sums at first. In each round the paths whose counter of child paths is zero
    send their totals; the messages to a path are summed in the map tasks first and join the one row of that path.
    """
    waiting = paths.groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("left"))
    active = stored(paths.join(waiting, "label", "left").withColumn("left", F.coalesce("left", F.lit(0))), "paths")
    sent: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        done = active.filter("left = 0 AND parent IS NOT NULL")
        sent.append(done.select("parent", "at", "leaves", "saved"))
        mail = done.groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = active.filter("left > 0").join(mail, "label", "left")
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        rest = rest.select("label", "parent", "at", add("leaves", "more_leaves"), add("saved", "more_saved"), (F.col("left") - F.coalesce("came", F.lit(0))).alias("left"))
        active = stored(rest, "paths")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, sent)
    raise RuntimeError(f"paths are left after {MAX_ROUNDS} rounds")


def _members(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end: ids ascending, joined by range of ids first, then digested in order."""
    part = F.floor(F.col("conv_id") / MEMBERS)
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ids = prefixes.filter("ends").groupBy("k1", "k2", part.alias("part")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (a, b) == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield _digests(out)
                out = []
        if key:
            yield _digests([(*key, sha.hexdigest())])

    return ids.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string()])], names=["k1", "k2", "ends_sha256"])


def trie(turns: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of conversations given as by `numbered`."""
    prefixes = stored(_prefixes(turns, sizes, block), "prefixes")
    tree = _tree(prefixes)
    top = F.coalesce(F.col("parent_label") != F.col("label"), F.lit(True))
    paths = tree.groupBy("label").agg(F.max(F.when(top, F.col("parent_label"))).alias("parent"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    came = peeled(paths).groupBy(F.col("parent").alias("label"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = tree.join(came, ["label", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    whole = running(whole.drop("more_leaves", "more_saved"), "label", "depth", ["leaves", "saved"], down=False, block=block)
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    return whole.join(_members(prefixes), ["k1", "k2"], "left").select(*own, ends)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` (conv_id, turn, role, text) as they are."""
    turns, sizes = numbered(conversations)
    return trie(turns, stored(sizes, "sizes"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(turns, stored(sizes, "rebuilt-sizes"))
