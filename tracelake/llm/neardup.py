"""Near-duplicate detection by a MinHash LSH forest.

Every document's set of word shingles gives `TREES` signatures of `DEPTH` min-hashes. Documents with the same set are one node.
Each tree is a sorted order of all nodes' signatures (a range-partitioned sort). In it a node's candidates are its nearest
neighbours with at least `MIN_DEPTH` leading min-hashes in common: where a region of equal prefixes is small that is the whole
region, where it is dense the longest common prefixes win, so the depth adapts to the region. Candidates are confirmed on the
full sets of both texts, and links are joined to components.

Two documents at similarity 0.8 share a region in no tree with probability (1 - 0.8^MIN_DEPTH)^TREES = 3e-8. What shares a region is
not lost in a crowd, nor at a partition's border: the first sweep sees every pair of a region of up to FIRST_REACH + 2 nodes and
writes down the members of every region with two nodes or more. Where a region still holds several components, the second sweep
looks at the nearest nodes of other components. Regions that are mixed even then, and were too large for the first sweep or cut by a
border, meet in an exact search for pairs of different components: a join on each set's first shingles in one order of all shingles
(a set of n shingles can only be similar to one that shares one of its first n - ceil(0.8 n) + 1). Shingles of one component alone
come first in that order, as they find nothing; a pair is made only if its sizes, the places of the shared shingle and the parity
bits of both sets (a bit differs only if the sets do) allow the similarity, all of which are exact bounds; and a long list is dealt
in blocks. So the sweeps have a reach but the search as a whole has none.

Defined results: null, empty or wordless text has an empty set, is linked with nothing and kept; a text with fewer words than
a shingle is one shingle; rows of equal doc_id are one document as a name, null doc_ids name no component (component null
unless another document has the set) and are kept; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .components import connected_components

TREES = 24
DEPTH = 6
MIN_DEPTH = 3
REACH = 8
#: Neighbours in the first sweep, which has to bring close copies together; the second looks past them.
FIRST_REACH = 2
MEMO_WORDS = 500_000
#: 64-bit words of parity bits of a set.
BITS = 16
#: Rows of one shingle's list that a task holds against each other.
LIST_BLOCK = 2000
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, TREES * DEPTH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles, with a bounded memo of word hashes."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def _hash(self, word: bytes) -> int:
        import xxhash

        h = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def set_of(self, text: bytes | None) -> np.ndarray:
        # bytes.lower() changes A-Z only, and bytes.split() splits at \x20 and \x09-\x0D only
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        get, make = self.memo.get, self._hash
        h = np.array([get(w) or make(w) for w in words], np.uint64)
        size = min(self.size, len(words))
        out = h[: len(h) - size + 1]
        for k in range(1, size):
            out = _mixed(out) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        return np.unique(_mixed(out + np.uint64(size)))


def signature(shingles: np.ndarray) -> bytes:
    """TREES x DEPTH min-hashes of 32 bits, big-endian, so that bytes sort as numbers do."""
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _MULTIPLIERS).min(0), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def parity(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 * BITS buckets hold an odd number of shingles: sets that differ in k shingles differ in at most k bits."""
    odd = np.bincount((shingles & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bits): set_key is a 128-bit digest of the set, null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            n, keys, sigs, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler.set_of(text)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
                bits.append(parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "sig", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, bits array<long>")


def first_sweep(nodes: DataFrame, percent: int, reach: int) -> DataFrame:
    """One pass over all trees of nodes (id, n, sig). Rows are of two kinds:

    - candidate pairs (a, b), a < b, once a tree; pairs whose set sizes rule the similarity out are left out;
    - members (tree, region, id) of each region with two nodes or more in the partition, or cut by its border; a region that a
      partition begins or ends with also has a row with null id.
    """
    width = DEPTH * 4
    trees = nodes.select("id", "n", F.posexplode(F.array(*[F.substring("sig", t * width + 1, width) for t in range(TREES)])).alias("tree", "key"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "id"]
    names = ["a", "b", "tree", "region", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = MIN_DEPTH * 4
        region: tuple | None = None
        last: list[tuple[int, int]] = []  # the region's latest rows
        alone = None  # the region's only row so far
        begun = False

        def batch_of(pairs: list[tuple], members: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*pairs) if pairs else ((), ())
            tree, key, i = zip(*members) if members else ((), (), ())
            p, m = len(a), len(i)
            return pa.RecordBatch.from_arrays(
                [pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), pa.array([*[None] * p, *tree], pa.int32()), pa.array([*[None] * p, *key], pa.binary()), pa.array([*[None] * p, *i], pa.int64())],
                names=names,
            )

        for batch in batches:
            pairs: list[tuple] = []
            members: list[tuple] = []
            for tree, key, i, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "key", "id", "n"))):
                own = (tree, key[:lead])
                if own != region:
                    if not begun:
                        begun = True
                        members += [(*own, None), (*own, i)]
                        alone = None
                    else:
                        alone = i
                    region, last = own, [(i, n)]
                    continue
                if alone is not None:
                    members.append((*own, alone))
                    alone = None
                members.append((*own, i))
                pairs += [(min(i, j), max(i, j)) for j, m in last if i != j and 100 * min(n, m) >= percent * max(n, m)]
                last = [*last, (i, n)][-reach - 1 :]
            yield batch_of(pairs, members)
        if begun:
            yield batch_of([], [(*region, None)] + ([(*region, alone)] if alone is not None else []))

    return trees.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, tree int, region binary, id long")


def regions_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, region, size, cut) of the regions whose nodes are of several components."""
    rows = members.join(nodes.select("id", "component"), "id", "left")
    all_ = rows.groupBy("tree", "region").agg(F.count("id").alias("size"), F.max(F.col("id").isNull()).alias("cut"), (F.min("component") < F.max("component")).alias("mixed"))
    return all_.filter("mixed").drop("mixed")


def next_sweep(members: DataFrame, nodes: DataFrame, percent: int, reach: int = REACH) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the members (tree, region, id): each node and the nearest one of each of `reach` other components.

    Pairs that sizes or parity bits rule out are left out.
    """
    width, lead = DEPTH * 4, MIN_DEPTH * 4
    key = F.substring("sig", F.col("tree") * width + 1, F.lit(width))
    rows = members.filter("id IS NOT NULL").select("tree", "id").join(nodes.select("id", "n", "component", "sig", "bits"), "id").select("tree", key.alias("key"), "id", "n", "component", "bits")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd: dict[int, tuple[int, int, int]] = {}  # of the region: last row by component, latest last
        prefix: tuple | None = None
        size = 8 * BITS
        for batch in batches:
            a, b = [], []
            raw = batch.column("bits").flatten().to_numpy().tobytes()
            for k, (tree, key, i, n, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "key", "id", "n", "component")))):
                bits = int.from_bytes(raw[k * size : k * size + size], "little")
                if (tree, key[:lead]) != prefix:
                    prefix = (tree, key[:lead])
                    crowd.clear()
                elif crowd:
                    for c, (j, m, other) in list(reversed(crowd.items()))[: reach + 1]:
                        if c != comp and 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * (n + m - (bits ^ other).bit_count()) >= 2 * percent * (n + m):
                            a.append(min(i, j))
                            b.append(max(i, j))
                    crowd.pop(comp, None)
                crowd[comp] = (i, n, bits)
                if len(crowd) > 4 * reach:
                    for old in list(crowd)[: 2 * reach]:
                        del crowd[old]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * |intersection| >= percent * |union|."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        last, last_set = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb"))):
                if b != last:  # rows come sorted by b from the join
                    last, last_set = b, shingler.set_of(tb)
                s = shingler.set_of(ta)
                common = len(np.intersect1d(s, last_set, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(last_set) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def crowded_pairs(crowd: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components that can reach the similarity, among nodes (id, component, set_key, bits), found exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for i, component, key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "component", "set_key", "text"))):
                found = shingler.set_of(text)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() != key:
                    continue  # another text of the same doc_id
                same = (int.from_bytes(key[:8], "big", signed=True), i, component, len(found))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(found), x, np.int64)) for x in same), pa.array(found.view(np.int64))], names=["node", "id", "component", "n", "h"])

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    sets = stored(crowd.select("id", "component", "set_key").join(texts, "id").mapInArrow(run, "node long, id long, component long, n long, h long"), "crowd-sets")
    lists = sets.groupBy("h").agg(F.count("*").alias("f"), (F.min("component") < F.max("component")).alias("mixed"))
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy("mixed", "f", "h"))  # dense: repeated rows count once
    first = sets.join(lists, "h").withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("mixed"))
    first = first.select("h", "id", "component", "n", "rank", F.ceil(F.col("f") / LIST_BLOCK).cast("int").alias("blocks"))
    first = stored(first.join(crowd.select("id", "bits").dropDuplicates(["id"]), "id"), "crowd-lists")
    left = first.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = first.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("rank").alias("place"), F.col("bits").alias("bits_b"))
    both = F.col("n") + F.col("m")
    unequal = F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0]))
    for k in range(1, BITS):
        unequal = unequal + F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k]))
    near = (
        (F.col("id") < F.col("b"))
        & (F.col("component") != F.col("other"))
        & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        & ((100 + percent) * (1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place"))) >= percent * both)
        & ((100 + percent) * (both - unequal) >= 2 * percent * both)
    )
    pairs = stored(left.join(right, ["h", "block"]).filter(near).select(F.col("id").alias("a"), "b").distinct(), "pairs")
    for t in (sets, first):
        drop_stored(t)
    return pairs


def joined(nodes: DataFrame, pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """`nodes` with the components that confirmed `pairs` join made one; what is joined is components, so a group known already is one node.

    The tables of `nodes` and `pairs` are removed.
    """
    links = stored(confirmed(pairs, docs, shingle, percent), "links")
    of = nodes.select("id", "component")
    ends = links.join(of.withColumnsRenamed({"id": "a", "component": "ca"}), "a").join(of.withColumnsRenamed({"id": "b", "component": "cb"}), "b")
    comps = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = comps.select(F.col("id").alias("component"), F.col("component").alias("merged"))
    out = stored(nodes.join(merged, "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged"), "labels")
    for t in (links, nodes, pairs):
        drop_stored(t)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, reach: int = REACH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`."""
    how = (docs, shingle, percent)
    sigs = stored(signatures(docs, shingle), "signatures")
    nodes = sigs.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(k) for c, k in (("n_shingles", "n"), ("sig", "sig"), ("bits", "bits"))])
    nodes = stored(nodes.withColumn("component", F.col("id")), "nodes")
    first = min(FIRST_REACH, reach)
    swept = stored(first_sweep(nodes, percent, first), "sweep")
    nodes = joined(nodes, stored(swept.filter("a IS NOT NULL").select("a", "b").distinct(), "pairs"), *how)
    members = swept.filter("a IS NULL").select("tree", "region", "id")
    mixed = stored(members.join(regions_of(members, nodes), ["tree", "region"]), "mixed")
    nodes = joined(nodes, stored(next_sweep(mixed, nodes, percent, reach), "pairs"), *how)
    left = regions_of(mixed.select("tree", "region", "id"), nodes).filter((F.col("size") > first + 2) | F.col("cut"))
    ids = mixed.join(left.select("tree", "region"), ["tree", "region"], "left_semi").filter("id IS NOT NULL").select("id").distinct()
    crowd = stored(nodes.join(ids, "id", "left_semi").select("id", "component", "set_key", "bits"), "crowd")
    nodes = joined(nodes, crowded_pairs(crowd, *how), *how)
    for t in (swept, mixed, crowd):
        drop_stored(t)
    out = sigs.select("doc_id", "n_shingles", "set_key").join(nodes.select("set_key", "component"), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each group of near duplicates: the one with the smallest doc_id. Null doc_ids stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), **how).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
