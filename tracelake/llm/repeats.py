"""Suffix-array dedup of byte strings by depth-limited radix passes.

Wanted is every start whose next `LENGTH` bytes also start elsewhere. Sorting all suffixes would move every byte of the corpus
many times, so the radix passes run over groups of neighbouring starts. The anchor of a start is the leftmost position of the
smallest hash of `GRAM` bytes among the grams inside its window: equal windows have their anchors at equal offsets. Neighbouring
starts with one anchor form a node. The most significant digit of a node is its anchor gram; a gram met once ends all its
starts. Later digits take in the bytes around the anchor for ever narrower offset ranges (all, then 16, then 1):

- nodes whose whole strings (all bytes of all their windows) are equal are settled: all their starts repeat (neighbours in a run of
  one byte or a short period are one row from the start, however long the run);
- a range whose common bytes (those in every window of it) are met once has no repeats;
- what is left is split to the next narrower range, together with one witness of each settled class it might still match.

The last pass compares whole windows, so its equal groups are exactly the repeated ones. Strings are compared by two 64-bit
hashes that both cover them (gram and string). Groups are only ever counted, never gathered, so a passage in any number of
documents is no burden; what is gathered per document are its own spans.

Defined results: null text is no bytes; matches do not cross documents but may overlap in one; rows equal in doc_id and text
repeat each other; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_stored, packed, stored, table

LENGTH = 200
STARTS = 128  # grams in a window
GRAM = LENGTH - STARTS + 1
RANGE = 16
#: Bytes hashed at once; longer documents go in overlapping segments.
BLOCK = 1 << 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW = _U((1 << 24) - 1)
_BYTES = np.random.default_rng(73).integers(0, 2**63, 256, np.int64).astype(np.uint64) * _U(2) + _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, _U(base % 2**64))
    p[0] = _U(1)
    return np.cumprod(p, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of a byte buffer from prefix sums."""

    _up = _powers(_BASE, 1)
    _down = _powers(pow(_BASE, -1, 2**64), 1)

    def __init__(self, data: np.ndarray):
        if len(self._up) <= len(data):
            Hashes._up = _powers(_BASE, len(data) + BLOCK // 4)
            Hashes._down = _powers(pow(_BASE, -1, 2**64), len(data) + BLOCK // 4)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self._up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mixed((self.sums[GRAM:] - self.sums[:n]) * self._down[:n] + _U(GRAM))


def anchored(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of a buffer of texts [begin, end): (text, first start, last start, anchor, gram hash, string hash, last anchor, nodes).

    Neighbouring nodes with equal strings around their anchors, as a run of one byte or of a short period has at every place, are one
    row: the first of them, the last one's anchor and how many they are. Their starts follow each other without a gap.
    """
    hashes = Hashes(data)
    gram = hashes.grams()
    low = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < STARTS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    anchor = (low & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(begins)), np.maximum(ends - begins - LENGTH + 1, 0))
    offset = np.arange(len(text)) - np.repeat(np.cumsum(np.bincount(text, minlength=len(begins))) - np.bincount(text, minlength=len(begins)), np.bincount(text, minlength=len(begins)))
    start = begins[text] + offset
    a = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(a)) - 1
    lo, hi, at = start[first], start[last], a[first]
    rows = (text[first], lo, hi, at, gram[at], hashes.of(lo, hi + LENGTH))
    told = (rows[0], at - lo, at - hi, rows[4], rows[5])
    new = np.flatnonzero(np.concatenate([[True] * bool(len(at)), np.any([x[1:] != x[:-1] for x in told], axis=0)])) if len(at) else first
    end = np.append(new[1:], len(at)) - 1 if len(at) else new
    return *[x[new] for x in rows], at[end], end - new + 1


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about BLOCK bytes: (texts' numbers, data, begins, ends, offset of each piece in its text)."""
    numbers, pieces, offsets, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), BLOCK):
            piece = t[at : at + BLOCK + LENGTH - 1]
            numbers.append(i)
            pieces.append(piece)
            offsets.append(at)
            size += len(piece)
            if size >= BLOCK:
                yield _joined(numbers, pieces, offsets)
                numbers, pieces, offsets, size = [], [], [], 0
    if pieces:
        yield _joined(numbers, pieces, offsets)


def _joined(numbers, pieces, offsets):
    ends = np.cumsum([len(p) for p in pieces])
    return numbers, np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.array(offsets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with k1, k2: equal for rows equal in doc_id and text only."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "k2": F.xxhash64("text")})


def _nodes(keyed: DataFrame) -> DataFrame:
    """(k1, k2, m, r, h, s, e, n): anchor position, offset range r1 * 256 + r2 of its starts before it, hashes of gram and string; for `n`
    equal neighbours in one row, the last one's anchor is `e`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for numbers, data, begins, ends, offsets in _segments([t or b"" for t in batch.column("text").to_pylist()]):
                piece, lo, hi, at, gram, string, end, n = anchored(data, begins, ends)
                row, shift = np.array(numbers)[piece], offsets[piece] - begins[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(at + shift), pa.array(((at - hi) * 256 + (at - lo)).astype(np.int32)), _signed(gram), _signed(string), pa.array(end + shift), pa.array(n)],
                    names=["k1", "k2", "m", "r", "h", "s", "e", "n"],
                )

    return keyed.select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(run, "k1 long, k2 long, m long, r int, h long, s long, e long, n long")


def _ranges(seeded: DataFrame) -> DataFrame:
    """From texts with their seeds (m, r, h, settled): rows for each range of RANGE offsets, with the hash of its common bytes and of its whole string, and the bytes."""
    schema = "k1 long, k2 long, m long, d int, r int, h long, settled boolean, c long, s long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, seeds in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "seeds"))):
                m = np.array([x["m"] for x in seeds], np.int64)
                r = np.array([x["r"] for x in seeds], np.int64)
                h = np.array([x["h"] for x in seeds], np.int64)
                settled = np.array([x["settled"] for x in seeds], bool)
                r1, r2 = r // 256, r % 256
                d0, d1 = r1 // RANGE, r2 // RANGE
                n = d1 - d0 + 1
                i = np.repeat(np.arange(len(m)), n)
                d = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + d0[i]
                a, b = np.maximum(d * RANGE, r1[i]), np.minimum(d * RANGE + RANGE - 1, r2[i])
                lo, hi = m[i] - b, m[i] - a + LENGTH
                common, whole, data = _local_hashes(text, m[i] - d * RANGE, m[i] - d * RANGE - RANGE + 1 + LENGTH, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), k1)), pa.array(np.full(len(i), k2)), pa.array(m[i]), pa.array(d.astype(np.int32)), pa.array((a * 256 + b).astype(np.int32)), pa.array(h[i]), pa.array(settled[i]), _signed(common), _signed(whole), pa.array(data, pa.binary())],
                    names=["k1", "k2", "m", "d", "r", "h", "settled", "c", "s", "bytes"],
                )

    return seeded.mapInArrow(run, schema)


def _local_hashes(text: bytes, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Hashes of text[a:b] and text[lo:hi], and the latter's bytes; text far from all of them is left out of the sums."""
    left, right = int(min(lo.min(), a.min())), int(max(hi.max(), b.max()))
    if right - left <= 4 * BLOCK:
        hashes = Hashes(np.frombuffer(text[left:right], np.uint8))
        return hashes.of(a - left, b - left), hashes.of(lo - left, hi - left), [text[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
    parts = [_local_hashes(text, a[k], b[k], lo[k], hi[k]) for k in np.array_split(np.arange(len(a)), 2)]
    return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]]), parts[0][2] + parts[1][2]


def _windows(rows: DataFrame) -> DataFrame:
    """One row for each start of a range: (k1, k2, start, h, o, settled, w) with the window's hash."""
    o = F.explode(F.sequence((F.col("r") / 256).cast("int"), F.col("r") % 256))
    d = rows.select("k1", "k2", "m", "h", "settled", "bytes", (F.col("r") % 256).alias("_top"), o.alias("o"))
    return d.select("k1", "k2", (F.col("m") - F.col("o")).alias("lo"), "h", "o", "settled", F.xxhash64(F.substring("bytes", F.col("_top") - F.col("o") + 1, F.lit(LENGTH))).alias("w"))


def _spans(rows: DataFrame, end: str = "m") -> DataFrame:
    """Settled nodes as byte spans [lo, hi); `end`: the anchor of the last of them."""
    return rows.select("k1", "k2", (F.col("m") - F.col("r") % 256).alias("lo"), (F.col(end) - (F.col("r") / 256).cast("int") + LENGTH).alias("hi"))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): byte spans that together cover just the bytes in repeated windows. `keyed` has k1, k2, text."""
    nodes = stored(_nodes(keyed), "nodes")
    again = nodes.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    live = stored(nodes.join(again, "h", "left_semi"), "live-nodes")
    drop_stored(nodes)
    node = F.struct("k1", "k2", "m")
    classes = stored(live.groupBy("h", "r", "s").agg(F.sum("n").alias("n"), F.min(node).alias("one")), "node-classes")
    settled = classes.filter("n > 1").select("h", "r", "s")
    spans = [_spans(live.join(settled, ["h", "r", "s"]), "e")]

    open_grams = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1").select("h")
    seeds = classes.join(open_grams, "h", "left_semi").select("one.k1", "one.k2", F.struct("one.m", "r", "h", (F.col("n") > 1).alias("settled")).alias("seed"))
    seeds = seeds.groupBy("k1", "k2").agg(F.collect_list("seed").alias("seeds"))
    texts = keyed.select("k1", "k2", F.col("text").cast("binary").alias("text"))
    ranges = stored(_ranges(texts.join(seeds, ["k1", "k2"]).select("k1", "k2", "text", "seeds")), "ranges")
    # Rows equal in doc_id and text each bring their seeds; one of them stands for all.
    level = ranges.groupBy("h", "d", "c", "r", "s").agg(F.countDistinct("k1", "k2", "m").alias("n"), F.max("settled").alias("settled"), F.min(node).alias("one"))
    level = stored(level, "range-classes")
    spans.append(_spans(ranges.filter(~F.col("settled")).join(level.filter("n > 1").select("h", "d", "c", "r", "s"), ["h", "d", "c", "r", "s"])))

    is_open = (F.col("n") == 1) & ~F.col("settled")
    groups = level.groupBy("h", "d", "c").agg(F.count("*").alias("k"), F.max(is_open).alias("open")).filter("k > 1 AND open").select("h", "d", "c")
    left = level.join(groups, ["h", "d", "c"], "left_semi").select("h", "d", "r", "s", "one.k1", "one.k2", "one.m", (~is_open).alias("done"))
    bytes_of = ranges.select("k1", "k2", "m", "d", "r", "bytes").dropDuplicates(["k1", "k2", "m", "d", "r"])
    single = _windows(left.join(bytes_of, ["k1", "k2", "m", "d", "r"]).withColumn("settled", F.col("done")))
    single = stored(single, "windows")
    twice = single.groupBy("h", "o", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "o", "w")
    last = single.filter(~F.col("settled")).join(twice, ["h", "o", "w"], "left_semi")
    spans.append(last.select("k1", "k2", "lo", (F.col("lo") + LENGTH).alias("hi")))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame) -> DataFrame:
    """`docs` with k1, k2 and removed: an array of (lo, hi) byte spans, not merged; null if none."""
    keyed = with_key(docs)
    spans = repeated_spans(keyed.select("k1", "k2", "text"))
    removed = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("removed"))
    return keyed.join(removed, ["k1", "k2"], "left")


def _cut(text: bytes | None, removed: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    text = text or b""
    runs = merged([(x["lo"], x["hi"]) for x in removed or ()])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    return runs, b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with kept_bytes (binary, what is left of the UTF-8 text; spans may cut a character) and removed_spans; own columns of those names give way."""
    docs = docs.drop("kept_bytes", "removed_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t, r) for t, r in zip(batch.column("_bytes").to_pylist(), batch.column("removed").to_pylist())]
            spans = pa.array([[{"lo": a, "hi": b} for a, b in r] for r, _ in cut], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("_whole"), pa.array([k for _, k in cut], pa.binary()), spans], names=["_whole", "kept_bytes", "removed_spans"])

    d = with_spans(packed(docs, "doc_id", "text")).select("_whole", F.col("text").cast("binary").alias("_bytes"), "removed")
    schema = StructType([d.schema["_whole"], *StructType.fromDDL("kept_bytes binary, removed_spans array<struct<lo:long,hi:long>>").fields])
    return d.mapInArrow(run, schema).select("_whole.*", "kept_bytes", "removed_spans")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
                runs, kept = _cut(text, removed)
                out.append((len(text or b""), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = with_spans(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "removed")
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

