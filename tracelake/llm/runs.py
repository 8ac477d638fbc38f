"""Periodic runs: stretches of words that repeat with one period, found by comparing the word ids with every shift of themselves.

A document's words become ids; the ids are compared with themselves at each lag q up to n / min_exp, and the true stretches are
run-length coded. A stretch that counts is at least `(min_exp - 1) * q` positions long, so it holds one of every so many positions:
only those are compared at first, all lags in one vectorised pass, and the ends are sought where a stretch can be. What comes out is
what the whole comparison gives. Long documents are dealt out as ranges of lags, each to a task of its own, and their runs meet again
in a join; a run's multiples of its period have its very ends, so the least lag of equal ends is the period.

Defined results: null or empty texts have no word and no run; a null doc_id is a document like others; repeated rows give equal
results; one word repeated for megabytes is one run; other columns pass, and own columns named like the added ones give way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import packed, stored, table, text_or_empty

MIN_EXP = 4
MIN_LENGTH = 6
#: UTF-8 bytes of text for each range of lags: longer documents are dealt out as several ranges.
RANGE_BYTES = 8_000_000
#: Compared positions held at once, and known runs against which multiples of their periods are held.
_PROBES, _KNOWN, _FIRST_LAGS = 262_144, 32, 64

Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))


def _reach(ids: np.ndarray, p: int, q: int, way: int) -> int:
    """How many positions from p on, to the right (way 1) or left of it (way -1), equal the ones q further."""
    n, done, step = len(ids) - q, 0, 64
    while True:
        lo, hi = (p + done, min(n, p + done + step)) if way > 0 else (max(0, p - done - step), p - done)
        if lo >= hi:
            return done
        odd = np.flatnonzero(ids[lo:hi] != ids[lo + q : hi + q])
        if len(odd):
            return done + int(odd[0] if way > 0 else hi - lo - 1 - odd[-1])
        done += hi - lo
        step *= 2


def _candidates(ids: np.ndarray, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, lag, need) where a stretch of `need` positions or more may be: every need-th position, then eight more on one side."""
    n = len(ids)
    count = (n - q) // need
    lag, step = np.repeat(q, count), np.repeat(need, count)
    at = (np.arange(len(lag)) - np.repeat(np.cumsum(count) - count, count) + 1) * step - 1
    met = np.flatnonzero(ids[at] == ids[at + lag])
    at, lag, step = at[met], lag[met], step[met]
    half = (step - 1) // 2
    right, left = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, 9):
        ahead, back = at + half * k // 8, at - half * k // 8
        right &= (ahead < n - lag) & (ids[np.minimum(ahead, n - lag - 1)] == ids[np.minimum(ahead + lag, n - 1)])
        left &= (back >= 0) & (ids[np.maximum(back, 0)] == ids[np.maximum(back, 0) + lag])
    keep = right | left
    return at[keep], lag[keep], step[keep]


def runs_of(ids: np.ndarray, low: int = 1, high: int | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[Run]:
    """(start, length, period) of the runs whose period lies in [low, high), by start and period; with every lag from 1 on, all runs.

    For a range of lags that starts above 1, a period may be a multiple of the true one: `merged` puts that right.
    """
    n = len(ids)
    last = n // min_exp + 1
    high = last if high is None else min(high, last)
    found: dict[tuple[int, int], int] = {}
    # A range above the first lags finds those first, so that their multiples need no look.
    spans = [(1, min(low, _FIRST_LAGS, last))] if low > 1 else []
    a = low
    while a < high:
        # the positions compared for one lag are n / ((min_exp - 1) * lag)
        b = min(high, _FIRST_LAGS) if a < _FIRST_LAGS else min(high, a + max(1, _PROBES * (min_exp - 1) * a // n))
        spans.append((a, b))
        a = b
    for a, b in spans:
        q = np.arange(a, b, dtype=np.int64)
        need = np.maximum(min_length - q, (min_exp - 1) * q)
        p, lag, step = _candidates(ids, q, np.maximum(need, 1))
        for start, end, period in sorted(((s, e, k) for (s, e), k in found.items()), key=lambda r: r[0] - r[1])[:_KNOWN]:
            if len(p):
                keep = (p < start) | (p >= end - lag) | (lag % period != 0)
                p, lag, step = p[keep], lag[keep], step[keep]
        before, beyond = 0, 0
        for x, k, least in zip(p.tolist(), lag.tolist(), step.tolist()):
            if k == before and x < beyond:
                continue
            start, before, beyond = x - _reach(ids, x, k, -1), k, x + _reach(ids, x, k, 1)
            if beyond - start >= least:
                found.setdefault((start, beyond + k), k)
    return merged([(s, e - s, k) for (s, e), k in found.items()])


def merged(runs: list[Run]) -> list[Run]:
    """Of runs with equal ends the one with the least period, all sorted by start and period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, as an exact fraction; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: of each run only its first period stays, unless another run repeats that too."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist()) if not x]


#: What turns a document's id and words into the words to look at.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _words(rewrite: Rewrite | None, doc_id: int | None, text: bytes | None) -> list[bytes]:
    words = (text or b"").split()
    return rewrite(doc_id, words) if rewrite and words else words


def _ranges(bytes_: Column, range_bytes: int) -> Column:
    return F.ceil(bytes_ / F.lit(range_bytes)).cast("int")


def lag_range(n: int, part: int, parts: int, min_exp: int = MIN_EXP) -> tuple[int, int]:
    """The part-th of `parts` ranges of lags of n words. A lag costs about n / lag, so the borders grow by equal factors."""
    last = n // min_exp + 1
    border = [1] + [max(1, round(last ** (k / parts))) for k in range(1, parts)] + [max(last, 1)]
    return border[part], border[part + 1]


def with_runs(docs: DataFrame, each: Callable, added: str, rewrite: Rewrite | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`docs` (a doc_id, a text, any more) with the columns `added` (DDL) that `each(words, runs)` gives for every document."""
    docs = docs.drop(*StructType.fromDDL(added).names)
    size = F.octet_length(text_or_empty(F.col("text")))
    d = packed(docs, "doc_id", "text").select("_whole", F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_bytes"), size.alias("_size"))
    schema = StructType([d.schema["_whole"], *StructType.fromDDL(added).fields])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def results(batch: pa.RecordBatch, runs: list) -> pa.RecordBatch:
        rows = []
        for doc_id, text, known in zip(batch.column("_id").to_pylist(), batch.column("_bytes").to_pylist(), runs):
            words = _words(rewrite, doc_id, text)
            rows.append(each(words, runs_of(word_ids(words)) if known is None else known))
        names = [f.name for f in schema.fields[1:]]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), arrow)]
        return pa.RecordBatch.from_arrays([batch.column("_whole"), *columns], names=["_whole", *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield results(batch, [None] * batch.num_rows)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = word_ids(_words(rewrite, row["_id"], row["_bytes"]))
                runs = runs_of(ids, *lag_range(len(ids), row["_part"], row["_parts"]))
                yield pa.RecordBatch.from_pylist([{"_row": row["_row"], "start": s, "length": n, "period": p} for s, n, p in runs], pa.schema([(c, pa.int64()) for c in ("_row", "start", "length", "period")]))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield results(batch, [merged([(r["start"], r["length"], r["period"]) for r in x or []]) for x in batch.column("_runs").to_pylist()])

    out = d.filter(F.col("_size") <= range_bytes).drop("_size").mapInArrow(short, schema)
    # Written once, so that the row numbers hold whichever executor reads them.
    large = stored(d.filter(F.col("_size") > range_bytes).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    parts = large.withColumn("_parts", _ranges(F.col("_size"), range_bytes)).select("_row", "_id", "_bytes", "_parts", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    runs = parts.repartition("_row", "_part").mapInArrow(part, "_row long, start long, length long, period long")
    runs = runs.groupBy("_row", "start", "length").agg(F.min("period").alias("period")).groupBy("_row").agg(F.collect_list(F.struct("start", "length", "period")).alias("_runs"))
    large = large.join(runs, "_row", "left").select("_whole", "_id", "_bytes", "_runs").mapInArrow(long, schema)
    return out.unionByName(large).select("_whole.*", *StructType.fromDDL(added).names)


def collapse_runs(docs: DataFrame, **how) -> DataFrame:
    """`docs` with runs (start, length and period in words) and collapsed_text (words joined by one space; only a run's first period stays)."""

    def each(words: list[bytes], runs: list[Run]) -> tuple:
        return [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    return with_runs(docs, each, "runs array<struct<start:long,length:long,period:long>>, collapsed_text string", **how)


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    best = strongest(runs)
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), *own, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's tails: in a tenth of all documents, told by crc32 of the id, the words from some place on repeat with a period. Null ids keep theirs."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_runs(docs, digest, DIGEST, planted).drop("text")
