"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the token windows of every document.

The benchmark's windows are collected only up to `max_windows` (a fixed bound, checked before collecting). Beyond it
`find_hits` joins hashed document windows with hashed benchmark windows instead, with nothing broadcast.

Defined results: null or wordless texts have no words and no hits; items without words never occur; repeated items
count once per item_id; columns of either table other than the named ones are ignored or carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, widened

#: Word characters are 0-9, a-z after lower-casing A-Z, and everything outside ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
MAX_WINDOWS = 2_000_000


def words(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text; multi-byte characters hold no ASCII byte, so bytes suffice."""
    return text.translate(_FOLD).split()


def item_windows(item_words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of `width` consecutive words; a shorter item that has words is one window."""
    if not item_words:
        return []
    n = min(width, len(item_words))
    return [tuple(item_words[i : i + n]) for i in range(len(item_words) - n + 1)]


class WindowSet:
    """Benchmark windows by their first word's id, for exact look-ups in token windows."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[str]] = {}
        for item_id, text in items:
            for w in item_windows(words(text), width):
                key = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w)
                held = self.windows.setdefault(key, [])
                if item_id not in held:
                    held.append(item_id)
        self.by_first: dict[int, list[int]] = {}
        for key in self.windows:
            sizes = self.by_first.setdefault(key[0], [])
            if len(key) not in sizes:
                sizes.append(len(key))

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) runs of hit words and the items found."""
        if self.ids.keys().isdisjoint(tokens):
            return [], set()
        get, sizes, windows = self.ids.get, self.by_first, self.windows
        seq = [get(x, 0) for x in tokens]
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        shortest = min(len(k) for k in windows)
        i, n = 0, len(seq)
        while i < n:
            if seq[i] == 0:
                i += 1
                continue
            end = i  # a stretch of words that the benchmark knows; only such stretches can hold a window
            while end < n and seq[end]:
                end += 1
            if end - i >= shortest:
                for at in range(i, end - shortest + 1):
                    for size in sizes.get(seq[at], ()):
                        if at + size <= end and (found := windows.get(tuple(seq[at : at + size]))):
                            items.update(found)
                            if runs and at <= runs[-1][1]:
                                runs[-1] = (runs[-1][0], max(runs[-1][1], at + size))
                            else:
                                runs.append((at, at + size))
            i = end
        return runs, items


_HITS = "n_words long, n_hit long, item_ids array<string>, hit_runs array<struct<start:int,end:int>>"


def benchmark_items(benchmark: DataFrame, width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> list[tuple[str, bytes]] | None:
    """The items as (id text, UTF-8 bytes), or None if they could hold more than `max_windows` windows (bounded by their bytes)."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    if ((b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) + 1) // 2 > max_windows:
        return None
    return [(r.i, r.t.encode()) for r in b.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` with n_words, n_hit, item_ids (sorted as strings) and hit_runs (runs of hit word positions); its own columns of those names give way."""
    items = benchmark_items(benchmark, width, max_windows)
    docs = docs.drop("n_words", "n_hit", "item_ids", "hit_runs")
    if items is None:
        return _find_hits_joined(docs, benchmark, width)
    held = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(held.value, width)
        for batch in batches:
            n_words, n_hit, ids, runs = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tokens = words(text or b"")
                r, items = known.scan(tokens)
                n_words.append(len(tokens))
                n_hit.append(sum(e - s for s, e in r))
                ids.append(sorted(items))
                runs.append([{"start": s, "end": e} for s, e in r])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*batch.schema.names, "n_words", "n_hit", "item_ids", "hit_runs"],
            )

    return docs.mapInArrow(scan, widened(docs.schema, _HITS))


def _words_column(text):
    """The same words by column functions, for the joined path."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _find_hits_joined(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """For benchmarks over the bound: windows of both sides meet by a shuffled join on their text, one row per window and document."""
    from .common import stored

    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-docs")
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"), _words_column(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    b = b.withColumn("_n", F.least(F.size("_w"), F.lit(width)))
    b = b.select("_item", "_n", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)).alias("_p"), "_w")
    b = b.select("_item", "_n", F.concat_ws(" ", F.slice("_w", F.col("_p"), F.col("_n"))).alias("_win"))
    sizes = b.select("_n").distinct().groupBy().agg(F.collect_set("_n")).first()[0]  # at most `width` values
    d = keyed.select("_row", _words_column(F.col("text")).alias("_w"))

    def windows(n: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return d.filter(F.size("_w") >= n).select("_row", F.lit(n).alias("_n"), F.posexplode(F.transform(at, lambda p: F.concat_ws(" ", F.slice("_w", p, n)))).alias("_p", "_win"))

    parts = [windows(n) for n in sizes]
    if not parts:
        return keyed.select("*", F.size(_words_column(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:int,end:int>>").alias("hit_runs")).drop("_row")
    wins = parts[0]
    for p in parts[1:]:
        wins = wins.unionByName(p)
    hit = wins.join(b.select("_n", "_win").distinct(), ["_n", "_win"], "left_semi")
    found = hit.select("_row", "_n", "_win").distinct().join(b.distinct(), ["_n", "_win"]).groupBy("_row").agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))
    runs = hit.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.col("_p").alias("start"), (F.col("_p") + F.col("_n")).alias("end")))).alias("_r"))
    merged = F.aggregate(
        "_r",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    runs = runs.select("_row", merged.alias("hit_runs"))
    out = keyed.join(found, "_row", "left").join(runs, "_row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.size(_words_column(F.col("text"))).cast("long").alias("n_words"),
        F.aggregate(F.coalesce("hit_runs", none), F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("hit_runs", none).alias("hit_runs"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, **how) -> DataFrame:
    """`docs` without the documents whose hit words exceed `max_hit_share` of their words; all else unchanged."""
    hits = find_hits(packed(docs, "text"), benchmark, **how)
    return hits.filter(~(F.col("n_hit") > F.col("n_words") * F.lit(max_hit_share))).select("_whole.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
