"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches of falling doc_id. A batch is reduced to one row per line key (128-bit hash, number of documents,
largest doc_id); a merge anti-join drops the keys that the runs have settled already (found in `min_docs` documents, so their
largest holder is known), and the rest becomes the batch's own sorted run on level 0. As soon as a level has `fanout` runs
they are merged into one run of the next level. At the end the runs tell which keys lose their lines, and where.

Only DataFrame functions are used. One key may be in any number of documents: counts are summed in the map tasks first. A key with
more than one in `HOT_SHARE` of all rows has a `batches`-th of that in some batch; such a batch's count is kept in its run even where
the key is settled already. So the runs tell every frequent key, fewer than `HOT_SHARE * batches` of them, however rare it was in the
first batches; these are broadcast to the lines, and no task gets all rows of one. All other settled keys meet their lines in a
shuffled join.

Defined results: null or empty text is one empty line; equal doc_ids count as one holder id but as several documents; a null
doc_id is below all others and never the one that keeps a line found elsewhere; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, let, packed, stored, table, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: A settled key with more than one in so many of all rows is broadcast, whatever batches it is in.
HOT_SHARE = 10_000
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped, A-Z lower-cased. For pure ASCII lower() does just that, and much faster."""
    key = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the distinct keys of each document; two differently seeded hashes make 128 bits."""
    long_lines = F.filter(split_lines(F.col("text")), lambda x: F.length(x) >= min_chars)
    keys = F.array_distinct(F.filter(F.transform(long_lines, line_key), lambda k: F.length(k) >= min_chars))
    return docs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", _hash(F.col("k")).alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


class LineRuns:
    """The runs, by level; each is a stored table (h1, h2, n, top) sorted by hash within hash partitions."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT, often: int = 2**62):
        """`often`: a key with more documents than this in one batch keeps that count, settled or not."""
        self.min_docs, self.fanout, self.often = min_docs, fanout, often
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _sorted_run(rows: DataFrame, level: int) -> DataFrame:
        return stored(rows.sortWithinPartitions("h1", "h2"), f"line-run-{level}")

    def add(self, keys: DataFrame) -> None:
        """A batch of (doc_id, h1, h2), all of whose doc_ids are below those of earlier batches."""
        rows = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        new, often = rows.filter(F.col("n") <= self.often), rows.filter(F.col("n") > self.often)
        for run in self._all():
            settled = run.filter(F.col("n") >= self.min_docs).select("h1", "h2")
            new = new.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(self._sorted_run(new.unionByName(often), 0), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._put(self._sorted_run(merged, level + 1), level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def settled(self) -> DataFrame:
        """(h1, h2, n, top) of the keys found in `min_docs` documents or more; n is a key's documents up to the batch that settled it, and of further batches that hold it often."""
        return self._merge(self._all()).filter(F.col("n") >= self.min_docs)


def lost_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, fanout: int = FANOUT, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, lost): the h1 hashes of the lines that each document loses; only documents that lose some."""
    keys = stored(document_keys(docs, min_chars), "line-keys")
    low, high, total = keys.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"), F.count("*")).first()
    width = ((high - low) // batches + 1) if low is not None else 1
    number = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / F.lit(width)), F.lit(batches - 1))
    often = max(min_docs, total // (hot_share * batches))
    runs = LineRuns(min_docs, fanout, often)
    for b in range(batches):
        runs.add(keys.filter(number == b))
    settled = stored(runs.settled(), "line-settled")
    hot = F.col("n") > often
    d = keys.join(F.broadcast(settled.filter(hot).select("h1", "h2", F.struct("top").alias("hot"))), ["h1", "h2"], "left")
    met = d.filter("hot IS NOT NULL").select("doc_id", "h1", "hot.top")
    met = met.unionByName(d.filter("hot IS NULL").join(settled.filter(~hot), ["h1", "h2"]).select("doc_id", "h1", "top"))
    lost = met.filter(F.coalesce(F.col("doc_id") < F.col("top"), F.col("top").isNotNull()))
    return lost.groupBy("doc_id").agg(F.collect_set("h1").alias("lost"))


def with_kept_text(docs: DataFrame, **how) -> DataFrame:
    """`docs` with _kept_text, _n_lines and _n_dropped; its own columns of those names give way."""
    min_chars = how.get("min_chars", MIN_CHARS)
    lost = lost_lines(docs.select("doc_id", "text"), **how).select(F.col("doc_id").alias("_lost_id"), F.col("lost").alias("_lost"))
    docs = docs.drop("_kept_text", "_n_lines", "_n_dropped", "_lost_id", "_lost", "_kept")
    d = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")), "left").drop("_lost_id")
    lines = split_lines(F.col("text"))

    def stays(line: Column) -> Column:
        return ~let(line_key(line), lambda k: (F.length(k) >= min_chars) & F.array_contains(F.col("_lost"), _hash(k)))

    kept = F.when(F.col("_lost").isNull(), F.struct(text_or_empty(F.col("text")).alias("t"), F.lit(0).alias("n"))).otherwise(
        let(lines, lambda x: let(F.filter(x, stays), lambda y: F.struct(F.array_join(y, "\n").alias("t"), (F.size(x) - F.size(y)).alias("n"))))
    )
    d = d.withColumn("_kept", kept).withColumn("_n_lines", F.size(lines).cast("long"))
    return d.withColumns({"_kept_text": F.col("_kept.t"), "_n_dropped": F.col("_kept.n").cast("long")}).drop("_kept", "_lost")


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """`docs` with the lines dropped from text; n_chars, where there is one, follows. Null text stays null."""
    d = with_kept_text(packed(docs, "doc_id", "text"), **how)

    def column(c: str) -> Column:
        own = F.col("_whole")[c]
        if c == "text":
            own = F.when(F.col("text").isNotNull(), F.col("_kept_text"))
        elif c == "n_chars":
            own = F.when(F.col("text").isNotNull(), F.length("_kept_text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return d.select(*[column(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))
