"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text as the verdict.

Word unigrams and bigrams hash into `buckets` counters. The raw multinomial counts every document; the trusted one counts a
bounded sample of documents labelled quality 1 (`trusted_docs`, by lowest hash of doc_id). A bucket's weight is
ln((t + prior) / (e + prior)), with t its trusted count and e the count expected from the raw share; a document's ratio is the
sum of its n-grams' weights over their number plus `length_prior`, and it is kept from `threshold` on. All of it is
deterministic, and only DataFrame functions are used.

Defined results: null text has no words; without words every count is 0 and the base rules fail; without trusted labels all
weights are 0; rows with null labels or null doc_id are never trusted; repeated rows are judged alike; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, packed, stored, table, text_or_empty

BUCKETS = 65536
TRUSTED_DOCS = 20_000
PRIOR = 20.0
LENGTH_PRIOR = 16
THRESHOLD = -0.05
WINDOW = 5
_BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text_or_empty(text), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(hashes: Column) -> Column:
    """The hashes of neighbouring words together, one fewer than words; a filter pushed down may bring an expression in place of a column."""

    def pairs(hs: Column) -> Column:
        return F.slice(F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + 1))), F.lit(1), F.greatest(F.size(hs) - 1, F.lit(0)))

    return let(hashes, pairs)


def _bucket(h: Column, buckets: int) -> Column:
    """The remainder, never below 0; for powers of two the low bits are just that."""
    return (h.bitwiseAND(F.lit(buckets - 1).cast("long")) if buckets & (buckets - 1) == 0 else F.pmod(h, F.lit(buckets).cast("long"))).cast("int")


def ngram_buckets(hashes: Column, pairs: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams, from the words' hashes and the pairs'."""
    return F.concat(*[F.transform(x, lambda h: _bucket(h, buckets)) for x in (hashes, pairs)])


def _repeat_words(words: Column, hashes: Column, pairs: Column) -> Column:
    """Words inside windows that occur twice or more. Hashed windows only tell whether there is any repeat; the count is exact."""
    n = F.size(words)

    def exact() -> Column:
        windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i")))

        def repeated(s: Column) -> Column:
            def kept(k: Column) -> Column:
                at = F.element_at(s, k)
                same = ((k > 1) & (F.element_at(s, F.greatest(k - 1, F.lit(1)))["w"] == at["w"])) | ((k < F.size(s)) & (F.element_at(s, F.least(k + 1, F.size(s)))["w"] == at["w"]))
                return F.when(same, at["i"])

            return F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.size(s)), kept), lambda x: x.isNotNull()))

        def covered(p: Column) -> Column:
            gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.least(F.element_at(p, k + 1) - F.element_at(p, k), F.lit(WINDOW)))
            return F.when(F.size(p) == 0, 0).when(F.size(p) == 1, WINDOW).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x))

        return let(F.array_sort(windows), lambda s: let(repeated(s), covered))

    # Two pairs and a word make a window of five; past the last window parts are missing, which can only ask for a count in vain.
    windows = F.transform(pairs, lambda g, i: F.xxhash64(g, F.get(pairs, i + 2), F.get(hashes, i + 4)))
    any_repeat = let(windows, lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(n <= WINDOW, F.lit(0)).when(any_repeat, exact()).otherwise(F.lit(0)).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """`docs` with the base rules' counts; _h and _g hold the hashes of its words and of its pairs of words."""
    d = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_h", word_hashes(F.col("_words"))).withColumn("_g", pair_hashes(F.col("_h")))
    text, words = text_or_empty(F.col("text")), F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: let(F.col("_h"), lambda h: let(F.col("_g"), lambda g: _repeat_words(w, h, g)))).alias("n_repeat_words"),
    ).drop("_words")


def trusted_ids(labels: DataFrame, trusted_docs: int) -> DataFrame:
    """At most `trusted_docs` ids labelled quality 1."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_docs).select(F.col("doc_id").alias("_trusted"))


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS, prior: float = PRIOR) -> DataFrame:
    """One row, `weights`: an array of `buckets` doubles. Counts are summed in the map tasks first, so at most `buckets` rows per task are shuffled."""
    ids = F.broadcast(trusted_ids(labels, trusted_docs))
    d = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    h = d.select(F.col("_trusted").isNotNull().cast("long").alias("_t"), word_hashes(words_of(F.col("text"))).alias("_h"))
    grams = h.select("_t", F.explode(let(F.col("_h"), lambda x: ngram_buckets(x, pair_hashes(x), buckets))).alias("b"))
    counts = stored(grams.groupBy("b").agg(F.count("*").alias("r"), F.sum("_t").alias("t")), "ngram-counts")
    total = counts.agg(F.coalesce(F.sum("t") / F.sum("r"), F.lit(0.0)).alias("share"))
    w = counts.select("b", F.ln((F.col("t") + prior) / (F.col("r") * total.scalar() + prior)).alias("w"))
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(w, "b", "left")
    ordered = dense.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("a"))
    return stored(ordered.select(F.transform("a", lambda x: x["w"]).alias("weights")), "ngram-weights")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, **how) -> DataFrame:
    """`docs` with the counts, base_failed, ratio and kept; its own columns of those names give way."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept", "_words", "_h", "_g", "_weights")
    weights = ratio_weights(docs, labels, buckets, **how).scalar()
    d = with_counts(docs)

    def ratio(w: Column) -> Column:
        """Unigrams first, then bigrams, each looked up where its hash stands."""
        one = F.aggregate(F.col("_h"), F.lit(0.0), lambda a, h: a + F.get(w, _bucket(h, buckets)))
        both = F.aggregate(F.col("_g"), one, lambda a, g: a + F.get(w, _bucket(g, buckets)))
        return both / (F.size("_h") + F.size("_g") + F.lit(LENGTH_PRIOR))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # A subquery may not stand inside a lambda as written; the optimizer folds this column into its only use, so no row carries it.
    d = d.withColumn("_weights", weights).withColumn("ratio", let(F.col("_weights"), ratio)).drop("_h", "_g", "_weights").withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that pass the base rules and the ratio, with their own columns only."""
    return judge(packed(docs, "doc_id", "text"), labels, **how).filter("kept").select("_whole.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
