"""Distinctive tokens, exact copies and line classes over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinctive_tokens, splitlines, url_path_segments


def line_counts(docs: DataFrame) -> DataFrame:
    lines = splitlines(F.col("text"))
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_full"))


def rare_tokens(docs: DataFrame, share: float = 0.001, min_chars: int = 8) -> DataFrame:
    """Tokens found in at most max(2, share * n) documents of a source; counts are summed before the shuffle."""
    t = docs.select("source", F.explode(distinctive_tokens(F.col("text"), min_chars)).alias("token")).groupBy("source", "token").agg(F.count("*").alias("df"))
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    d = t.join(n, "source").filter(F.col("df") <= F.greatest(F.lit(2.0), F.col("n") * share))
    return d.groupBy("source").agg(F.count("*").alias("n_rare"), F.sum("df").alias("occurrences"))


def exact_copies(docs: DataFrame, buckets: int = 4096) -> DataFrame:
    """Of each document: earlier copies of its text and whether a later one supersedes it. Texts meet by digest, null texts too.

    Copies are counted inside ranges of doc_id first, and the ranges' counts are summed up: a text in any number of documents meets in
    no task as a whole.
    """
    d = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    low, high = (d.agg(f("doc_id").alias("x")).scalar() for f in (F.min, F.max))
    d = d.withColumn("b", F.floor((F.col("doc_id") - low) / (F.floor((high - low) / buckets) + 1)))
    parts = d.groupBy("h", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    w = Window.partitionBy("h")
    before = F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("h", F.coalesce("b", F.lit(-1)).alias("b"), before.alias("before"), F.max("top").over(w).alias("top"))
    here = F.count("*").over(Window.partitionBy("h", "b").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("b", F.coalesce("b", F.lit(-1))).join(parts, ["h", "b"])
    return d.select("doc_id", (F.col("before") + here).alias("earlier"), F.when(F.col("top") > F.col("doc_id"), 1).otherwise(0).alias("superseded"))


def path_depths(pages: DataFrame) -> DataFrame:
    s = url_path_segments(F.col("url"))
    return pages.select("page_id", F.size(s).cast("long").alias("depth"), F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")).alias("leaf"))


def page_paths(pages: DataFrame) -> DataFrame:
    """The path part of each page's url."""
    return pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
