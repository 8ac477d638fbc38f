"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of documents; the last gives token digests.

Defined results for all stages: an empty table gives an empty one; extra columns, whatever their names, come back as they were; rows
literally repeated are treated alike, so all of them stay or go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, decontaminate, lines, neardup, quality
from tracelake.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality rules reject go, null and empty texts with them (they have no words)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines found in three documents or more stay in the one with the largest id; null text stays null, n_chars follows text."""
    return lines.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, five words and 0.8: of each group of near duplicates the smallest id stays; wordless texts and null ids always do."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a benchmark window go; null and wordless texts have none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids, as digests; null text has none."""
    return bpe.token_digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("tokens", tokenised),
]

#: Near-duplicates, the quality ratio and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
