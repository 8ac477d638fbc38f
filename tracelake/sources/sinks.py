"""Writers of JSON lines and of keyed exports. Each appends or replaces by Spark's own commit, so a lost task leaves no half row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, path: str) -> None:
    """One JSON line for each row; a null column is left out of its line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def stream_lines(rows: DataFrame, path: str, checkpoint: str):
    """The same as a stream; gives the running query, started with all that is there."""
    d = rows.select(F.to_json(F.struct("*")).alias("value"))
    return d.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_exports(exports: DataFrame, sessions: DataFrame, path: str) -> None:
    """Rewrites the partitions of `sessions` (session) with their `exports` (session, ..), and no others. A session without exports keeps
    one row of nulls, which `exported` does not give."""
    d = sessions.select("session").distinct().join(exports.withColumn("held", F.lit(True)), "session", "left")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


def exported(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("held").drop("held")


def record_bodies(bodies: DataFrame, path: str) -> None:
    """Appends request bodies (conv, turn, body) as they came, in folders by conversation bucket."""
    bodies.withColumn("bucket", F.pmod(F.xxhash64("conv"), F.lit(64))).write.mode("append").partitionBy("bucket").parquet(path)
