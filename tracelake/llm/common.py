"""What the operators share: reading tables, intermediate tables in the shared folder, and row keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rules: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"

_OWN: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone an unset one is an own temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="tracelake-"))
            atexit.register(_OWN[0].cleanup)
        where = f"file://{_OWN[0].name}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, survives a lost executor, keeps column pruning.

    The files stay until `drop_stored`, or until the application's folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table of `stored` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row: Catalyst may otherwise copy an expression into a lambda that runs per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """Each row as one column, _whole, beside the columns that an operator reads: no name of the row's own can then clash with a computed one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), *names)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def widened(schema: StructType, ddl: str) -> StructType:
    """A schema with further columns; DataFrame.schema is shared, so it is copied."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
