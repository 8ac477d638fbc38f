"""Over how many partitions a table is dealt, so that what one task holds does not grow with the table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

#: Rows of the source table per partition.
ROWS = 250_000


def parts(table: DataFrame) -> int | None:
    """Partitions for the rows of a stored table, whose count needs no column; None where the session's own number is enough."""
    n = -(-table.count() // ROWS)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(d: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """`d` by `keys` over `n` partitions; without a number it is left to whatever step comes next."""
    return d.repartition(n, *keys) if n else d


def held(d: DataFrame, name: str) -> DataFrame:
    """`d` written under spark.checkpoint.dir and read back, so that what reads it several times does not compute it anew; as it is
    where no such folder is set."""
    root = d.sparkSession.conf.get("spark.checkpoint.dir", None) or d.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        return d
    path = f"{root}/{name}-{uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)
