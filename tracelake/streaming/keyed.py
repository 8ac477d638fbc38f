"""One step function, run over a table or a stream: state by key, rows in order.

`step(state, row)` takes a dict that it may change and a row as a dict, and returns the row's output values. Over a table, rows are
dealt by key and sorted, and a task holds one key's state at a time; over a stream, the state lives in the state store between
micro-batches, where rows of one batch are taken in order. So both give equal rows as long as a stream brings a key's rows in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Step = Callable[[dict, dict], tuple]


def over_table(rows: DataFrame, key: str, order: str, step: Step, schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, begun = None, {}, False
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if not begun or row[key] != held:
                    held, state, begun = row[key], {}, True
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def over_stream(rows: DataFrame, key: str, order: str, step: Step, schema: str) -> DataFrame:
    """For a streaming `rows`; output mode append. The state is JSON, so step functions keep to lists, dicts, text and numbers."""
    names = StructType.fromDDL(schema).names

    def run(_key, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = json.loads(store.get[0]) if store.exists else {}
        batch = [row for frame in frames for row in frame.to_dict("records")]
        out = [step(state, row) for row in sorted(batch, key=lambda r: r[order])]
        store.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")
