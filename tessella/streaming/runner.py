"""Drives state machines over tables and streams, one machine a key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, key: str, order: str, machine: Callable[[], object], event: Callable[[dict], dict], schema: str, *, last: bool = False) -> DataFrame:
    """One output row for each input row: key, order and the machine's answer.

    Rows are dealt by key and sorted, then read through in batches, so that a
    key with very many events needs no more memory than its machine's state.
    Events have Python values: whole numbers stay whole and null is ``None``.
    Rows whose key is null are one key, too.  ``schema`` names the answer's columns.
    With ``last`` a key has one output row, that of its last input row.
    """
    rows = df.repartition(key).sortWithinPartitions(key, order)
    kinds = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (key, order)] + list(T.StructType.fromDDL(schema)))
    arrow, names = to_arrow_schema(kinds), kinds.names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, row, answer = None, None, None, None

        def named() -> dict:
            return {key: row[key], order: row[order]} | {n: answer[n] for n in names}

        for batch in batches:
            out = []
            for following in batch.to_pylist():
                if own is None or following[key] != held:
                    if last and own is not None:
                        out.append(named())
                    held, own = following[key], machine()
                row = following
                answer = own.step(event(row))
                if not last:
                    out.append(named())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last and own is not None:
            yield pa.RecordBatch.from_pylist([named()], schema=arrow)

    return rows.mapInArrow(run, kinds)


def stream(df: DataFrame, key: str, order: str, machine: Callable[[], object], event: Callable[[dict], dict], schema: str) -> DataFrame:
    """The same over a streaming DataFrame: each micro-batch's events of a key in order, the machine kept as state."""
    kinds = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (key, order)] + list(T.StructType.fromDDL(schema)))
    names = kinds.names[2:]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else machine()
        rows = pd.concat(list(batches)).sort_values(order)
        rows = rows.astype(object).where(rows.notna(), None)
        out = [(keys[0], row[order], *(answer[n] for answer in [own.step(event(row))] for n in names)) for row in rows.to_dict("records")]
        state.update((pickle.dumps(own),))
        yield pd.DataFrame(out, columns=[key, order, *names])

    return df.groupBy(key).applyInPandasWithState(run, kinds, "machine binary", "append", "NoTimeout")


def trace_records(df: DataFrame, loop: str, order: str, kind: str, value: str) -> DataFrame:
    """Events begin / update / finish / abort of a loop, folded to one record: finished loops only."""
    first = lambda k, c: F.min(F.when(F.col(kind) == k, F.col(c)))
    folded = df.groupBy(loop).agg(
        first("begin", order).alias("begun"),
        F.max(F.when(F.col(kind) == "update", F.col(value))).alias("most_workers"),
        F.count_if(F.col(kind) == "update").alias("updates"),
        F.coalesce(first("finish", order), first("abort", order)).alias("ended"),
        F.coalesce(F.bool_or(F.col(kind) == "abort"), F.lit(False)).alias("exceptional"),
    )
    return folded.where("begun is not null and ended is not null")


def windowed_counts(df: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """An extension: counts and sums by tumbling window, with a watermark for late rows."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
