"""Windowed aggregations that run the same on a table and on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _late(df: DataFrame, time: str, wait: str | None) -> DataFrame:
    """With a watermark on a stream, which Spark keeps for timestamps with a zone only; the session's zone is UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, wait) if wait and df.isStreaming else df


def _out(df: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda end: F.col(f"window.{end}").cast("timestamp_ntz").alias(end)
    return df.select(at("start"), at("end"), *keys, *[c for c in df.columns if c not in (*keys, "window")])


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], *aggregates, wait: str | None = "10 minutes") -> DataFrame:
    return _out(_late(df, time, wait).groupBy(F.window(time, width), *keys).agg(*aggregates), keys)


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], *aggregates, wait: str | None = "10 minutes") -> DataFrame:
    return _out(_late(df, time, wait).groupBy(F.window(time, width, step), *keys).agg(*aggregates), keys)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates, wait: str | None = "10 minutes") -> DataFrame:
    return _out(_late(df, time, wait).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates), keys)


def unique(df: DataFrame, keys: list[str], time: str, wait: str = "10 minutes") -> DataFrame:
    """Rows of keys not seen before; on a stream, state is kept within the watermark."""
    return df.withWatermark(time, wait).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, last): for each key of a stream, how many rows it has had and the largest value; a row a key and batch."""

    def update(k, frames, state):
        n, last = state.get if state.exists else (0, None)
        for f in frames:
            n, top = n + len(f), f[value].max()
            last = top if last is None or top > last else last
        state.update((int(n), int(last)))
        yield pd.DataFrame({key: [k[0]], "n": [int(n)], "last": [int(last)]})

    return stream.select(key, F.col(value).cast("long").alias(value)).groupBy(key).applyInPandasWithState(update, f"{key} string, n long, last long", "n long, last long", "update", GroupStateTimeout.NoTimeout)
