"""Streams of rows with a time: late rows, repeated keys, windows, and tables that grow by batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.sinks import insert_missing


def fresh(stream: DataFrame, keys: list[str], time: str, late: str = "24 hours") -> DataFrame:
    """The first row of each key; a key is remembered for `late`, and rows that are later than that are left out."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, late: str, length: str, slide: str | None = None, *by: str, value: str = "value") -> DataFrame:
    """start, the columns `by`, n and total of tumbling windows, or sliding ones where `slide` is given."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    rows = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, late: str, gap: str, *by: str) -> DataFrame:
    """start, the columns `by` and n of sessions; a stream needs one column `by` at least."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the batch's rows whose keys the table at `path` hasn't yet, one of each key. A repeated batch adds nothing."""

    def go(batch: DataFrame, number: int) -> None:
        insert_missing(batch, path, keys)

    return go


def error_rate(stream: DataFrame, time: str, late: str, length: str, error: Column) -> DataFrame:
    """start, n and rate of errors by window."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.count("*").alias("n"), F.avg(error.cast("double")).alias("rate"))
    return rows.select(F.col("w.start").alias("start"), "n", "rate")
