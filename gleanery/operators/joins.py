"""Joins beyond equality, by equi-joins and windows: no row is paired with all others. Null keys and times match nothing. Ties: see each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in `order`, ties by all columns; a null key is a key."""
    at = Window.partitionBy(*keys).orderBy(*order, F.to_json(F.struct(*df.columns)))
    return df.withColumn("_r", F.row_number().over(at)).where("_r = 1").drop("_r")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Rows of `left` with the values of the latest row of `right` of the same key that is no later; of equal times the largest values count.

    One shuffle of both sides by key: right rows are carried forward. A hot key is one window of sorted rows, which spills and needs no memory.
    """
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    carried = F.struct(*values)
    rows = left.select(*key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_v"))
    more = right.where(F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), carried.alias("_v"))
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(more).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    known = F.col("_t").isNotNull()
    for i in range(len(by)):
        known = known & F.col(f"_k{i}").isNotNull()
    return both.select("_row.*", *(F.when(known, F.col(f"_last.{v}")).alias(v) for v in values))


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and a span [start, end) that holds it: spans go to each cell of `width` they touch, points to their own, and cells are joined.
    Choose the width near the spans' usual length."""
    cell = lambda c: F.floor(F.col(c) / width)
    cells = spans.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    met = points.withColumn("_cell", cell(at)).join(cells, "_cell")
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
