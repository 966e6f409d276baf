"""Idempotent tables, retention, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.sinks import latest, same_keys


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key of old and new; equal versions: the new one, then the first by all columns. A null key is a key."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, keys, F.desc(version), F.desc("_new")).drop("_new")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key isn't there, one for each key (the first by all columns). Null keys are equal, so that they aren't inserted again."""
    there = old.select(*keys).distinct().alias("o")
    return old.unionByName(latest(new, keys).alias("n").join(there, same_keys("n", "o", keys), "left_anti").select(old.columns))


def retain(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def run_rollup(events: DataFrame, run: str, error: Column) -> DataFrame:
    """Per run: rows, errors, total duration, and status by the share of errors."""
    out = events.groupBy(run).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.sum("value").alias("duration"))
    return out.withColumn("status", F.when(F.col("errors") * 2 > F.col("n"), "failed").when(F.col("errors") > 0, "partial").otherwise("success"))


def success_rate(ok: Column, failed: Column) -> Column:
    """Percent, 0 where nothing went through."""
    return F.when(ok > 0, ok / (ok + failed) * 100).otherwise(F.lit(0.0))


def last_n_rate(df: DataFrame, group: str, n: int, ok: Column, *order: Column) -> DataFrame:
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n)
    return rows.groupBy(group).agg(F.avg(ok.cast("double")).alias("rate"), F.count("*").alias("n"))


def neighbours(edges: DataFrame, node: Column, k: int) -> DataFrame:
    """A node's edges in either direction, the strongest first: other, direction, score."""
    down = edges.where(F.col("parent") == node).select(F.col("child").alias("other"), F.lit("child").alias("direction"), "score")
    up = edges.where(F.col("child") == node).select(F.col("parent").alias("other"), F.lit("parent").alias("direction"), "score")
    return down.unionByName(up).orderBy(F.desc("score"), "other", "direction").limit(k)


def usage(df: DataFrame, name: str, took: str, n: int) -> DataFrame:
    """The n most used names: uses, and mean, least and longest duration."""
    out = df.groupBy(name).agg(F.count("*").alias("uses"), F.avg(took).alias("mean"), F.min(took).alias("low"), F.max(took).alias("high"))
    return out.orderBy(F.desc("uses"), name).limit(n)


def error_summary(errors: DataFrame, operation: str, time: str, key: str, hours: int = 1) -> DataFrame:
    """Of each operation: all errors, those of the last hours of the table, and the last one's key."""
    now = errors.agg(F.max(time).alias("_now"))
    rows = errors.crossJoin(F.broadcast(now))
    recent = F.count_if(F.col(time) > F.col("_now") - F.expr(f"interval {hours} hours"))
    return rows.groupBy(operation).agg(F.count("*").alias("n"), recent.alias("recent"), F.max_by(key, F.struct(time, key)).alias("last"))


def map_totals(df: DataFrame, group: str, counts: str) -> DataFrame:
    """Sums by key of a column of maps, for each group."""
    return df.select(group, F.explode(counts).alias("key", "value")).groupBy(group, "key").agg(F.sum("value").alias("total"))


def frequent(df: DataFrame, found: Column, n: int) -> DataFrame:
    """The n terms in most rows, each counted once a row; ties by name."""
    return df.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)
