"""Scoring of articles by word lists, thresholds that adapt, choice of the best."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Points for each distinct word of a tier.
TIERS = {"high": 3.0, "medium": 1.5, "low": 0.5, "negative": -1.0}


def lexicon_score(df: DataFrame, lexicon: Mapping[str, Sequence[str]], text: str = "content") -> DataFrame:
    """Adds n_<tier> (distinct words met) and score: points for each hundred words, between 0 and 1."""
    own = df.withColumn("_words", F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), 0)))
    for tier in TIERS:
        own = own.withColumn(f"n_{tier}", F.size(F.array_intersect("_words", F.array(*map(F.lit, lexicon.get(tier, ()))).cast("array<string>"))).cast("long"))
    raw = sum((F.col(f"n_{t}") * w for t, w in TIERS.items()), F.lit(0.0))
    per_hundred = F.greatest(T.word_count(F.col(text)) / F.lit(100.0), F.lit(0.01))
    return own.withColumn("score", T.clip(raw / per_hundred)).drop("_words")


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "very high").when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("none")


def dynamic_threshold(df: DataFrame, threshold: float, target: int, floor: float = 0.15, score: str = "score", ord: str = "ord") -> DataFrame:
    """Rows that pass; if fewer than `target` do, also those down to the target-th best score or the floor, whichever is higher. Adds passed.

    The target-th best comes from a top-k, not from a sort of all rows.
    """
    best = df.select(score).orderBy(F.desc(score)).limit(target)
    low = best.agg(F.when(F.count("*") >= target, F.min(score)).otherwise(F.lit(0.0)).alias("_nth"))
    n = df.agg(F.count_if(F.col(score) >= threshold).alias("_n"))
    limits = low.crossJoin(n).select(F.when(F.col("_n") >= target, F.lit(threshold)).otherwise(F.least(F.lit(threshold), F.greatest(F.lit(floor), "_nth"))).alias("_t"))
    return df.crossJoin(F.broadcast(limits)).where(F.col(score) >= F.col("_t")).drop("_t").withColumn("passed", F.col(score) >= threshold)


def relaxed_threshold(df: DataFrame, threshold: float, wanted: int, step: float = 0.9, tries: int = 3, score: str = "score") -> DataFrame:
    """Rows over the first of threshold, threshold * step, ... that gives `wanted` rows, or over the last of them; all counted in one pass."""
    steps = [threshold * step**i for i in range(tries + 1)]
    counts = df.agg(*[F.count_if(F.col(score) >= t).alias(f"_{i}") for i, t in enumerate(steps)])
    chosen = F.coalesce(*[F.when(F.col(f"_{i}") >= wanted, F.lit(t)) for i, t in enumerate(steps)], F.lit(steps[-1]))
    return df.crossJoin(F.broadcast(counts.select(chosen.alias("threshold")))).where(F.col(score) >= F.col("threshold"))


def best_of_each(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; adds rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def back_fill(chosen: DataFrame, rest: DataFrame, least: int, key: str, *order: Column) -> DataFrame:
    """The chosen rows and as many of the rest, in order, as make up `least`. Adds filled."""
    others = rest.join(chosen.select(key), key, "left_anti").orderBy(*order).limit(least)
    ranked = others.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # `least` rows at most
    n = chosen.agg(F.count("*").alias("_n"))
    more = ranked.crossJoin(F.broadcast(n)).where(F.col("_r") + F.col("_n") <= least).drop("_r", "_n")
    return chosen.withColumn("filled", F.lit(False)).unionByName(more.withColumn("filled", F.lit(True)))
