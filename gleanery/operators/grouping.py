"""Groups of articles without a model's labels, and relations by named terms. Null keys and sources group as any other value; ties go to the smaller key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.joins import first_of_each
from gleanery.operators.relevance_rules import empty


def source_groups(df: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """source, n, first and place of the first `most` sources in the order in which they are first seen."""
    out = df.groupBy(source).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    few = out.orderBy("first", source).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy("first", source)).cast("long"))  # `most` rows


def first_by_url(df: DataFrame, url: str, *order: str, normal: bool = True) -> DataFrame:
    """The first row of each address, normalised or as it stands; rows without an address are all kept."""
    key = T.normalise_url(F.col(url)) if normal else F.col(url)
    rows = df.withColumn("_url", key)
    one = first_of_each(rows.where("_url is not null"), ["_url"], *order)
    return one.unionByName(rows.where("_url is null")).drop("_url")


def unflagged(df: DataFrame, key: str, flagged: Column, *order: str) -> DataFrame:
    """Rows that aren't flagged as duplicates, the first of each key."""
    return first_of_each(df.where(~F.coalesce(flagged, F.lit(False))), [key], *order)


def topic_keyword_matches(now: DataFrame, past: DataFrame, topics: Mapping[str, Sequence[str]], least: int = 3, key: str = "id", text: str = "content") -> DataFrame:
    """key, topic and past_id: rows that hold `least` keywords of a topic of which a row of past holds as many; the smallest such row."""
    low = F.lower(empty(text))
    hits = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    met = F.array_compact(F.array(*(F.when(hits(words) >= least, F.lit(name)) for name, words in topics.items())))
    told = lambda df: df.select(key, F.explode(met).alias("topic"))
    first = told(past).groupBy("topic").agg(F.min(key).alias("past_id"))
    return told(now).join(F.broadcast(first), "topic").select(key, "topic", "past_id")  # one row a topic at most


def related(a: Column, b: Column, keywords_a: Column, keywords_b: Column) -> Column:
    """Whether two articles share a named term, or half of the larger one's keywords."""
    share = F.size(F.array_intersect(keywords_a, keywords_b)) / F.greatest(F.size(keywords_a), F.size(keywords_b), F.lit(1))
    return F.arrays_overlap(a, b) | (share >= 0.5)


def seed_groups(pairs: DataFrame, nodes: DataFrame, key: str = "id", least: int = 2) -> DataFrame:
    """seed and member: each row with the rows of larger key that it is paired with, itself included, where it has `least` members or more. A row may
    be a member of several groups; a row that an earlier seed has doesn't seed one itself."""
    edges = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    taken = edges.select(F.col("high").alias("low")).distinct()
    seeds = edges.join(taken, "low", "left_anti")
    members = seeds.select(F.col("low").alias("seed"), F.col("high").alias("member")).unionByName(seeds.select(F.col("low").alias("seed"), F.col("low").alias("member")).distinct())
    big = members.groupBy("seed").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("seed")
    return members.join(big, "seed").join(nodes.select(F.col(key).alias("member")).distinct(), "member", "left_semi").select("seed", "member")


def multi_source_topics(members: DataFrame, rows: DataFrame, key: str = "id", source: str = "source_id", sources: int = 2, size: int = 3) -> DataFrame:
    """seed, n and sources of groups of at least so many sources or members."""
    out = members.join(rows.select(F.col(key).alias("member"), F.col(source).alias("_s")), "member").groupBy("seed").agg(F.count("*").alias("n"), F.count_distinct("_s").alias("sources"))
    return out.where((F.col("sources") >= sources) | (F.col("n") >= size))


def merged_maps(defaults: Column, overrides: Column) -> Column:
    """The defaults with the overrides' values in their place; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    d, o = F.coalesce(defaults, none), F.coalesce(overrides, none)
    return F.map_concat(F.map_filter(d, lambda k, v: ~F.map_contains_key(o, k)), o)
