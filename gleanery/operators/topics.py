"""Topics: leaders of similar rows, coherence, importance, and the choice of rows by topic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/gleanery-checkpoints"
    return f"{folder.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, read again from a table in the shared folder: it cuts the lineage, survives lost executors, and has a size that is known."""
    path = shared_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leader_groups(nodes: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """key and leader of each row: in key order, a row that no leader before it is paired with leads; others follow the first such leader.

    Not transitive. Each round settles every row whose smaller partners are all settled, so that it needs as many rounds as the longest chain of
    pairs with rising keys, not one for each row. Only rows that have a partner take part; the rest lead themselves. States are written.
    """
    ids = nodes.select(F.col(key).alias("id")).distinct()
    edges = settled(pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct())
    state = edges.select(F.col("high").alias("id")).distinct().select("id", F.lit(None).cast("boolean").alias("leads"))
    lead = edges.select(F.col("low").alias("id")).distinct().join(state.select("id"), "id", "left_anti").withColumn("leads", F.lit(True))
    state = settled(lead.unionByName(state))
    while state.where("leads is null").head(1):  # each round settles the smallest open row of each part at least
        open_ = edges.join(state.where("leads is null").select(F.col("id").alias("high")), "high")
        seen = open_.join(state.select(F.col("id").alias("low"), "leads"), "low").groupBy("high").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("met"), F.bool_or(F.col("leads").isNull()).alias("open"))
        verdict = F.when(F.col("met"), F.lit(False)).when(~F.col("open"), F.lit(True))
        state = settled(state.join(seen.select(F.col("high").alias("id"), verdict.alias("_v")), "id", "left").select("id", F.coalesce("leads", "_v").alias("leads")))
    first = edges.join(state.where("leads").select(F.col("id").alias("low")), "low").groupBy("high").agg(F.min("low").alias("leader"))
    follows = state.where("not leads").join(first, F.col("id") == F.col("high")).select("id", "leader")
    return ids.join(follows, "id", "left").select(F.col("id").alias(key), F.coalesce("leader", "id").alias("leader"))


def group_sums(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, its size and the sum of its vectors, summed place by place with partial sums before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return parts.groupBy(group).agg(F.max("n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("_sum"))


def _closeness(df: DataFrame, group: str, vector: str, less: int) -> DataFrame:
    v = F.col(vector)
    own = T.dot(v, F.col("_sum")) - T.dot(v, v)
    return df.join(group_sums(df, group, vector), group).withColumn("_close", own / F.greatest(F.col("_n") - less, F.lit(1)))


def coherence(df: DataFrame, group: str, threshold: float, vector: str = "embedding", parity: bool = False) -> DataFrame:
    """Of each group of unit vectors: n, kept (members whose mean similarity to the others is 0.8 * threshold or more), their coherence, and coherent.

    Linear in the rows, by the groups' sums. parity=True divides by n, the member itself among them, instead of by n - 1.
    """
    less = 0 if parity else 1
    near = _closeness(df.select(group, vector), group, vector, less)
    sizes = near.groupBy(group).agg(F.count("*").alias("n"))
    kept = near.where(F.col("_close") >= 0.8 * threshold).select(group, vector)
    again = _closeness(kept, group, vector, less).groupBy(group).agg(F.count("*").alias("kept"), F.avg("_close").alias("coherence"))
    out = sizes.join(again, group, "left").withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("coherence", F.when(F.col("kept") >= 2, F.col("coherence")).otherwise(F.lit(0.0)))
    return out.withColumn("coherent", (F.col("kept") >= 2) & (F.col("coherence") >= threshold))


def importance(df: DataFrame, group: str, source: str, relevance: str, confidence: str, good: Column) -> DataFrame:
    """n, sources and importance of each group, 1 at most: by its sources, size, confidence, relevance and rows of good sources."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(source).alias("sources"), F.avg(confidence).alias("_c"), F.avg(relevance).alias("_r"), F.count_if(good).alias("_g"))
    parts = F.least(F.col("sources") / 5, F.lit(1.0)) * 0.4 + F.least(F.col("n") / 10, F.lit(0.5)) * 0.2 + F.col("_c") * 0.2 + F.col("_r") * 0.3 * 0.2 + F.least(F.col("_g") * 0.1, F.lit(0.3))
    return out.select(group, "n", "sources", F.least(parts, F.lit(1.0)).alias("importance"))


def topic_first(df: DataFrame, group: str, topics: int, each: int, least: float, total: int, key: str = "id", score: str = "score") -> DataFrame:
    """Up to `each` rows of score over `least` from the best `topics` groups (by mean score, then name), filled up to `total` by score. Adds chosen_by."""
    best = df.groupBy(group).agg(F.avg(score).alias("_m")).orderBy(F.desc(F.round("_m", 9)), group).limit(topics).select(group)
    ranked = df.join(F.broadcast(best), group).where(F.col(score) > least).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    picked = ranked.where(F.col("_r") <= each).drop("_r").orderBy(F.desc(score), key).limit(total).select(df.columns)
    more = df.join(F.broadcast(picked.select(key)), key, "left_anti").orderBy(F.desc(score), key).limit(total).select(df.columns)
    both = picked.withColumn("chosen_by", F.lit("topic")).unionByName(more.withColumn("chosen_by", F.lit("score")))
    return both.orderBy(F.desc("chosen_by"), F.desc(score), key).limit(total)


def cluster_cap(df: DataFrame, group: str, each: int, total: int, key: str = "id", score: str = "score") -> DataFrame:
    """The best `each` rows of each group, groups by mean score and size, `total` rows at most."""
    groups = df.groupBy(group).agg(F.round(F.avg(score), 9).alias("_m"), F.count("*").alias("_n"))
    rows = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("rank") <= each)
    return rows.join(groups, group).orderBy(F.desc("_m"), F.desc("_n"), group, "rank").limit(total).drop("_m", "_n")


def diverse_sources(df: DataFrame, group: str, source: str, k: int, *order: Column) -> DataFrame:
    """Of each group the best row of each source, and of these the k best. Adds rank."""
    one = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, source).orderBy(*order))).where("_r = 1").drop("_r")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def tags(text: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The names of the lists of which the text, in lower case, holds a term; in the lists' order."""
    low = F.lower(text)
    met = [F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), F.lit(name)) for name, terms in lists.items()]
    return F.array_compact(F.array(*met))


def alignment(a: Column, b: Column, n: int, one_sided: float) -> Column:
    """Of two arrays of tags out of n: 1 for each tag of both, `one_sided` for each tag of one, over n."""
    both = F.size(F.array_intersect(a, b))
    return (both + (F.size(F.array_union(a, b)) - both) * one_sided) / n


def overlap_penalty(similarity: Column) -> Column:
    return F.when(similarity > 0.8, -0.3).when(similarity > 0.6, -0.1).otherwise(F.lit(0.0))


#: References that travel together.
REFERENCES = 1000


def contrast(df: DataFrame, wanted: DataFrame, unwanted: DataFrame, vector: str = "embedding", best: int = 3) -> DataFrame:
    """Adds score: the mean cosine to the nearest wanted references, less a share of that to the unwanted ones (0.6 of it over 0.7, else 0.4).

    References travel as rows of two arrays, REFERENCES of them at a time, so rows aren't multiplied; from block to block a row keeps its best
    cosines. Without wanted references that part is 0, as without unwanted ones. Vectors are taken as unit vectors.
    """
    rows = df.withColumns({"_p": F.array().cast("array<double>"), "_q": F.array().cast("array<double>")})
    for refs, best_of in ((wanted, "_p"), (unwanted, "_q")):
        blocks = max(1, -(-refs.count() // REFERENCES))
        dealt = settled(refs.select(F.col(vector).alias("_v"), F.pmod(F.xxhash64(vector), F.lit(blocks)).alias("_b"))) if blocks > 1 else refs.select(F.col(vector).alias("_v"), F.lit(0).alias("_b"))
        for block in range(blocks):
            one = dealt.where(F.col("_b") == block).agg(F.collect_list("_v").alias("_refs"))
            near = F.transform("_refs", lambda r: T.dot(r, F.col(vector)))
            rows = rows.crossJoin(F.broadcast(one)).withColumn(best_of, F.slice(F.sort_array(F.concat(F.col(best_of), near), asc=False), 1, best)).drop("_refs")
            rows = settled(rows) if blocks > 1 else rows
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(c), F.lit(1))
    rows = rows.withColumns({"_p": mean("_p"), "_q": mean("_q")})
    share = F.when(F.col("_q") > 0.7, 0.6).otherwise(0.4)
    return rows.withColumn("score", T.clip(F.col("_p") - share * F.col("_q"))).drop("_p", "_q")


def blend_accept(df: DataFrame, keyword: Column, semantic: Column, base: float, least: float, first: int = 15, key: str = "id") -> DataFrame:
    """Rows of a blended score of `base` or more, and those of `least` or more among the `first` best. Adds blend."""
    rows = df.withColumn("blend", F.when(semantic == 0, keyword).otherwise(keyword * 0.8 + semantic * 0.2))
    some = rows.orderBy(F.desc("blend"), key).limit(first).where((F.col("blend") < base) & (F.col("blend") >= least))
    return rows.where(F.col("blend") >= base).unionByName(some)


def boosted_filter(df: DataFrame, threshold: float, score: str = "score", priority: str = "priority") -> DataFrame:
    """Rows whose score, raised by priority, reaches the threshold; all rows where none does. Adds boosted."""
    s = F.col(score)
    lift = F.when(F.col(priority) == 1, s + 0.4).when(F.col(priority) == 2, s + 0.2).when((F.col(priority) == 4) & (s < 0.7), s * 0.8).otherwise(s)
    rows = df.withColumn("boosted", F.least(lift, F.lit(1.0)))
    any_ = rows.agg(F.count_if(F.col("boosted") >= threshold).alias("_n"))
    return rows.crossJoin(F.broadcast(any_)).where((F.col("_n") == 0) | (F.col("boosted") >= threshold)).drop("_n")


def kmeans_groups(df: DataFrame, k: int, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """Adds group: the nearest of k centres that are fitted to all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="group").fit(rows.select("_v"))
    return model.transform(rows).drop("_v")
