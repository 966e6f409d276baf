"""Groups of dense vectors: everything within a distance, link by link."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.topics import settled

#: Vectors of a block, at most on average.
BLOCK = 32_768


def linked(edges: DataFrame) -> DataFrame:
    """id and root, the smallest id reachable, of every row that has an edge (a, b). Labels fall to the least neighbour's and then to their own label's label."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    now = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:  # labels only fall, and double their reach each round
        least = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("_m"))
        lower = now.join(least, "id").select("id", F.least("root", "_m").alias("root"))
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("_r"))
        after = settled(lower.join(jump, "root", "left").select("id", F.least("root", F.coalesce("_r", "root")).alias("root")))
        same = after.join(now.withColumnRenamed("root", "_was"), "id").where("root != _was").limit(1).count() == 0
        now = after
        if same:
            return now


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The labels, each the smallest member's place, after the members p and q were joined pair by pair."""
    while True:
        a, b = label[p], label[q]
        if not (apart := a != b).any():
            return label
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != (lower := label[label])).any():
            label = lower


def _near(x: np.ndarray, y: np.ndarray | None, within: float, forest: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q), among the rows of x and then y, of all pairs of x and y (None: of x alone) at most so far apart; forest: of pairs that connect
    the same rows. Products are taken in single precision first; those that may be near enough again in double precision, term after term."""
    other, shift = (x, 0) if y is None else (y, len(x))
    low, least = np.ascontiguousarray(other.T, np.float32), 1 - within * within / 2 - 1e-5 - 2e-7 * x.shape[1]
    label = np.arange(len(other) + shift)
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(x), step):
        p, q = np.nonzero(x[at : at + step].astype(np.float32) @ low >= least)
        p, q = p + at, q + shift
        some = p < q
        if forest:
            some &= label[p] != label[q]
        p, q = p[some], q[some]
        for k in range(0, len(p), 1 << 16):
            i, j = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            total = np.zeros(len(i))
            for c in range(x.shape[1]):
                total += x[i, c] * other[j - shift, c]
            near = 2 - 2 * total <= within * within + 1e-12
            if forest:
                label = _joined(label, i[near], j[near])
            else:
                found.append(np.stack([i[near], j[near]]))
    if forest:
        return label[(own := np.flatnonzero(label != np.arange(len(label))))], own
    return tuple(np.concatenate(found, axis=1))


def close_pairs(df: DataFrame, within: float, size: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42, forest: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b) of all pairs of unit vectors of `size` numbers at most so far apart; equal vectors are joined to the first of them only. forest: pairs
    that connect the same vectors, fewer than the vectors for any two blocks.

    Exact: vectors are cut into blocks along an axis, and blocks that are no further apart on it than the distance are compared whole by matrix
    products, every two in a task of their own. The work still grows with the square of the vectors.
    """
    axis = np.random.default_rng(seed).normal(size=size)
    axis /= np.linalg.norm(axis)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == size))
    rows = rows.withColumn("l", F.sqrt(T.dot(F.col("v"), F.col("v")))).where("l > 0 and l < double('Infinity')").select("id", F.transform("v", lambda x: x / F.col("l")).alias("v"))
    one = settled(rows.groupBy("v").agg(F.min("id").alias("id")).withColumn("at", T.dot(F.col("v"), F.array(*map(F.lit, axis.tolist())))))
    alike = rows.join(one.select("v", F.col("id").alias("a")), "v").where("id != a").select("a", F.col("id").alias("b"))
    spark, n = df.sparkSession, one.count()
    tasks = 3 * spark.sparkContext.defaultParallelism
    m = max(1, -(-n // block), min(n // 1024, math.isqrt(2 * tasks) + 1))  # so many blocks, for as many tasks where there are the vectors
    edges = sorted(set(one.agg(F.percentile_approx("at", [i / m for i in range(1, m)])).first()[0] or [])) if m > 1 and n else []
    last = len(edges)
    meet = [(i, i, j) for i in range(last + 1) for j in range(i, last + 1) if j <= i + 1 or edges[j - 1] - edges[i] <= within + 1e-9]
    pairs = spark.createDataFrame(meet + [(j, i, j) for _, i, j in meet if i != j], "c int, x int, y int")
    cell = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("at"))) if edges else F.lit(0)
    placed = one.select("id", "v", cell.alias("c")).join(F.broadcast(pairs), "c").repartition(len(meet), "x", "y")
    kind = one.schema["id"].dataType.simpleString()

    def go(t: pa.Table) -> pa.Table:
        c, first = t["c"].to_numpy(), t["x"][0].as_py()
        t = t.take(pa.array(order := np.argsort(c != first, kind="stable")))
        vectors, cut = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, size), int((c[order] == first).sum())
        p, q = _near(vectors[:cut], None if t["y"][0].as_py() == first else vectors[cut:], within, forest)
        return pa.table({"a": t["id"].take(pa.array(p)), "b": t["id"].take(pa.array(q))})

    near = placed.groupBy("x", "y").applyInArrow(go, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.unionByName(alike)


def density_groups(df: DataFrame, within: float, size: int, least: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and group of every row: the smallest key that chains of vectors, each within the distance of the next, lead to; -1 where fewer than `least` rows do.

    The cut of the single-linkage tree at one distance (one neighbour makes a core point). Vectors that are null, zero, not finite or of another size are
    alone. `least` counts rows.
    """
    if not 0 < within < math.sqrt(2):
        raise ValueError("a distance between 0 and the square root of 2")
    groups = linked(close_pairs(df, within, size, key, vector, forest=True))
    big = groups.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    kept = groups.join(big, "root").select(F.col("id").alias(key), F.col("root").alias("group"))
    return df.select(key).join(kept, key, "left").select(key, F.coalesce("group", F.lit(-1)).alias("group"))
