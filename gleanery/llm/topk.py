"""Exact top-k search by distributed selection on score histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

#: Queries that are searched for at a time (about; they are dealt by a hash): what the driver and each task hold of them.
BLOCK = 4096
BINS = 256
#: Vectors that a task scores at a time.
AT_ONCE = 256
#: Scores of this size or more are refused with an error.
TOO_LARGE = 1 << 61


def scaled(embedding: str, factor: int = 256) -> Column:
    """Each component x as floor(factor * x), a whole number as double; null for a vector that is null, empty, or holds a component null or not finite."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(float("nan")))))
    # From 2^53 on a double is whole as it is.
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda c: F.when(F.abs(c * factor) < 2.0**53, F.floor(c * factor).cast("double")).otherwise(c * factor)))


def _whole(x: np.ndarray) -> np.ndarray:
    """Python integers of whole doubles of any size."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _products(x: np.ndarray, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
    """int64[rows, queries]: inner products of whole numbers, exact whatever their size; that of a row's own query (-1: none) may be anything."""
    dim = queries.shape[1]
    of_row, of_query = (np.abs(m).max(axis=1, initial=1) for m in (x, queries))
    if of_row.max(initial=1) * of_query.max(initial=1) * dim < 2**53:  # sums are whole numbers that a double holds exactly
        return (x @ queries.T).astype(np.int64)
    out = np.zeros((len(x), len(queries)), np.int64)
    for q in range(len(queries)):
        small = (of_row * of_query[q] * dim < 2**53) | (own == q)
        out[small, q] = np.where(own[small] == q, 0, x[small] @ queries[q]).astype(np.int64)
        if not small.all():
            large = _whole(x[~small]) @ _whole(queries[q : q + 1])[0]
            if any(abs(v) >= TOO_LARGE for v in large):
                raise OverflowError("a score is beyond what a long can rank: 2^61 or more in size")
            out[~small, q] = large.astype(np.int64)
    return out


def _scores(batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, scores[rows, queries]) of some rows at a time; a query's own row has the least score there is."""
    dim = queries.shape[1]
    for i in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(i, AT_ONCE)
        own = part.column(0).to_numpy(zero_copy_only=False)
        x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        at = np.searchsorted(ids, own)
        itself = ids[np.minimum(at, len(ids) - 1)] == own
        score, hit = _products(x, queries, np.where(itself, at, -1)), np.flatnonzero(itself)
        score[hit, at[hit]] = np.iinfo(np.int64).min
        yield own, score


def _histogram(ids: np.ndarray, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, k: int):
    """A task's part of the histograms: (query, bin, n), from the top down to where k scores are reached, as no lower bin can hold the kth."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ids), BINS + 1), np.int64)
        base = np.arange(len(ids)) * (BINS + 2)
        for batch in batches:
            for _, score in _scores(batch, ids, queries):
                inside = (score >= lo) & (score < hi)
                above = score >= hi
                bins = np.where(inside, (np.where(inside, score, lo) - lo) // width, np.where(above, BINS, BINS + 1))
                n += np.bincount((bins + base).ravel(), minlength=len(ids) * (BINS + 2)).reshape(len(ids), BINS + 2)[:, : BINS + 1]
        upto = np.cumsum(n[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
        q, b = np.nonzero((n > 0) & (upto - n < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(n[q, b])], names=["q", "bin", "n"])

    return count


def _pick(ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
    """A task's rows that may be among a query's k best: of those at or over the kth value the k first by score and vec_id."""

    def cut(q: np.ndarray, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        return q[keep], s[keep], v[keep]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none)
        for batch in batches:
            for own, score in _scores(batch, ids, queries):
                r, q = np.nonzero((score >= least) & (score > np.iinfo(np.int64).min))
                held = cut(*(np.concatenate([a, b]) for a, b in zip(held, (q, score[r, q], own[r]))))
        q, s, v = held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(s), pa.array(v)], names=["query_id", "score", "vec_id"])

    return pick


def _kth(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth score, found by histograms of ever smaller ranges; the least score there is where fewer than k rows are."""
    lo, hi = -bound, bound + 1
    short = np.zeros(len(ids), bool)
    while (hi - lo > 1).any():
        width = np.maximum(1, -(-(hi - lo) // BINS))
        parts = rows.mapInArrow(_histogram(ids, queries, lo, hi, width, k), "q long, bin long, n long")
        got = parts.groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most BINS + 1 rows a query of the block
        n = np.zeros((len(ids), BINS + 1), np.int64)
        n[got.q.to_numpy(np.int64), got.bin.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
        upto = np.cumsum(n[:, ::-1], axis=1)[:, ::-1]
        short |= upto[:, 0] < k
        at = BINS - np.argmax(upto[:, ::-1] >= k, axis=1)
        done = hi - lo <= 1
        new_lo = lo + at * width
        lo, hi = np.where(done, lo, new_lo), np.where(done, hi, np.minimum(hi, new_lo + width))
        lo, hi = np.where(short, -bound, lo), np.where(short, -bound + 1, hi)
    return np.where(short, np.iinfo(np.int64).min, lo)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 256, block: int = BLOCK) -> DataFrame:
    """Each query's k highest inner products of scaled vectors: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Every row whose id isn't the query's own is scored, in each of a few passes over all rows: passes that count scores into BINS ranges of where
    the kth score of each query may lie, until it is known exactly, then one that keeps the rows at or over it. Queries are taken in blocks of
    about `block`, so what a task or the driver holds is bounded whatever the number of rows; each block's rows are added to one table.

    Vectors that are null, empty or hold null or non-finite components, and rows with null id take no part. Components may be of any size; a
    score of 2^61 or more in size is an error. Vectors of another length than the query's aren't compared with it. A repeated row is another candidate; rows that repeat a query's
    id are one query (of its smallest vector), and no candidates of it. Fewer rows than k: all are returned. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(embedding, factor).alias("v"), is_query.alias("asks")).where("vec_id is not null and v is not null"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, longest = asked.count(), rows.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()[0]
    blocks = max(1, -(-n // block))
    asked = written(asked.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")))
    out, folder = spark.createDataFrame([], "query_id long, score long, vec_id long"), None
    for dim, b in sorted((r.dim, r.block) for r in asked.select("dim", "block").distinct().collect()) if n else []:
        got = sorted(asked.where((F.col("dim") == dim) & (F.col("block") == b)).select("vec_id", "v").collect())
        ids, queries = np.array([r.vec_id for r in got], np.int64), np.array([r.v for r in got], np.float64)
        fit = rows.where(F.size("v") == dim).select("vec_id", "v")
        bound = np.minimum((np.sqrt((queries**2).sum(1)) * longest**0.5) * (1 + 1e-9) + 2, float(TOO_LARGE)).astype(np.int64)
        least = _kth(fit, ids, queries, bound, k)
        out = written(fit.mapInArrow(_pick(ids, queries, least, k), "query_id long, score long, vec_id long"), add_to=folder)
        folder = out.written_to
    ranked = out.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def op3_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
