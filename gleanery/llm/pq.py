"""Near duplicates among embeddings by product quantisation.

Coarse cells come from one k-means in each half of the space, a cell being a pair of centroids. Every vector lies in its nearest cell, with a code
of its residual, one byte a subspace. A vector is looked for in its nearest cells: table look-ups give distances to the codes, and what may be
near enough by these is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import components, table, written

#: Distinct vectors that the quantisers are fitted on, at most; those of the smallest hashes of their ids.
SAMPLE = 16_384
#: Distinct vectors a cell holds on average, and the most centroids in a half of the space.
A_CELL, MOST_CENTROIDS = 256, 256
#: Centroids of each half, and cells made of them, that a vector is looked for in at least; both grow with the number of cells.
NEAR_CENTROIDS, PROBES = 6, 12
SUBSPACES, CODES = 8, 256
#: Vectors of a cell, and vectors looked for in it, that one task takes at a time; larger cells are split into such blocks.
BLOCK = 4096


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the k nearest rows of c, nearest first."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(d, at, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c, 1)[0][:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Centroids of both halves and of each subspace's residuals, from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, vectors: int) -> None:
        dim = sample.shape[1]
        k = int(np.clip(round((vectors / A_CELL) ** 0.5), 1, MOST_CENTROIDS))
        self.halves = [slice(0, (dim + 1) // 2), slice((dim + 1) // 2, dim)]
        self.coarse = [_kmeans(sample[:, h], k) for h in self.halves]
        root = len(self.coarse[0]) ** 0.5  # the fourth root of the number of cells: by this recall holds up to the most cells (tested)
        self.near, self.probes = max(NEAR_CENTROIDS, int(np.ceil(root))), max(PROBES, int(np.ceil(4 * root)))
        self.parts = [slice(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(dim), min(SUBSPACES, dim))]
        rest = sample - self.centres(self.cells(sample)[0][:, 0])
        self.fine = [_kmeans(rest[:, p], CODES) for p in self.parts]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells, so many as are probed, of the nearest centroids of each half, nearest first, and squared distances."""
        (a, da), (b, db) = (_nearest(x[:, h], c, min(self.near, len(c))) for h, c in zip(self.halves, self.coarse))
        cell = (a[:, :, None] * len(self.coarse[1]) + b[:, None, :]).reshape(len(x), -1)
        d = (da[:, :, None] + db[:, None, :]).reshape(len(x), -1)
        best = np.argsort(d, axis=1, kind="stable")[:, : self.probes]
        return np.take_along_axis(cell, best, 1), np.take_along_axis(d, best, 1)

    def centres(self, cells: np.ndarray) -> np.ndarray:
        n = len(self.coarse[1])
        return np.concatenate([self.coarse[0][cells // n], self.coarse[1][cells % n]], axis=1)

    def encode(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint8 codes of the residuals, and how far each vector lies from what its code stands for."""
        rest = x - self.centres(cells)
        found = [_nearest(rest[:, p], c, 1) for p, c in zip(self.parts, self.fine)]
        return np.stack([f[0][:, 0] for f in found], axis=1).astype(np.uint8), np.sqrt(sum(f[1][:, 0] for f in found))

    def look_up(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances from x to what the codes of a cell stand for: a table for each vector and subspace, added up by code."""
        rest = x - self.centres(np.array([cell]))
        total = np.zeros((len(x), len(codes)))
        for m, (p, c) in enumerate(zip(self.parts, self.fine)):
            tables = np.maximum((rest[:, p] ** 2).sum(1)[:, None] - 2 * rest[:, p] @ c.T + (c**2).sum(1)[None], 0)
            total += tables[:, codes[:, m]]
        return np.sqrt(total)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    # in two steps, so that neither very large nor very small components overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _matches(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, codes: np.ndarray, err: np.ndarray, cell: int, quantiser: Quantiser, least: float, probed=None):
    """(query, row) pairs of cosine >= least and different ids, some queries at a time."""
    reach = (2 - 2 * least) ** 0.5 + 1e-9
    for i in range(0, len(q), 256):
        near = quantiser.look_up(q[i : i + 256], cell, codes) <= reach + err[None]  # no vector within reach is left out: the triangle inequality
        a, b = np.nonzero(near)
        other = q_ids[i + a] != x_ids[b]
        a, b = a[other], b[other]
        good = np.concatenate([np.einsum("ij,ij->i", q[i + a[j : j + 65536]], x[b[j : j + 65536]]) >= least for j in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        yield i + a[good], b[good]


def _links_of_dim(classes: DataFrame, dim: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """((node, n): linked vectors found for each distinct vector, whichever of the two was found, (a, b): edges that connect what the links connect)."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow().to_pandas()
    quantiser = Quantiser(_unit(np.array(sample.v.tolist(), np.float64)), total)
    cells = len(quantiser.coarse[0]) * len(quantiser.coarse[1])  # MOST_CENTROIDS squared at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _unit(_matrix(part.column(2), dim))
                near, _ = quantiser.cells(x)
                codes, err = quantiser.encode(x, near[:, 0])
                probes = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)], names=["node", "n", "v", "probes", "code", "err"])

    placed = written(classes.select("node", "n", "v").mapInArrow(assign, "node long, n long, v array<double>, probes array<int>, code binary, err double"))
    sizes = placed.select(F.explode("probes").alias("cell"), F.lit(0).alias("held")).union(placed.select(F.col("probes")[0], F.lit(1))).groupBy("cell").agg(F.count_if(F.col("held") == 0).alias("q"), F.sum("held").alias("x")).toArrow().to_pandas()
    of_queries, of_rows = np.ones(cells, np.int64), np.ones(cells, np.int64)
    of_queries[sizes.cell.to_numpy(np.int64)] = np.maximum(1, -(-sizes.q.to_numpy(np.int64) // block))
    of_rows[sizes.cell.to_numpy(np.int64)] = np.maximum(1, -(-sizes.x.to_numpy(np.int64) // block))
    counts = spark.sparkContext.broadcast((of_queries, of_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its cell, and to each cell it is looked for in; to one block there, against all blocks of the other side."""
        n_q, n_x = counts.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                node = part.column(0).to_numpy(zero_copy_only=False)
                mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                near = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1).astype(np.int64)
                rows, keys, kinds = [], [], []
                for kind, places in ((0, near[:, :1]), (1, near)):
                    r = np.repeat(np.arange(len(node)), places.shape[1])
                    c = places.ravel()
                    mine, other = (n_x, n_q) if kind == 0 else (n_q, n_x)
                    block_no = mixed[r].astype(np.int64) % mine[c]
                    times = other[c]
                    r2 = np.repeat(np.arange(len(r)), times)
                    o = np.arange(len(r2)) - np.repeat(np.cumsum(times) - times, times)
                    qb, xb = (o, block_no[r2]) if kind == 0 else (block_no[r2], o)
                    rows.append(r[r2])
                    keys.append(np.stack([c[r2], qb, xb]))
                    kinds.append(np.full(len(r2), kind, np.int32))
                at, (c, qb, xb), kind = np.concatenate(rows), np.concatenate(keys, axis=1), np.concatenate(kinds)
                out = part.take(pa.array(at))
                code = pa.array([None if k else b for k, b in zip(kind.tolist(), out.column(4).to_pylist())], pa.binary())
                cells_ = pa.array([p[:1] if k else p for k, p in zip(kind.tolist(), near[at])], pa.list_(pa.int32()))  # of a vector that is looked for, its own cell
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(qb), pa.array(xb), pa.array(kind), out.column(0), out.column(1), out.column(2), cells_, code, out.column(5)], names=["cell", "qb", "xb", "kind", "node", "n", "v", "probes", "code", "err"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kind, node, n = (t[c].to_numpy() for c in ("kind", "node", "n"))
        v = _unit(_matrix(t["v"].combine_chunks(), dim))
        x, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        a, b, found, back = [], [], np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        if len(x) and len(q):
            codes = np.frombuffer(b"".join(t["code"].take(pa.array(x)).to_pylist()), np.uint8).reshape(len(x), -1)
            label = np.arange(len(x))
            # A row that isn't itself looked for in a query's own cell would never find the query: it counts it here.
            homes, home = np.unique(t["probes"].take(pa.array(q)).combine_chunks().flatten().to_numpy(), return_inverse=True)
            probes = t["probes"].take(pa.array(x)).combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            at = np.minimum(np.searchsorted(homes, probes), len(homes) - 1)
            row, place = np.nonzero(homes[at] == probes)
            finds = np.zeros((len(x), len(homes)), bool)
            finds[row, at[row, place]] = True
            for qs, xs in _matches(v[q], v[x], node[q], node[x], codes, t["err"].to_numpy()[x], int(t["cell"][0].as_py()), quantiser, least):
                found += np.bincount(qs, n[x][xs], len(q)).astype(np.int64)
                alone = ~finds[xs, home[qs]]
                back += np.bincount(xs[alone], n[q][qs[alone]], len(x)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(qs)) + 1
                for one, mates in zip(qs[np.concatenate([[0], cuts])] if len(qs) else [], np.split(xs, cuts)):
                    roots = np.unique(label[mates])  # one edge to each part not yet joined
                    a.extend([node[q[one]]] * len(roots))
                    b.extend(node[x[roots]].tolist())
                    if len(roots) > 1:
                        label[np.isin(label, roots)] = roots[0]
        ends, totals = np.concatenate([node[q], node[x]]), np.concatenate([found, back])
        some = np.flatnonzero(totals)
        none = [None] * len(a)
        return pa.table({"node": pa.array([*ends[some].tolist(), *none], pa.int64()), "n": pa.array([*totals[some].tolist(), *none], pa.int64()), "a": pa.array([*[None] * len(some), *a], pa.int64()), "b": pa.array([*[None] * len(some), *b], pa.int64())})

    dealt = placed.mapInArrow(deal, "cell long, qb long, xb long, kind int, node long, n long, v array<double>, probes array<int>, code binary, err double")
    got = written(dealt.groupBy("cell", "qb", "xb").applyInArrow(compare, "node long, n long, a long, b long"))
    return got.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")), got.where("a is not null").select("a", "b")


def cosine_groups(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Two vectors of equal length are linked if their cosine, in double precision, is at least `least`. All links reported are exact; those of a pair
    neither of whose nearest cells holds the other are missed (recall is measured in the tests). n_links counts the other rows linked with the
    row; component_id is the smallest vec_id its links reach, itself included; kept: vec_id = component_id. Equal vectors are one class: copies
    are counted, never paired. Vectors that are null, empty, zero or hold null or non-finite components, and rows of null id (component null,
    kept false), link with nothing. Repeated ids keep a row each. An empty table gives an empty result. Other columns are left out.
    """
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0)))) & F.exists(v, lambda c: c != 0)
    rows = written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine & F.col(vec_id).isNotNull(), v).alias("v")))
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    counts, edges = None, None
    for r in sorted(classes.select(F.size("v").alias("dim")).distinct().collect()):
        c, e = _links_of_dim(classes.where(F.size("v") == r.dim), r.dim, least, block)
        counts, edges = (counts.union(c), edges.union(e)) if counts else (c, e)
    if counts is None:
        named = classes.select(F.col("v").alias("k"), F.col("node").alias("component"), F.col("n").alias("links")).limit(0)
    else:
        counts = counts.select("node", F.col("n").alias("found"))
        named = classes.join(counts, "node", "left").join(components(edges), "node", "left")
        named = named.select(F.col("v").alias("k"), F.coalesce("component", "node").alias("component"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links"))
    joined = rows.join(named, rows.v == named.k, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_pq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_groups(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, COALESCE(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
