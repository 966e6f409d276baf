"""Quality classifier: averaged vectors of hashed words, word pairs and character trigrams, a softmax over them, trained by stochastic gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import SPACES, crc32_of_id, discard, labelled_texts, table, written

#: Feature buckets (a power of two) and the width of a bucket's vector.
BUCKETS_LOG2, DIM = 18, 16
#: Labelled documents that the model is fitted on, at most: those of the smallest hashes of their ids.
SAMPLE = 6000
#: Buckets of all the documents that it is fitted on, at most.
ENTRIES = 40_000_000
#: Buckets that come to the driver at a time, more only where one document has more.
ARRIVING = 2_000_000
EPOCHS, RATE = 6, 0.6
#: Bytes whose features are made at a time; longer texts are taken in blocks that end at white space.
AT_ONCE = 1 << 20
#: The bucket of a word that follows itself.
REPEAT = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks(text: bytes, size: int = AT_ONCE) -> Iterator[tuple[bytes, bytes]]:
    """A long text in blocks of about `size` bytes, each with the two bytes before it; no word is cut, however long."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end - 1] not in SPACES:
            stop = min((i for s in SPACES if (i := text.find(bytes([s]), end, end + size)) >= 0), default=-2) + 1
            end = stop if stop > 0 else min(len(text), end + size)
        yield text[at:end], text[max(0, at - 2) : at]
        at = end


def features(text: bytes, size: int = AT_ONCE) -> Iterator[np.ndarray]:
    """Buckets of a text's words, pairs of neighbouring words (equal ones: REPEAT) and byte trigrams, block by block; together they are those of the
    whole text, wherever it is cut."""
    shift = np.uint64(64 - BUCKETS_LOG2)
    last = np.zeros(0, np.uint64)
    for body, before in blocks(text, size):
        wide = np.frombuffer(before + body, np.uint8).astype(np.uint64)
        tri = ((wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) + np.uint64(1 << 32)) * _ODD >> shift
        b, wide = np.frombuffer(body, np.uint8), wide[len(before) :]
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            yield tri.astype(np.int64)
            continue
        powers = np.cumprod(np.full(len(b), np.uint64(0x100000001B3)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * powers)])
        inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        word = (sums[end] - sums[start]) * _powers(inverse, start)  # a hash that doesn't depend on the place
        line = np.concatenate([last, word])
        pair = np.where(line[1:] == line[:-1], np.uint64(REPEAT), (line[1:] * np.uint64(31) + line[:-1]) * _ODD >> shift)
        last = word[-1:]
        yield np.concatenate([tri, word * _ODD >> shift, pair]).astype(np.int64)


def _powers(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n, modulo 2 ** 64."""
    out, square, n = np.ones(len(n), np.uint64), int(base), n.copy()
    while n.any():
        out[(n & 1) == 1] *= np.uint64(square)
        square, n = square * square % (1 << 64), n >> 1
    return out


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A whole text's buckets and their shares."""
    n, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for found in features(text):
        ids, counts = np.unique(found, return_counts=True)
        n, back = np.unique(np.concatenate([n, ids]), return_inverse=True)
        total = np.bincount(back, np.concatenate([total, counts])).astype(np.int64)
    return n, total / max(1, total.sum())


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, a bias): what the vectors and the softmax come to for the log odds of label 1."""
    rng = np.random.default_rng(7)
    n = 1 << BUCKETS_LOG2
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (n, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            x = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            if len(ids):
                # Shares are small: a bucket's step is in proportion to its share relative to the largest.
                vectors[ids] -= (rate * 8 * share / share.max())[:, None].astype(np.float32) * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Model:
    """Weights and bias, applied to whole texts."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for ids in features(text):
            total, n = total + float(self.weights[ids].sum(dtype=np.float64)), n + len(ids)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(n, 1), -500, 500))))

    def column(self, text: Column) -> Column:
        """The score of a text column, for use in any projection or filter."""
        model = self

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield pd.Series([model.score((t or "").encode()) for t in s], dtype="float64")

        return score(text)


def ranges(sizes: list[tuple[int, int]], most: int = ARRIVING) -> Iterator[tuple[int, int]]:
    """First and last key of runs of sorted (key, size), of `most` in all each or of one key."""
    first, held = None, 0
    for i, (key, n) in enumerate(sizes):
        if first is not None and held + n > most:
            yield first, sizes[i - 1][0]
            first, held = None, 0
        first, held = key if first is None else first, held + n
    if first is not None:
        yield first, sizes[-1][0]


def arrived(bags_of: DataFrame) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], int]]:
    """(ids, shares), label of rows in the order of their keys: copies of four bytes a number, so that no table stays with them."""
    got = bags_of.select("_key", "_label", "ids", "shares").toArrow()
    ids, shares = (got[c] for c in ("ids", "shares"))
    for i in np.argsort(got["_key"].to_numpy(), kind="stable").tolist():
        yield (np.array(ids[i].values, np.int32), np.array(shares[i].values, np.float32)), got["_label"][i].as_py()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Fits on at most `sample` labelled texts that labelled_texts() gives for `learn`, a condition on doc_id, and of these on no more than have
    `entries` buckets in all, so that the driver's memory is bounded whatever the texts' lengths. Texts are learned in the order of their hashes;
    equal hashes are one text. Without any row scores are 0.5."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [bag(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
                ids, shares = [r[0].astype(np.int32) for r in rows], [r[1].astype(np.float32) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["_key", "_label", "size", "ids", "shares"])

    rows = labelled_texts(docs, labels, learn, sample, doc_id, text, label)
    bags_of = written(rows.mapInArrow(count, "_key long, _label int, size long, ids array<int>, shares array<float>"))
    sizes = sorted((r._key, r.size) for r in bags_of.select("_key", "size").collect())  # `sample` rows at most
    upto = np.cumsum([n for _, n in sizes])
    sizes = [(k, n) for (k, n), total in zip(sizes, upto) if total <= entries]
    if not sizes:
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0)
    bags, marks = [], []
    for first, last in ranges(sizes):
        for found, label in arrived(bags_of.where(F.col("_key").between(first, last))):
            bags.append(found)
            marks.append(label)
    discard(rows, bags_of)
    model = Model(*train(bags, np.array(marks, np.int64)))
    del bags
    pa.default_memory_pool().release_unused()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted. Null text scores as empty: by the bias alone. Null and repeated ids keep a row each (null: not
    held out). Other columns are left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), model.column(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_documents(docs, fit(docs, labels, ~held_out()))
