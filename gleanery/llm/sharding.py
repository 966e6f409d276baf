"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

SEED_STEP = 1_000_003


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that scores highest for a key: shard j scores -w_j / ln(u_j), u_j a hash of key and j in (0, 1).

    A shard that is added, or whose weight grows, only takes keys into itself; nothing else moves. Null keys go as one key. Ties (none in
    practice) go to the larger shard number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    tries = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard * SEED_STEP)), 11)
        unit = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        tries.append(F.struct((F.lit(float(weight)) / -F.log(unit)).alias("s"), F.lit(shard).alias("j")))
    return F.greatest(*tries)["j"] if len(tries) > 1 else F.lit(0)


def numbered(rows: DataFrame, group: str, groups: int) -> DataFrame:
    """Adds slot, gapless from 0 in each value 0..groups-1 of the int column group, without moving the rows.

    Each partition numbers its own rows; the parts' counts, one row for each part and group, are summed up to offsets. The numbered parts are
    written first, so that offsets and rows come from the same reading whatever executor is lost. Null groups aren't allowed.
    """
    schema = pa_names = rows.columns
    spark_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(groups, np.int64)
        for batch in batches:
            at = batch.column(schema.index(group)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sizes = np.bincount(at, minlength=groups)
            local = np.empty(len(at), np.int64)
            local[order] = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            local += seen[at]
            seen += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part)), pa.array(local)], names=[*pa_names, "_part", "_local"])

    parts = written(rows.mapInArrow(count, f"{spark_schema}, _part long, _local long"))
    counts = parts.groupBy("_part", group).agg(F.count("*").alias("_n"))
    before = counts.selectExpr("_part", f"`{group}`", f"sum(_n) over (partition by `{group}` order by _part) - _n as _before")
    return parts.join(before, ["_part", group]).withColumn("slot", F.col("_local") + F.col("_before")).select(*pa_names, "slot")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law 'key', shard, slot, grown_shard.

    The id and the shards' weights alone decide. size: UTF-8 bytes plus 1. Null text counts as no bytes (crc32 0); null ids go together to one
    shard; repeated rows go to the same shard, each with a slot of its own. An empty table gives an empty result. Other columns are left out.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    key, words = F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(words) + 1).cast("long").alias("size"),
        F.crc32(words).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
    )
    return numbered(rows, "shard", len(weights)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)
