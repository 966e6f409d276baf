"""What the operators share: written tables, connected components, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a word is: a run of bytes other than the space and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task reads at a time (or one text).
AT_ONCE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors and driver share; a temporary one only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/gleanery-checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, partition_by: str | None = None, add_to: str | None = None) -> DataFrame:
    """The same rows, read again from a table in the shared folder: it cuts the lineage and survives lost executors. add_to: after the rows of the
    table there, one that was made before."""
    path = add_to or f"{shared_folder(df.sparkSession)}/gleanery/{uuid.uuid4().hex}"
    out = df.write.mode("append").option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more; what it didn't make is left alone."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about AT_ONCE bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, sample: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(_key, _label, _text): at most `sample` labelled texts to learn from, of ids that `learn` admits; those of the smallest hashes.

    Labels other than 0 and 1, null ids and ids without a document are left out. A repeated id takes its larger label; a row that repeats an id and
    its text counts once, so that the bound holds whatever is repeated. _key is a hash of id and text.
    """
    picked = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    picked = picked.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so many short rows at most
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id").select(F.xxhash64("_id", "_text").alias("_key"), "_label", "_text")
    last = rows.select("_key").distinct().orderBy("_key").limit(sample).agg(F.max("_key")).first()[0]
    kept = rows.where(F.col("_key") <= F.lit(last)) if last is not None else rows.limit(0)
    return written(kept.groupBy("_key").agg(F.first("_label").alias("_label"), F.first("_text").alias("_text")))


def all_labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str) -> DataFrame:
    """(_key, _label, _text): what labelled_texts() gives, but of all labelled texts. Ids and texts are compared where the join put them."""
    picked = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label")).where("_id is not null")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(picked, "_id").withColumn("_key", F.xxhash64("_id", "_text"))
    return written(rows.groupBy("_id", "_key").agg(F.first("_label").alias("_label"), F.first("_text").alias("_text")).select("_key", "_label", "_text"))


def crc32_of_id(doc_id: str) -> Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b) of longs that has another end; component is the smallest node reachable.

    Alternating large-star and small-star steps: each step joins the edges with one smallest neighbour per node, so that no group of neighbours
    is ever gathered in a task; hot nodes are split by the skew join. Edges with a null end and loops are left out. Every round is written; earlier rounds are deleted.
    """
    rows = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    rows = written(rows.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (now := _signature(rows)) != seen:
        seen, before = now, rows
        both = rows.union(rows.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, large.u == least.k).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = written(small.union(least.select("k", "m")).distinct())
        discard(before, large)
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _signature(rows: DataFrame) -> tuple:
    one = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(one)
