"""Where the pipeline calls a model: plain defaults that need none, behind the same columns. A model's own column may take the place of each."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import compose as M
from gleanery.functions import japanese as J
from gleanery.operators import content_rules as V

#: Characters of a text that a vector is made of.
EMBEDDED = 8000


def embedded(text: Column, size: int = 256) -> Column:
    """A unit vector of hashed words and word pairs of the first EMBEDDED characters, lines joined; zero for a text without words, null for null."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for t in s:
                if t is None:
                    out.append(None)
                    continue
                words = t.replace("\n", " ")[:EMBEDDED].lower().split()
                v = np.zeros(size)
                for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h >> 31 else -1
                out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return vectors(text)


def embedding_text(title: Column, points: Column) -> Column:
    return F.concat_ws(" ", title, F.array_join(F.coalesce(points, F.array().cast("array<string>")), " "))


def extracted_summary(title: Column, content: Column, notice: str = "no summary") -> Column:
    """points, confidence and reliability: the text's first four sentences of 30 to 300 characters, if there are three; else its plain points, if these are
    valid; else a fallback of confidence 0."""
    said = F.slice(J.sentences(content), 1, 4)
    plain = F.slice(M.said_points(content), 1, 4)
    fallback = V.fallback_summary(title, content, notice)
    row = lambda p, c, r: F.struct(p.alias("points"), F.lit(c).alias("confidence"), F.lit(r).alias("reliability"))
    return F.when(F.size(said) >= 3, row(said, 0.8, "medium")).when(V.summary_is_valid(plain), row(plain, 0.3, "medium")).otherwise(row(fallback, 0.0, "low"))


def first_that_works(*tries: Column, accept: Callable[[Column], Column]) -> Column:
    """The first of several replies that is accepted, as retries and fallback models give them; null if none is."""
    return F.coalesce(*(F.when(accept(t), t) for t in tries))


def merged_points(df: DataFrame, group: str, points: str, order: str, n: int = 4) -> DataFrame:
    """group and points: the first n different points of a group's rows, in order of rows and places."""
    each = df.select(group, order, F.posexplode(points).alias("_at", "_p")).where(F.length("_p") > 0)
    one = each.groupBy(group, "_p").agg(F.min(F.struct(order, "_at")).alias("_o"))
    one = one.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_o", "_p"))).where(F.col("_r") <= n)
    return one.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_p"))), lambda x: x["_p"]).alias("points"))


def publish_status(dry_run: Column, has_client: Column, has_address: Column) -> Column:
    """What publishing would do: nothing in a dry run, else by the client, else by address, else it is skipped."""
    return F.when(dry_run, "dry_run").when(has_client, "cli").when(has_address, "http").otherwise("skipped")
