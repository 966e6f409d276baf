import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import topk

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("score", T.LongType())])


def brute(rows, k, step):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % step == 0}):
        v = min(v for i, v in fine if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_against_all_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2010, []), (2020, [1.0] * 7 + [float("nan")]), (2030, [1.0] * 7 + [float("inf")]), (2040, [None] * 8), (None, [1.0] * 8), (2050, [1.0] * 3), (2055, [2.0] * 3), (2060, [0.0] * 8), (2070, [60000.0] * 8), (2080, [-60000.0] * 8), (2090, [1e5, -1e8, *[1.0] * 6]), (2100, [3e5, 2e5, 70000.0, -1e6, 1e7, *[0.5] * 3]), (2110, [0.0, 0.0, 1e8, *[1.5] * 5]), (10, rows[10][1]), (20, [3.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "v", 2) for i, v in rows], VECS).repartition(6)
    for block in (1024, 16):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, block=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, 10)


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30], 1, "v", 2), (1, [1e30], 1, "v", 2)], VECS)
    with pytest.raises(Exception, match="2\\^61"):
        topk.top_k(df, F.col("vec_id") % 10 == 0).count()


def test_few_rows_and_none(spark):
    assert topk.top_k(spark.createDataFrame([], VECS), F.col("vec_id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0], 1, "v", 2), (1, [-1.0], 1, "v", 2)], VECS)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, -65536)]
