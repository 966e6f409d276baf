"""Rows that every operator on documents must take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("key", T.StringType())]
)

ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, "One TWO"), (6, "One TWO"), (None, "one two"), (7, None),
    (8, "word " * 40_000), (9, "é ñ ß 漢字 ▁ \x00 😀 end"), (10, "a  b\n\n c \r\n\t d  "), (11, "<|endoftext|> x 3.14 don't"), (None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "n", 0.5, "k") for i, t in rows], DOCS)


def docs_of(spark, sf="sf0.001"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
