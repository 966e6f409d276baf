import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery import catalog
from gleanery.functions import hash_order


@pytest.mark.parametrize("n", [0, 1, 8, 13, 14, 60, 300, 3000])
def test_distinct_as_by_duckdb(n):
    draw = random.Random(n)
    words = ["".join(draw.choices("abcdefghé日", k=draw.randint(1, 20))) for _ in range(n)]
    words += words[: n // 2]
    assert hash_order.distinct(words) == duckdb.execute("select list_distinct(?::varchar[])", [words]).fetchall()[0][0]


def test_related_terms_of_long_titles(spark, tmp_path):
    """Titles with over eight different words of over five letters are cut as the SQL cuts them."""
    draw = random.Random(7)
    stock = ["".join(draw.choices("abcdefghijk", k=draw.randint(6, 9))) for _ in range(16)]
    rows = [(i, " ".join(draw.sample(stock, 14)) + ".", "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "made"))
    made = next((tmp_path / "made").glob("*.parquet"))
    made.rename(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(f"select a, b, related from ({catalog.ORACLE_SQL['related_terms']})").fetchall())
    got = catalog.QUERIES["related_terms"](spark, str(tmp_path)).select("a", "b", F.col("related"))
    assert sorted(map(tuple, got.collect())) == want
    assert 0 < sum(r[2] for r in want) < len(want)
