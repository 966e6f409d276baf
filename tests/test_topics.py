from gleanery import catalog
from gleanery.functions import text as T
from gleanery.operators import similarity as S
from gleanery.operators import topics as C
from gleanery.streaming import feeds

FOLDER = "/root/testdata/sf0.001"


def greedy(ids, pairs):
    near = {(a, b) for a, b in pairs}
    out = {}
    for i in sorted(ids):
        out[i] = next((j for j in sorted(out) if out[j] == j and (j, i) in near), i)
    return out


def test_leaders_match_the_greedy_scan(spark):
    import random

    dice = random.Random(3)
    pairs = [tuple(sorted(dice.sample(range(60), 2))) for _ in range(90)] + [(i, i + 1) for i in range(60, 75)]
    got = C.leader_groups(spark.range(80), spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:5]], "a long, b long"))
    assert {r.id: r.leader for r in got.collect()} == greedy(range(80), pairs)


def test_leaders_without_pairs(spark):
    got = C.leader_groups(spark.range(3), spark.createDataFrame([], "a long, b long"))
    assert {r.id: r.leader for r in got.collect()} == {0: 0, 1: 1, 2: 2}


def test_leaders_of_documents(spark):
    rows = [(r.id, set(r.t)) for r in catalog.articles(spark, FOLDER).select("id", T.words(catalog.F.col("content")).alias("t")).collect()]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(x & y) / len(x | y) >= 0.63]
    got = catalog.QUERIES["leader_groups"](spark, FOLDER).collect()
    assert {r.id: r.leader for r in got} == greedy([i for i, _ in rows], pairs)


def test_kmeans_gives_every_vector_a_group(spark):
    got = catalog.QUERIES["kmeans_groups"](spark, FOLDER)
    assert got.count() == catalog.read(spark, FOLDER, "embeddings").count()
    assert got.select("group").distinct().count() == 10


def test_variables(spark):
    assert spark.createDataFrame([("{{ a }} {{b}} {{a}} {c}",)], "t string").select(T.variables(catalog.F.col("t"))).first()[0] == ["a", "b"]


def test_streams(spark, tmp_path):
    schema = "k long, ts timestamp, value double"
    folder = str(tmp_path / "in")
    spark.sql("select id % 7 as k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, cast(id as double) as value from range(200)").repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert run(feeds.fresh(stream, ["k"], "ts"), "append", "fresh").count() == 7
    hours = run(feeds.windowed(stream, "ts", "1 hour", "1 hour"), "complete", "hours").collect()
    assert sorted(r.n for r in hours) == [20, 60, 60, 60] and sum(r.total for r in hours) == sum(range(200))
    assert sorted(r.n for r in run(feeds.sessions(stream, "ts", "1 hour", "10 minutes", "k"), "complete", "runs").collect()) == [28] * 3 + [29] * 4
    rates = run(feeds.error_rate(stream, "ts", "1 hour", "1 day", catalog.F.col("value") < 50), "complete", "rates").collect()
    assert [(r.n, r.rate) for r in rates] == [(200, 0.25)]
    out = str(tmp_path / "out")
    for n in range(2):
        stream.writeStream.foreachBatch(feeds.append_new(out, ["k"])).option("checkpointLocation", str(tmp_path / f"again{n}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 7
