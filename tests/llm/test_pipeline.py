import corpus_pipeline
from gleanery.llm import quality, toxicity
from tests.llm.test_classifiers import corpus, frames


def test_stages(spark, tmp_path):
    docs, labels, rows, marks = frames(spark)
    copies = docs.where("doc_id between 100 and 130").selectExpr("doc_id + 5000 doc_id", "text || ' indeed'", "lang", "source", "n_chars", "node", "score", "key")
    docs = docs.union(copies)
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    good, toxic = {i: q for i, q, _, _ in marks}, {i: t for i, _, t, _ in marks}
    one = corpus_pipeline.keep_quality(spark, docs, folder)
    kept = {r.doc_id for r in one.collect()}
    model = quality.fit(docs, labels, ~quality.held_out())
    assert one.columns == docs.columns and kept == {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) >= 0.5}
    assert sum(good[i] for i in kept if i in good) > 0.95 * sum(good.values())
    two = corpus_pipeline.drop_toxic(spark, one, folder)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect() if model.score(r.text or "") < 0.5}
    three = corpus_pipeline.one_of_each(spark, two, folder).collect()
    ids = [r.doc_id for r in three]
    both = {r.doc_id for r in two.collect()}
    pairs = [i for i in range(100, 131) if i in both and i + 5000 in both]
    assert pairs and all(not (i in ids and i + 5000 in ids) for i in pairs if len(dict(rows)[i].split()) > 40)
    assert sum(i in ids for i in both if i is not None and i < 100) == sum(i is not None and i < 100 for i in both)
    last = corpus_pipeline.run(spark, folder)
    got = last.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in got} == set(ids)


def test_corpus_is_as_marked():
    assert len(corpus()[0]) == 600


def test_one_row_of_each_group_stays(spark):
    """Repeated ids with different texts, repeated rows, rows without an id: no text is lost and none stays twice."""
    from collections import Counter

    from tests.llm.cases import ODD, frame

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = b + " more"
    docs = frame(spark, [(1, a), (5, a), (5, b), (9, near), (9, near), (None, "alone here"), (None, a), (7, "last"), (7, "last")])
    for parts in (1, 4):
        got = corpus_pipeline.one_of_each(spark, docs.repartition(parts), "")
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (5, b), (None, "alone here"), (7, "last")])
    odd = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, frame(spark, ODD), "").collect())
    assert odd == Counter({(1, None): 1, (4, "one"): 1, (5, "one two"): 1, (8, "word " * 40_000): 1, **{r: 1 for r in ODD[10:13]}})
    assert corpus_pipeline.one_of_each(spark, frame(spark, []), "").count() == 0


def test_empty_tables(spark, tmp_path):
    from tests.llm.cases import frame

    folder = f"file://{tmp_path}"
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
