"""Queries on written tables, logs, vectors and their statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.catalog import ARTICLES, query
from gleanery.operators import audits as A
from gleanery.operators import sinks as K
from gleanery.operators.topics import shared_path
from gleanery.sources.tables import articles, read

ONLY = f"WITH {ARTICLES}\n"


def scratch(spark: SparkSession) -> str:
    return shared_path(spark, "tables")


@query("dated_documents", ONLY + "SELECT year(published) AS year, month(published) AS month, count(*) AS n, sum(length(content)) AS characters FROM articles GROUP BY ALL")
def dated_documents(spark, folder):
    path = scratch(spark)
    K.dated_documents(articles(spark, folder).select("id", "content", "published"), path, "published")
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"))


@query("document_index", ONLY + """SELECT year(published) AS year, month(published) AS month, count(*) AS n, array_to_string(list(strftime(published, '%Y-%m-%d_%H%M') || '_' || source_id || '_newsletter.md' ORDER BY published DESC, id DESC), ',') AS files FROM articles GROUP BY ALL""")
def document_index(spark, folder):
    rows = articles(spark, folder).withColumn("file", K.file_name(F.col("published"), F.col("source_id")))
    return K.index_of(rows, "published").withColumn("files", F.array_join("files", ","))


@query("dates_of_files", ONLY + "SELECT id, year(published) AS year, month(published) AS month FROM articles WHERE id % 3 <> 0")
def dates_of_files(spark, folder):
    name = F.when(F.col("id") % 3 != 0, K.file_name(F.col("published"), F.col("source_id"))).otherwise(F.lit("notes.md"))
    return K.dates_of_files(articles(spark, folder).withColumn("file", name)).select("id", "year", "month")


@query("run_log_table", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS duration, coalesce(string_agg(event_id, '; ' ORDER BY ts, event_id) FILTER (event_type = 'error'), '') AS error_details,
  CASE WHEN count(*) FILTER (event_type = 'error') * 2 > count(*) THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY 1""")
def run_log_table(spark, folder):
    events, path = read(spark, folder, "events"), scratch(spark)
    half = events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    for part in (events.where(F.col("ts") <= half), events):  # written, then replaced by what is newer
        K.run_logs(part, path, ["user_id"], "user_id", "ts", "value", F.col("event_type") == "error", F.col("event_id").cast("string"))
    return spark.read.parquet(path).select("user_id", "n", "errors", F.round("duration", 4).alias("duration"), "error_details", "status")


@query("missing_inserted", "SELECT event_type, user_id, min(event_id) AS event_id FROM events WHERE event_id = (SELECT min(event_id) FROM events e WHERE e.event_type = events.event_type AND e.user_id = events.user_id) GROUP BY ALL")
def missing_inserted(spark, folder):
    rows, path = read(spark, folder, "events").select("event_type", "user_id", "event_id"), scratch(spark)
    first = rows.groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))
    K.insert_missing(first, path, ["event_type", "user_id"])
    K.insert_missing(rows, path, ["event_type", "user_id"])
    return spark.read.parquet(path)


@query("pruned_table", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS kept FROM events")
def pruned_table(spark, folder):
    path = scratch(spark)
    read(spark, folder, "events").write.parquet(path)
    deleted = K.prune_table(spark, path, "ts", F.expr("timestamp'2024-01-10'"))
    return spark.read.parquet(path).agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("kept"))


@query("refreshed_vectors", "SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY 1")
def refreshed_vectors(spark, folder):
    vectors, path = read(spark, folder, "embeddings"), scratch(spark)
    text = F.when(F.col("vec_id") % 14 == 0, "[1, 2").when(F.col("vec_id") % 7 == 0, "[1.0, 2.0]").otherwise(F.to_json("embedding"))
    history = vectors.select("vec_id", "label", text.alias("text"), F.expr("timestamp'2024-01-01'").alias("at"))
    for _ in range(2):  # the second takes the first one's place
        K.refresh_vectors(history, path, F.expr("timestamp'2023-12-31'"), "at", "text", 64)
    got = spark.read.parquet(path)
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


@query("recent_rows", ONLY + "SELECT id, published FROM articles WHERE published >= TIMESTAMP '2024-01-03' ORDER BY published DESC, id LIMIT 1000")
def recent_rows(spark, folder):
    return K.recent(articles(spark, folder), "published", F.expr("timestamp'2024-01-03'"), "id", 1000).select("id", "published")


@query("key_breaches", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def key_breaches(spark, folder):
    return K.key_breaches(read(spark, folder, "events"), ["user_id", "event_type"])


@query("orphan_rows", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY 1")
def orphan_rows(spark, folder):
    kept = read(spark, folder, "orders").where("o_orderkey % 3 != 0")
    return K.orphans(read(spark, folder, "lineitem"), "l_orderkey", kept, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("migrated_rows", "SELECT doc_id, lang, 'none' AS topic, false AS is_update FROM documents")
def migrated_rows(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", "lang")
    return K.migrated(rows, {"lang": ("string", "xx"), "topic": ("string", "none"), "is_update": ("boolean", False)})


@query("restored_texts", ONLY + "SELECT id, CASE WHEN id % 2 = 0 THEN title || ' ' || source_id ELSE title END AS title FROM articles WHERE NOT ends_with(title, '...')")
def restored_texts(spark, folder):
    rows = articles(spark, folder).where(~F.endswith("title", F.lit("..."))).withColumn("text", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit("..."))).otherwise(F.col("title")))
    return K.restored_texts(rows, "text", "title", "source_id").select("id", F.col("text").alias("title"))


@query("json_lines_table", "SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'click') GROUP BY 1")
def json_lines_table(spark, folder):
    rows, path = read(spark, folder, "events").select("event_id", "event_type"), scratch(spark)
    K.append_json(rows, path)
    K.append_json(rows.where("event_type = 'click'"), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("store_audit", ONLY + "SELECT count(*) AS n, min(published) AS first, max(published) AS last, count(DISTINCT CAST(published AS DATE)) AS days, count(DISTINCT source_id) AS sources FROM articles")
def store_audit(spark, folder):
    return A.store_audit(articles(spark, folder), "published", "source_id")


@query("rows_by_source", ONLY + "SELECT source_id, count(*) AS n FROM articles GROUP BY 1")
def rows_by_source(spark, folder):
    return A.by_source(articles(spark, folder), "source_id")


@query("count_parity", "SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right")
def count_parity(spark, folder):
    return A.parity(read(spark, folder, "documents"), read(spark, folder, "labels"), "doc_id")


@query("vector_stats", "SELECT count(*) AS n, max(len(embedding)) AS dimension, sum(len(embedding)) * 4 AS bytes FROM embeddings")
def vector_stats(spark, folder):
    return A.vector_stats(read(spark, folder, "embeddings"), "embedding").select("n", F.col("dimension").cast("long").alias("dimension"), "bytes")


@query("stage_telemetry", "SELECT event_type, count(*) AS runs, round(avg(CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 1.0 END), 6) AS completed, round(sum(user_id) / sum(event_id + 1), 6) AS efficiency FROM events GROUP BY 1")
def stage_telemetry(spark, folder):
    rows = read(spark, folder, "events").withColumn("ins", F.col("event_id") + 1)
    return A.stage_telemetry(rows, "event_type", "ins", "user_id", F.col("user_id") % 5 == 0).select("event_type", "runs", F.round("completed", 6).alias("completed"), F.round("efficiency", 6).alias("efficiency"))


@query("stage_log", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS duplicates, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events")
def stage_log(spark, folder):
    return A.stage_log(read(spark, folder, "events"), F.col("event_type") == "error").withColumn("rate", F.round("rate", 6))


@query("session_summary", """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1)
SELECT e.user_id, round(avg(value), 4) AS quality, round(sum(value) / 1000, 6) AS cost, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM k WHERE k.user_id = e.user_id) AS events, (SELECT k FROM t WHERE t.user_id = e.user_id) AS tokens FROM events e GROUP BY 1""")
def session_summary(spark, folder):
    rows = read(spark, folder, "events").withColumns({"tokens": F.from_json("props", "map<string,long>"), "cost": F.col("value") / 1000})
    out = A.session_summary(rows, "user_id", "event_type", "tokens", "value", "cost")
    told = F.array_join(F.transform(F.map_entries("events"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("user_id", F.round("quality", 4).alias("quality"), F.round("cost", 6).alias("cost"), told.alias("events"), F.element_at("tokens", "k").alias("tokens"))


@query("errors_by_type", """WITH x AS (SELECT *, max(ts) OVER () AS now FROM events), k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT x.user_id, count(*) AS total, count(*) FILTER (ts > now - INTERVAL 1 HOUR) AS last_hour, arg_max(event_id, ts) AS last, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM k WHERE k.user_id = x.user_id) AS types FROM x GROUP BY 1""")
def errors_by_type(spark, folder):
    rows = read(spark, folder, "events")
    now = rows.agg(F.max("ts")).first()[0]
    out = A.errors_by_type(rows, "user_id", "event_type", "ts", "event_id", F.lit(now))
    return out.withColumn("types", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query("ring_buffer", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def ring_buffer(spark, folder):
    return A.ring(read(spark, folder, "events"), "user_id", 100, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")


@query("degradation", """WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT user_id, errors / n > 0.5 OR errors > 10 AS degrades, CASE WHEN errors > 20 THEN 'minimal' WHEN errors > 15 THEN 'reduced' WHEN errors > 10 THEN 'limited' WHEN errors > 0 THEN 'watch' ELSE 'full' END AS level FROM e""")
def degradation(spark, folder):
    rows = read(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return rows.select("user_id", A.degrades(F.col("errors") / F.col("n"), F.lit(0.0), F.col("errors")).alias("degrades"), A.degradation(F.col("errors")).alias("level"))


@query("breaker_states", """WITH o AS (SELECT user_id, ts, event_id, event_type <> 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, ok ORDER BY i) AS run FROM o), r AS (SELECT user_id, ok, run, count(*) AS n, min(i) AS first FROM g GROUP BY ALL),
d AS (SELECT user_id, arg_max(ok, first) AS ok FROM r WHERE (ok AND n >= 3) OR (NOT ok AND n >= 2) GROUP BY 1)
SELECT u.user_id, CASE WHEN coalesce(d.ok, true) THEN 'closed' ELSE 'open' END AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN d USING (user_id)""")
def breaker_states(spark, folder):
    return A.breaker(read(spark, folder, "events"), "user_id", F.col("event_type") != "click", F.asc("ts"), F.asc("event_id"), failures=2)


@query("topic_names", ONLY + """, e AS (SELECT source_id, id, unnest(regexp_extract_all(translate(content, 'àâäçéèêëîïôöùûüßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ', '#######################################'), '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b')) AS name, generate_subscripts(regexp_extract_all(translate(content, 'àâäçéèêëîïôöùûüßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ', '#######################################'), '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b'), 1) AS pos FROM articles),
n AS (SELECT source_id, name, count(*) AS n, min(id * 1000000 + pos) AS earliest FROM e WHERE length(name) BETWEEN 3 AND 30 GROUP BY ALL)
SELECT source_id, name FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, earliest) AS r FROM n) WHERE r = 1""")
def topic_names(spark, folder):
    rows = articles(spark, folder).withColumn("content", F.translate("content", "àâäçéèêëîïôöùûüßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ", "#" * 39))
    return A.topic_name(rows, "source_id", "content", "id")


@query("priorities", ONLY + "SELECT id, CASE source_id WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END AS priority, CASE source_id WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'second' ELSE 'third' END AS description FROM articles")
def priorities(spark, folder):
    return A.priorities(articles(spark, folder), "source_id", {"src1": 1, "src2": 2}, {1: "first", 2: "second", 3: "third"}).select("id", "priority", "description")


@query("publication_summary", ONLY + "SELECT source_id AS edition, strftime(published, '%Y-%m-%d') AS date, id AS articles, round(priority / 3.0, 2) AS quality, length(content) // 10 * 10 + 3 AS words, printf('%.1f min', (length(content) // 10 * 10 + 3) / 200.0) AS read_time FROM articles")
def publication_summary(spark, folder):
    rows = articles(spark, folder).select(F.col("source_id").alias("edition"), F.col("published").alias("created"), F.col("id").alias("articles"), (F.col("priority") / 3.0).alias("quality"), (F.floor(F.length("content") / 10) * 10 + 3).alias("words"))
    return A.publication_summary(rows)


@query("log_rows", """SELECT 'call' AS kind, CAST(event_id AS VARCHAR) AS key, '{"value":"' || event_type || '"}' AS value, ts AS time FROM events""")
def log_rows(spark, folder):
    return A.log_rows(read(spark, folder, "events"), "call", F.col("event_id"), F.col("event_type"), F.col("ts"))


@query("found_prompts", "SELECT doc_id FROM documents WHERE contains(lower('p' || doc_id || ' ' || text), 'ther') AND lang IN ('en', 'de') AND source IN ('src1', 'src2')")
def found_prompts(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("name"), "text", F.array("lang").alias("tags"), F.array("source").alias("variables"), F.col("n_chars").alias("uses"))
    return A.found_prompts(rows, "ther", ["en", "de"], ["src1", "src2"]).select("doc_id")
