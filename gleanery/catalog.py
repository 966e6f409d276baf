"""All queries of the library with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import relevance as R
from gleanery.operators import similarity as S
from gleanery.operators import stores as K
from gleanery.operators import topics as C
from gleanery.operators import validate as V
from gleanery.sources.tables import articles, read
from gleanery.streaming import feeds

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A word list for the test corpus; the tiers' words are parameters of the operator.
LEXICON = {"high": ["therean", "enonth", "ththan", "ingthe"], "medium": ["tion", "her", "ther", "thing"], "low": ["the", "of", "and", "with"], "negative": ["das", "die", "les", "que"]}

ARTICLES = """articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS content, source AS source_id,
    CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 4 + 1 AS priority,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS published, doc_id AS ord
  FROM documents)"""
_WC = "len(list_filter(regexp_split_to_array(content, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> ''))"


def _tier(tier: str) -> str:
    listed = ", ".join(f"'{w}'" for w in LEXICON[tier])
    return f"CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[a-z]+')), [{listed}])) AS BIGINT)"


SCORED = f"""scored AS (
  SELECT *, least(greatest((3.0 * n_high + 1.5 * n_medium + 0.5 * n_low - n_negative) / greatest(wc / 100.0, 0.01), 0.0), 1.0) AS score
  FROM (SELECT *, {_tier("high")} AS n_high, {_tier("medium")} AS n_medium, {_tier("low")} AS n_low, {_tier("negative")} AS n_negative, {_WC} AS wc FROM articles))"""
WITH = f"WITH {ARTICLES}, {SCORED}\n"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return R.lexicon_score(articles(spark, folder), LEXICON)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Scored articles, near copies left out, the best of each source, best first."""
    rows = scored(spark, folder).withColumn("tokens", T.words(F.col("content")))
    fresh = rows.drop("tokens").join(S.later_copies(rows.select("id", "tokens"), 0.88), "id", "left_anti")
    best = R.best_of_each(fresh, "source_id", 3, F.desc("score"), F.asc("ord"))
    return best.select("id", "source_id", "priority", "score", F.col("rank").cast("long").alias("rank")).orderBy("priority", F.desc("score"), "id").limit(30)


query("flagship_selection", WITH + """, tok AS (
  SELECT id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), ' '),
    lambda w: w <> '' AND w NOT IN (STOPS)))) AS t FROM articles),
dup AS (SELECT DISTINCT b.id FROM tok a JOIN tok b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= 0.88 * greatest(len(a.t), len(b.t))
  WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.88),
r AS (SELECT id, source_id, priority, score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, ord) AS rank FROM scored WHERE id NOT IN (SELECT id FROM dup))
SELECT * FROM r WHERE rank <= 3 ORDER BY priority, score DESC, id LIMIT 30""".replace("STOPS", ", ".join(f"'{w}'" for w in T.STOP_WORDS)))(flagship)


@query("lexicon_score", WITH + "SELECT id, n_high, n_medium, n_low, n_negative, score FROM scored")
def lexicon_score(spark, folder):
    return scored(spark, folder).select("id", "n_high", "n_medium", "n_low", "n_negative", "score")


@query("score_bucket", WITH + "SELECT CASE WHEN score >= 0.8 THEN 'very high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM scored GROUP BY 1")
def score_bucket(spark, folder):
    return scored(spark, folder).groupBy(R.score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


@query("dynamic_threshold", WITH + """, p AS (SELECT count(*) FILTER (score >= 0.9) AS n, count(*) AS a FROM scored),
nth AS (SELECT min(score) AS s FROM (SELECT score FROM scored ORDER BY score DESC LIMIT 40)),
t AS (SELECT CASE WHEN n >= 40 THEN 0.9 ELSE least(0.9, greatest(0.15, CASE WHEN a >= 40 THEN s ELSE 0 END)) END AS t FROM p, nth)
SELECT id, score, score >= 0.9 AS passed FROM scored, t WHERE score >= t""")
def dynamic_threshold(spark, folder):
    return R.dynamic_threshold(scored(spark, folder), 0.9, 40).select("id", "score", "passed")


@query("threshold_relax", WITH + """, t AS (SELECT CASE WHEN count(*) FILTER (score >= 0.5) >= 100 THEN 0.5 WHEN count(*) FILTER (score >= 0.5 * 0.9) >= 100 THEN 0.5 * 0.9
  WHEN count(*) FILTER (score >= 0.5 * 0.9 * 0.9) >= 100 THEN 0.5 * 0.9 * 0.9 ELSE 0.5 * 0.9 * 0.9 * 0.9 END AS t FROM scored)
SELECT id, round(score, 6) AS score FROM scored, t WHERE score >= t""")
def threshold_relax(spark, folder):
    return R.relaxed_threshold(scored(spark, folder), 0.5, 100).select("id", F.round("score", 6).alias("score"))


@query("per_source_cap", WITH + "SELECT id, source_id, rank FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS rank FROM articles) WHERE rank <= 5")
def per_source_cap(spark, folder):
    return R.best_of_each(articles(spark, folder), "source_id", 5, F.asc("ord")).select("id", "source_id", F.col("rank").cast("long").alias("rank"))


@query("priority_topk", WITH + "SELECT id, priority, published FROM articles ORDER BY priority, published DESC, ord LIMIT 30")
def priority_topk(spark, folder):
    return articles(spark, folder).orderBy("priority", F.desc("published"), "ord").limit(30).select("id", "priority", "published")


@query("backfill_min", WITH + """, c AS (SELECT id, score, false AS filled FROM scored WHERE priority = 1 AND score >= 0.999),
m AS (SELECT id, score, true AS filled, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored WHERE id NOT IN (SELECT id FROM c))
SELECT * FROM c UNION ALL SELECT id, score, filled FROM m WHERE r <= 200 - (SELECT count(*) FROM c)""")
def backfill_min(spark, folder):
    rows = scored(spark, folder).select("id", "priority", "score")
    chosen = rows.where("priority = 1 and score >= 0.999")
    return R.back_fill(chosen, rows, 200, "id", F.desc("score"), F.asc("id")).select("id", "score", "filled")


@query("lookback", WITH + "SELECT id, published FROM articles WHERE published >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 48 HOUR AND CAST(published AS DATE) <> DATE '2024-01-09'")
def lookback(spark, folder):
    rows = articles(spark, folder).where("published >= timestamp'2024-01-10 00:00:00' - interval 48 hours")
    return rows.where("to_date(published) <> date'2024-01-09'").select("id", "published")


_H = "regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '')"
_BASE = "regexp_extract(regexp_extract(url, '^([^#]*)', 1), '^([^?]*)', 1)"
_KEPT = "array_to_string(list_filter(string_split(regexp_extract(regexp_extract(url, '^([^#]*)', 1), '\\?(.*)$', 1), '&'), lambda p: split_part(p, '=', 1) IN ('id', 'post_id', 'article_id', 'p', 'postid')), '&')"
_NORM = f"lower(regexp_extract({_BASE}, '^([^/]*//[^/]*)', 1)) || regexp_replace(regexp_replace({_BASE}, '^[^/]*//[^/]*', ''), '/+$', '') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"


@query("url_normalize", f"SELECT page_id, {_H} AS host, {_NORM} AS normal FROM pages")
def url_normalize(spark, folder):
    return read(spark, folder, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.normalise_url(F.col("url")).alias("normal"))


@query("url_dedup", f"SELECT min(page_id) AS page_id, {_NORM} AS normal, count(*) AS n FROM pages GROUP BY 2")
def url_dedup(spark, folder):
    rows = read(spark, folder, "pages").select("page_id", T.normalise_url(F.col("url")).alias("normal"))
    return rows.groupBy("normal").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("host_bonus", f"SELECT {_H} AS host, CASE WHEN contains({_H}, '.org') THEN 0.2::DOUBLE WHEN contains({_H}, 'example.com') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS bonus, count(*) AS n FROM pages GROUP BY ALL")
def host_bonus(spark, folder):
    host = T.url_host(F.col("url"))
    rows = read(spark, folder, "pages").select(host.alias("host"))
    return rows.groupBy("host", F.when(F.col("host").contains(".org"), 0.2).when(F.col("host").contains("example.com"), 0.15).otherwise(0.0).alias("bonus")).agg(F.count("*").alias("n"))


@query("html_text", """WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN length(t) > 2000 THEN t[:2000] || '...' ELSE t END AS text FROM p""")
def html_text(spark, folder):
    return read(spark, folder, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, folder):
    return read(spark, folder, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("lang_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 1), 6) AS latin FROM documents")
def lang_ratio(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.round(T.script_shares(F.col("text"))["latin"], 6).alias("latin"))


@query("sentences", "SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 30 AND 300)) AS INTEGER) AS n FROM documents")
def sentences(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("slugs", WITH + "SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g')[:50], '^-+|-+$', '', 'g') AS slug FROM articles")
def slugs(spark, folder):
    return articles(spark, folder).select("id", T.slug(F.col("title")).alias("slug"))


@query("article_ids", WITH + "SELECT id, source_id || '_' || strftime(published, '%Y%m%d') || '_' || md5(source_id || title || strftime(published, '%Y%m%d'))[:8] AS article_id FROM articles")
def article_ids(spark, folder):
    day = F.date_format("published", "yyyyMMdd")
    return articles(spark, folder).select("id", F.concat_ws("_", "source_id", day, F.substring(F.md5(F.concat("source_id", "title", day)), 1, 8)).alias("article_id"))


@query("jaccard_pairs", WITH + """, tok AS (SELECT id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), ' '),
    lambda w: w <> '' AND w NOT IN (STOPS)))) AS t FROM articles),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) + len(b.t) AS s FROM tok a JOIN tok b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)))
SELECT a, b, round(c / (s - c), 6) AS similarity, CASE WHEN c / (s - c) > 0.95 THEN 'duplicate' WHEN c / (s - c) > 0.8 THEN 'duplicate' ELSE 'unrelated' END AS relation FROM p WHERE c / (s - c) >= 0.8""".replace("STOPS", ", ".join(f"'{w}'" for w in T.STOP_WORDS)))
def jaccard_pairs(spark, folder):
    rows = articles(spark, folder).select("id", T.words(F.col("content")).alias("tokens"))
    pairs = S.jaccard_pairs(rows, 0.8)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"), S.relationship(F.col("similarity"), F.lit(False), F.lit(False)).alias("relation"))


@query("knn_topk", """WITH s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS sim
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id < 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.2)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5""")
def knn_topk(spark, folder):
    vectors = read(spark, folder, "embeddings")
    out = S.knn(vectors.where("vec_id < 20"), vectors, 5, 0.2)  # the operator searches for a few queries; twenty are asked here
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query("knn_every_50th", """WITH s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS sim
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.2)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5""")
def knn_every_50th(spark, folder):
    vectors = read(spark, folder, "embeddings")
    out = S.knn(vectors.where("vec_id % 50 = 0"), vectors, 5, 0.2)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query("cluster_confidence", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.label, avg(list_inner_product(a.e, b.e)) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT label, (SELECT count(*) FROM v WHERE v.label = p.label) AS n, round(c, 6) AS confidence FROM p""")
def cluster_confidence(spark, folder):
    return S.mean_pair_similarity(read(spark, folder, "embeddings"), "label").withColumn("confidence", F.round("confidence", 6))


@query("representative", WITH + "SELECT source_id, arg_max(id, score * 1000000 - ord / 1000000.0) AS id, count(*) AS n FROM (SELECT *, round(score, 6) AS s FROM scored) GROUP BY source_id")
def representative(spark, folder):
    return scored(spark, folder).groupBy("source_id").agg(F.max_by("id", F.col("score") * 1000000 - F.col("ord") / 1000000.0).alias("id"), F.count("*").alias("n"))


@query("violations_long", """SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 200 THEN {'rule_id': 'too_short', 'severity': 'error'} END, CASE WHEN length(text) > 5000 THEN {'rule_id': 'too_long', 'severity': 'warning'} END,
  CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN {'rule_id': 'no_ending', 'severity': 'warning'} END, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN {'rule_id': 'no_number', 'severity': 'info'} END,
  CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1) THEN {'rule_id': 'shouting', 'severity': 'error'} END,
  CASE WHEN length(text) - length(replace(text, ',', '')) > 40 THEN {'rule_id': 'many_commas', 'severity': 'info'} END], lambda x: x IS NOT NULL), recursive := true) FROM documents""")
def violations_long(spark, folder):
    return V.violations(read(spark, folder, "documents"), "doc_id", "text")


@query("quality_level")
def quality_level(spark, folder):
    return V.quality(read(spark, folder, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))


ORACLE_SQL["quality_level"] = f"""WITH v AS ({ORACLE_SQL["violations_long"]}), s AS (
  SELECT doc_id, sum(CASE severity WHEN 'error' THEN 0.3 WHEN 'warning' THEN 0.1 ELSE 0.05 END) AS lost, count(*) FILTER (severity = 'error') AS errors FROM v GROUP BY 1),
q AS (SELECT doc_id, round(greatest(0.0, 1 - COALESCE(lost, 0))::DOUBLE, 6) AS score, COALESCE(errors, 0) AS errors FROM documents LEFT JOIN s USING (doc_id))
SELECT *, CASE WHEN score >= 0.9 AND errors = 0 THEN 'excellent' WHEN score >= 0.75 AND errors = 0 THEN 'good' WHEN score >= 0.6 THEN 'acceptable' WHEN score >= 0.4 THEN 'poor' ELSE 'failed' END AS level FROM q"""


@query("upsert_latest", "SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, folder):
    rows = read(spark, folder, "events").withColumn("version", F.struct("ts", "event_id"))
    old, new = rows.where("ts < timestamp'2024-01-15'"), rows.where("ts >= timestamp'2024-01-15'")
    return K.upsert(old, new, ["user_id", "event_type"], "version").select("user_id", "event_type", "value", "ts")


@query("retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def retention(spark, folder):
    return K.retain(read(spark, folder, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 7).select("event_id", "ts")


@query("run_rollup", "SELECT user_id, count(*) AS n, count(*) FILTER (value < 10) AS errors, round(sum(value), 4) AS duration, CASE WHEN count(*) FILTER (value < 10) * 2 > count(*) THEN 'failed' WHEN count(*) FILTER (value < 10) > 0 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY user_id")
def run_rollup(spark, folder):
    return K.run_rollup(read(spark, folder, "events"), "user_id", F.col("value") < 10).withColumn("duration", F.round("duration", 4))


@query("last_n_rate", "SELECT event_type, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY 1")
def last_n_rate(spark, folder):
    return K.last_n_rate(read(spark, folder, "events"), "event_type", 100, F.col("value") >= 10, F.desc("ts"), F.desc("event_id")).withColumn("rate", F.round("rate", 6))


@query("success_rate_view", "SELECT CAST(ts AS DATE) AS day, round(CASE WHEN count(*) FILTER (value >= 10) > 0 THEN count(*) FILTER (value >= 10) / count(*) * 100 ELSE 0 END, 6) AS rate FROM events GROUP BY 1")
def success_rate_view(spark, folder):
    rows = read(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") >= 10).alias("ok"), F.count_if(F.col("value") < 10).alias("bad"))
    return rows.select("day", F.round(K.success_rate(F.col("ok"), F.col("bad")), 6).alias("rate"))


@query("edge_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def edge_summary(spark, folder):
    return read(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("content_logs_left_join", "SELECT o.o_orderkey, o.o_custkey, count(l.l_orderkey) AS n, round(COALESCE(sum(l.l_extendedprice * (1 - l.l_discount)), 0), 4) AS revenue FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 GROUP BY 1, 2")
def content_logs_left_join(spark, folder):
    lines = read(spark, folder, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("revenue", F.lit(0.0)), 4).alias("revenue"))


@query("tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, folder):
    rows = read(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, folder):
    rows = read(spark, folder, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("rollup_revenue", "SELECT n_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name, p_brand)")
def rollup_revenue(spark, folder):
    t = {n: read(spark, folder, n) for n in ("lineitem", "part", "supplier", "nation")}
    rows = t["lineitem"].join(t["part"], F.expr("l_partkey = p_partkey")).join(t["supplier"], F.expr("l_suppkey = s_suppkey")).join(t["nation"], F.expr("s_nationkey = n_nationkey"))
    return rows.rollup("n_name", "p_brand").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


#: Term lists for the test corpus; the lists are parameters of the operators.
DOMAINS = {"one": ["therean", "ingthe"], "two": ["tion"], "three": ["und", "der "], "four": [" les ", " que "]}


def _tags(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower({text}), '{t}')" for t in terms)} THEN '{name}' END" for name, terms in DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


@query("domain_tags", WITH + f"SELECT id, array_to_string({_tags('content')}, ',') AS tags FROM articles")
def domain_tags(spark, folder):
    return articles(spark, folder).select("id", F.array_join(C.tags(F.col("content"), DOMAINS), ",").alias("tags"))


@query("theme_frequency", WITH + f"SELECT term, count(*) AS n FROM (SELECT unnest({_tags('content')}) AS term FROM articles) GROUP BY 1 ORDER BY n DESC, term LIMIT 3")
def theme_frequency(spark, folder):
    return K.frequent(articles(spark, folder), C.tags(F.col("content"), DOMAINS), 3)


@query("title_words", WITH + "SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 3))) AS term FROM articles) GROUP BY 1 ORDER BY n DESC, term LIMIT 3")
def title_words(spark, folder):
    return K.frequent(articles(spark, folder), F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0), lambda w: F.length(w) > 3), 3)


@query("semantic_contrast", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT e.vec_id, r.vec_id < 12 AS wanted, list_inner_product(e.v, r.v) AS d FROM e JOIN e r ON r.vec_id < 31),
k AS (SELECT vec_id, wanted, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, wanted ORDER BY d DESC) AS r FROM s) WHERE r <= 3 GROUP BY 1, 2),
b AS (SELECT vec_id, max(m) FILTER (wanted) AS p, max(m) FILTER (NOT wanted) AS q FROM k GROUP BY 1)
SELECT vec_id, round(least(greatest(p - CASE WHEN q > 0.7 THEN 0.6 ELSE 0.4 END * q, 0), 1), 6)::DOUBLE AS score FROM b""")
def semantic_contrast(spark, folder):
    vectors = read(spark, folder, "embeddings")  # every vector is scored; 12 and 19 of them serve as reference sets
    out = C.contrast(vectors, vectors.where("vec_id < 12"), vectors.where("vec_id between 12 and 30"))
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query("blend_accept", WITH + """, b AS (SELECT id, CASE WHEN priority = 1 THEN score ELSE score * 0.8 + least(wc / 500.0, 1.0) * 0.2 END AS blend FROM scored),
r AS (SELECT *, row_number() OVER (ORDER BY blend DESC, id) AS r FROM b) SELECT id, round(blend, 6)::DOUBLE AS blend FROM r WHERE blend >= 0.99 OR r <= 15 AND blend >= 0.4""")
def blend_accept(spark, folder):
    rows = scored(spark, folder)
    semantic = F.when(F.col("priority") == 1, 0.0).otherwise(F.least(T.word_count(F.col("content")) / F.lit(500.0), F.lit(1.0)))
    return C.blend_accept(rows, F.col("score"), semantic, 0.99, 0.4).select("id", F.round("blend", 6).alias("blend"))


@query("boosted_filter", WITH + """, b AS (SELECT id, least(CASE WHEN priority = 1 THEN score + 0.4 WHEN priority = 2 THEN score + 0.2 WHEN priority = 4 AND score < 0.7 THEN score * 0.8 ELSE score END, 1.0) AS boosted FROM scored)
SELECT id, round(boosted, 6)::DOUBLE AS boosted FROM b WHERE boosted >= 0.6 OR (SELECT count(*) FROM b WHERE boosted >= 0.6) = 0""")
def boosted_filter(spark, folder):
    return C.boosted_filter(scored(spark, folder), 0.6).select("id", F.round("boosted", 6).alias("boosted"))


def _coherence_sql(less: int, t: float) -> str:
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
c AS (SELECT a.vec_id, a.label, sum(list_inner_product(a.e, b.e)) / greatest(any_value(n) - {less}, 1) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN n ON n.label = a.label GROUP BY 1, 2),
k AS (SELECT v.* FROM v JOIN c USING (vec_id) WHERE c >= {0.8 * t}), m AS (SELECT label, count(*) AS n FROM k GROUP BY 1),
d AS (SELECT a.label, any_value(n) AS kept, sum(list_inner_product(a.e, b.e)) / greatest(any_value(n) - {less}, 1) / any_value(n) AS c FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN m ON m.label = a.label GROUP BY 1)
SELECT n.label, n, COALESCE(kept, 0) AS kept, round(COALESCE(c, 0), 6)::DOUBLE AS coherence, COALESCE(kept >= 2 AND c >= {t}, false) AS coherent FROM n LEFT JOIN d USING (label)"""


@query("coherence_filter", _coherence_sql(1, 0.2))
def coherence_filter(spark, folder):
    return C.coherence(read(spark, folder, "embeddings"), "label", 0.2).withColumn("coherence", F.round("coherence", 6))


@query("coherence_parity", _coherence_sql(0, 0.2))
def coherence_parity(spark, folder):
    return C.coherence(read(spark, folder, "embeddings"), "label", 0.2, parity=True).withColumn("coherence", F.round("coherence", 6))


@query("topic_importance", WITH + """SELECT priority, count(*) AS n, count(DISTINCT source_id) AS sources,
  round(least(0.4 * least(count(DISTINCT source_id) / 5, 1.0) + 0.2 * least(count(*) / 10, 0.5) + 0.2 * avg(score) + 0.2 * 0.3 * avg(score) + least(0.1 * count(*) FILTER (score > 0.9), 0.3), 1.0), 6)::DOUBLE AS importance FROM scored GROUP BY 1""")
def topic_importance(spark, folder):
    return C.importance(scored(spark, folder), "priority", "source_id", "score", "score", F.col("score") > 0.9).withColumn("importance", F.round("importance", 6))


@query("topic_first_select", WITH + """, s AS (SELECT id, source_id, round(score, 9) AS score FROM scored), t AS (SELECT source_id FROM s GROUP BY 1 ORDER BY round(avg(score), 9) DESC, source_id LIMIT 2),
p AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS r FROM s JOIN t USING (source_id) WHERE score > 0.75) WHERE r <= 3)
SELECT id, source_id, chosen_by FROM (SELECT *, 'topic' AS chosen_by FROM p UNION ALL BY NAME SELECT *, 'score' AS chosen_by FROM s WHERE id NOT IN (SELECT id FROM p)) ORDER BY chosen_by DESC, score DESC, id LIMIT 12""")
def topic_first_select(spark, folder):
    rows = scored(spark, folder).select("id", "source_id", F.round("score", 9).alias("score"))
    return C.topic_first(rows, "source_id", 2, 3, 0.75, 12).select("id", "source_id", "chosen_by")


@query("cluster_cap", WITH + """, s AS (SELECT id, source_id, round(score, 9) AS score FROM scored), g AS (SELECT source_id, round(avg(score), 9) AS m, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rank FROM s) SELECT id, source_id, rank FROM r JOIN g USING (source_id) WHERE rank <= 3 ORDER BY m DESC, n DESC, source_id, rank LIMIT 10""")
def cluster_cap(spark, folder):
    rows = scored(spark, folder).select("id", "source_id", F.round("score", 9).alias("score"))
    return C.cluster_cap(rows, "source_id", 3, 10).select("id", "source_id", F.col("rank").cast("long").alias("rank"))


@query("diverse_sources", WITH + """, s AS (SELECT id, priority, source_id, round(score, 9) AS score FROM scored),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority, source_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1)
SELECT id, priority, source_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 3""")
def diverse_sources(spark, folder):
    rows = scored(spark, folder).select("id", "priority", "source_id", F.round("score", 9).alias("score"))
    return C.diverse_sources(rows, "priority", "source_id", 3, F.desc("score"), F.asc("id")).withColumn("rank", F.col("rank").cast("long")).drop("score")


@query("citation_score", f"""WITH p AS ({ORACLE_SQL["jaccard_pairs"]}), t AS (SELECT doc_id, {_tags("text")} AS t FROM documents),
x AS (SELECT a, b, similarity, len(list_intersect(u.t, v.t)) AS c, len(u.t) + len(v.t) - len(list_intersect(u.t, v.t)) AS al FROM p JOIN t u ON u.doc_id = a JOIN t v ON v.doc_id = b)
SELECT a, b, round(0.7 * similarity + 0.25 * (c + (al - c) * 0.3) / 4 + 0.05 * CASE WHEN similarity > 0.8 THEN -0.3 WHEN similarity > 0.6 THEN -0.1 ELSE 0 END, 5)::DOUBLE AS score FROM x""")
def citation_score(spark, folder):
    rows = articles(spark, folder).withColumn("tokens", T.words(F.col("content")))
    tagged = rows.select("id", C.tags(F.col("content"), DOMAINS).alias("t"))
    pairs = S.jaccard_pairs(rows, 0.8).withColumn("similarity", F.round("similarity", 6))
    both = pairs.join(tagged.toDF("a", "ta"), "a").join(tagged.toDF("b", "tb"), "b")
    score = 0.7 * F.col("similarity") + 0.25 * C.alignment(F.col("ta"), F.col("tb"), len(DOMAINS), 0.3) + 0.05 * C.overlap_penalty(F.col("similarity"))
    return both.select("a", "b", F.round(score, 5).alias("score"))


@query("leader_groups")
def leader_groups(spark, folder):
    rows = articles(spark, folder).select("id", T.words(F.col("content")).alias("tokens"))
    return C.leader_groups(rows, S.jaccard_pairs(rows, 0.63))


@query("kmeans_groups")
def kmeans_groups(spark, folder):
    return C.kmeans_groups(read(spark, folder, "embeddings"), 10).select("vec_id", "group")


@query("keywords", f"""SELECT doc_id, array_to_string(list_concat(list_filter(w, lambda x: x IN ('tion', 'ther')), list_filter(w, lambda x: x NOT IN ('tion', 'ther')))[:3], ',') AS keywords FROM (
  SELECT doc_id, list_transform(list_filter(list_transform(k, lambda x, i: {{'x': x, 'first': list_position(k, x) = i}}), lambda s: s.first), lambda s: s.x) AS w FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})) AS k FROM documents))""")
def keywords(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.array_join(T.keywords(F.col("text"), ["tion", "ther"]), ",").alias("keywords"))


@query("doc_metrics", """SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[.!?]')) AS sentences, len(regexp_extract_all(text, ',')) AS commas, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '\\b[A-Z][a-z]+')) AS names FROM documents""")
def doc_metrics(spark, folder):
    counts = {"sentences": "[.!?]", "commas": ",", "numbers": "[0-9]+", "names": r"\b[A-Z][a-z]+"}
    return read(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in counts.items()])


@query("terminology", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)tion', 'TION', 'g'), '(?i)ther', 'THER', 'g')) AS hash FROM documents")
def terminology(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.md5(T.fold(F.col("text"), [(r"(?i)tion", "TION"), (r"(?i)ther", "THER")])).alias("hash"))


@query("tidy", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS hash FROM documents")
def tidy(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.md5(T.tidy(F.col("text"))).alias("hash"))


@query("file_ids", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g')[:20] || '_' || md5(url)[:8] AS file_id FROM pages")
def file_ids(spark, folder):
    return read(spark, folder, "pages").select("page_id", T.file_id(F.col("url")).alias("file_id"))


@query("usage_top", "SELECT user_id, count(*) AS uses, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1 ORDER BY uses DESC, user_id LIMIT 10")
def usage_top(spark, folder):
    return K.usage(read(spark, folder, "events"), "user_id", "value", 10).withColumn("mean", F.round("mean", 6))


@query("error_summary", """WITH e AS (SELECT * FROM events WHERE event_type = 'error') SELECT user_id, count(*) AS n, count(*) FILTER (ts > (SELECT max(ts) FROM e) - INTERVAL 24 HOUR) AS recent,
  arg_max(event_id, {'a': ts, 'b': event_id}) AS last FROM e GROUP BY 1""")
def error_summary(spark, folder):
    return K.error_summary(read(spark, folder, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", 24)


@query("map_totals", "SELECT user_id, unnest(['spent', 'seen']) AS key, unnest([sum(CAST(floor(value) AS BIGINT)), sum(1)])::BIGINT AS total FROM events GROUP BY user_id")
def map_totals(spark, folder):
    rows = read(spark, folder, "events").select("user_id", F.create_map(F.lit("spent"), F.floor("value"), F.lit("seen"), F.lit(1).cast("long")).alias("m"))
    return K.map_totals(rows, "user_id", "m")


@query("neighbours", """WITH e AS (SELECT l_partkey AS parent, l_suppkey AS child, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)
SELECT * FROM (SELECT child AS other, 'child' AS direction, score FROM e WHERE parent = 5 UNION ALL SELECT parent, 'parent', score FROM e WHERE child = 5) ORDER BY score DESC, other, direction LIMIT 10""")
def neighbours(spark, folder):
    edges = read(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("parent"), F.col("l_suppkey").alias("child")).agg(F.sum("l_quantity").alias("score"))
    return K.neighbours(edges, F.lit(5), 10)


@query("edges_insert_unique", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def edges_insert_unique(spark, folder):
    first = read(spark, folder, "events").groupBy("user_id", "event_type", F.expr("ts >= timestamp'2024-01-15'").alias("late")).agg(F.min("event_id").alias("event_id"))
    old, new = (first.where(c).drop("late") for c in ("not late", "late"))
    return K.insert_new(old, new, ["user_id", "event_type"])


@query("sliding", """WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, value FROM events) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def sliding(spark, folder):
    return feeds.windowed(read(spark, folder, "events"), "ts", "24 hours", "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


from gleanery import catalog_articles, catalog_forms, catalog_rules, catalog_tables  # noqa: E402, F401  add their queries
