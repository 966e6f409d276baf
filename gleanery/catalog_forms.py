"""Queries on composed texts, joins beyond equality, model-free defaults and feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.catalog import ARTICLES, query
from gleanery.catalog_articles import POINTED, linked, pointed
from gleanery.functions import compose as M
from gleanery.functions import text as T
from gleanery.functions.hash_order import first_distinct
from gleanery.operators import boundaries as B
from gleanery.operators import grouping as G
from gleanery.operators import joins as N
from gleanery.operators import pair_rules as P
from gleanery.sources.tables import articles, read

ONLY = f"WITH {ARTICLES}\n"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(title), '{k.lower()}') THEN '{v}' END" for k, v in M.TITLE_TERMS.items()) + "], lambda x: x IS NOT NULL)"
_COMPANY, _FIGURE = f"regexp_extract(title, '{M.COMPANY_PATTERN}', 1)", "regexp_extract(title, '([0-9]+(?:\\.[0-9]+)?(?:億|万|千|百)?(?:ドル|円|%|件|人))', 1)"
_START = "regexp_replace(regexp_replace(split_part(split_part(translate(title, '【】', ''), '、', 1), '：', 1), '^(新|最新|初|初回)', ''), '(を発表|を公開|をリリース)$', '')"
_TOLD = f"""CASE WHEN len({_FOUND}) = 1 THEN {_FOUND}[1] || '技術の新進展と実用化の動向' WHEN len({_FOUND}) > 1 THEN {_FOUND}[1] || '・' || {_FOUND}[2] || '領域の最新技術進展'
  WHEN {_COMPANY} <> '' AND {_FIGURE} <> '' THEN {_COMPANY} || '、' || {_FIGURE} || 'の新たな成果を発表' WHEN {_COMPANY} <> '' THEN {_COMPANY} || 'の最新技術発表と今後の展望'
  WHEN {_FIGURE} <> '' THEN {_FIGURE} || 'の大型技術進展が発表' ELSE {_START}[:40] || 'の技術的進展と影響' END"""


@query("title_summaries", ONLY + f"""SELECT id, {_TOLD} AS summary, CASE WHEN regexp_extract(title, '{M.NAMED_FIRMS}', 1) <> '' AND regexp_extract(title, '{M.NAMED_MODELS}', 1) <> '' THEN regexp_extract(title, '{M.NAMED_FIRMS}', 1) || 'が' || regexp_extract(title, '{M.NAMED_MODELS}', 1) || 'の新技術を発表。業界への影響と将来性について詳細解説。'
  WHEN regexp_extract(title, '{M.NAMED_FIRMS}', 1) <> '' THEN regexp_extract(title, '{M.NAMED_FIRMS}', 1) || 'がAI技術分野で重要な発表。市場への影響と競争力強化を分析。' WHEN regexp_extract(title, '{M.NAMED_MODELS}', 1) <> '' THEN regexp_extract(title, '{M.NAMED_MODELS}', 1) || 'の最新アップデートが公開。機能向上とユーザー体験の改善を実現。'
  ELSE 'AI技術の重要な進展が発表。業界動向と将来への影響を詳細に解説。' END AS of_entities FROM articles""")
def title_summaries(spark, folder):
    return articles(spark, folder).select("id", M.title_summary(F.col("title")).alias("summary"), M.entity_summary(F.col("title")).alias("of_entities"))


@query("point_summaries", POINTED + f""", f AS (SELECT id, title, regexp_replace(trim(points[1], ' '), '^[-•*]\\s*', '') AS p, points[1] AS raw FROM pointed)
SELECT id, CASE WHEN p IS NULL THEN {_TOLD} WHEN length(p) <= 200 THEN p ELSE p[:190] || '...' END AS long, CASE WHEN raw IS NULL THEN {_TOLD} WHEN length(raw) <= 120 THEN raw ELSE raw[:117] || '...' END AS short FROM f""")
def point_summaries(spark, folder):
    return pointed(spark, folder).select("id", M.point_summary(F.col("title"), F.col("points")).alias("long"), M.short_summary(F.col("title"), F.col("points")).alias("short"))


@query("title_checks", ONLY + """SELECT id, regexp_matches(title, '(?i)^AI関連ニュース$|^.*の$') AS generic, CASE WHEN length(trim(title, ' ')) < 10 THEN 'short' WHEN length(trim(title, ' ')) > 200 THEN 'long' ELSE 'ending' END AS verdict FROM articles""")
def title_checks(spark, folder):
    return articles(spark, folder).select("id", M.generic_title(F.col("title")).alias("generic"), M.lead_paragraph_verdict(F.col("title")).alias("verdict"))


@query("said_points", ONLY + """, l AS (SELECT id, content, list_filter(list_transform(string_split(content, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '' AND NOT regexp_matches(lower(s), '要約|summary|以下|上記')) AS lines FROM articles),
m AS (SELECT id, content, list_filter(list_transform(list_filter(lines, lambda s: regexp_matches(s, '^(?:[-*•]|[0-9]+\\.)')), lambda s: regexp_replace(regexp_replace(s, '^[-*•]\\s*', ''), '^[0-9]+\\.\\s*', '')), lambda s: length(s) > 15) AS found,
  list_transform(list_filter(list_transform(regexp_split_to_array(content, '[。.!?]'), lambda s: trim(s, ' ')), lambda s: length(s) > 20), lambda s: s || '。') AS said FROM l)
SELECT id, array_to_string(CASE WHEN len(found) > 0 THEN found WHEN len(said) > 0 THEN said ELSE [CASE WHEN length(content) > 100 THEN '記事の要約：' || content[:100] || '...' ELSE content END] END[1:5], '|') AS points FROM m""")
def said_points(spark, folder):
    return articles(spark, folder).select("id", F.array_join(M.said_points(F.col("content")), "|").alias("points"))


@query("rendered_documents", ONLY + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord, title) AS r FROM articles), k AS (SELECT * FROM r WHERE r <= 7)
SELECT source_id, count(*) AS n, (SELECT count(*) FROM k j WHERE j.source_id = k.source_id) AS headings FROM k GROUP BY 1""")
def rendered_documents(spark, folder):
    rows = articles(spark, folder).withColumn("title", F.regexp_replace("title", "[#\n]", "")).withColumn("markdown", M.article_markdown(F.col("title"), F.array(F.substring("content", 1, 0)), F.array().cast("array<string>")))
    out = M.documents(rows, "source_id", "ord", "title", "markdown", 7)
    return out.select("source_id", "n", F.regexp_count("text", F.lit(r"(?m)^### ?")).cast("long").alias("headings"))


@query("first_of_each", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_of_each(spark, folder):
    return N.first_of_each(read(spark, folder, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("as_of_join", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), v AS (SELECT user_id, ts AS seen, event_id AS last_click FROM events WHERE event_type = 'click')
SELECT e.event_id, e.user_id, v.last_click FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.seen""")
def as_of_join(spark, folder):
    rows = read(spark, folder, "events")
    right = rows.where("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("last_click"))
    return N.as_of(rows.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "seen", ["last_click"]).drop("ts")


@query("range_join", """WITH s AS (SELECT event_id AS span, event_id + 0.0::DOUBLE AS a, event_id + value AS b FROM events WHERE event_type = 'purchase')
SELECT span, count(*) AS n FROM s JOIN events e ON e.event_id >= s.a AND e.event_id < s.b GROUP BY 1""")
def range_join(spark, folder):
    rows = read(spark, folder, "events")
    spans = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("span"), F.col("event_id").cast("double").alias("a"), (F.col("event_id") + F.col("value")).alias("b"))
    return N.within(rows.select("event_id"), spans, "event_id", "a", "b", 16.0).groupBy("span").agg(F.count("*").alias("n"))


@query("extracted_summaries", ONLY + """, s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '[。.!?]'), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 30 AND 300 AND NOT regexp_matches(lower(s), '申し訳|すみません|sorry|i apologize|i cannot'))[1:4] AS said FROM articles)
SELECT id, array_to_string(said, '|') AS points FROM s WHERE len(said) >= 3""")
def extracted_summaries(spark, folder):
    made = articles(spark, folder).select("id", B.extracted_summary(F.col("title"), F.col("content")).alias("s"))
    return made.where("s.confidence = 0.8").select("id", F.array_join("s.points", "|").alias("points"))


@query("merged_points", POINTED + """, p AS (SELECT id // 5 AS g, id, unnest(points) AS p, generate_subscripts(points, 1) AS pos FROM pointed), o AS (SELECT g, p, min(id * 1000000 + pos) AS o FROM p WHERE length(p) > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS r FROM o)
SELECT g, array_to_string(list(p ORDER BY r), '|') AS points FROM r WHERE r <= 4 GROUP BY 1""")
def merged_points(spark, folder):
    rows = pointed(spark, folder).withColumn("g", F.floor(F.col("id") / 5))
    return B.merged_points(rows, "g", "points", "id").select("g", F.array_join("points", "|").alias("points"))


@query("embedded_articles")
def embedded_articles(spark, folder):
    rows = pointed(spark, folder)
    return rows.select("id", B.embedded(B.embedding_text(F.col("title"), F.col("points"))).alias("embedding"))


@query("titles_named_in", ONLY + "SELECT id FROM articles WHERE trim(title, ' ') IN (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '^#+\\s*', ''), ' ') FROM documents)")
def titles_named_in(spark, folder):
    return P.named_in(articles(spark, folder), read(spark, folder, "documents")).select("id")


@query("source_names", ONLY + """SELECT id, 'Src' || source_id[4:] || CASE priority WHEN 1 THEN ' Official' ELSE '' END AS name, 0.5::DOUBLE AS quality FROM articles""")
def source_names(spark, folder):
    rows = linked(spark, folder)
    return rows.select("id", P.source_name(F.col("source_id"), F.col("url")).alias("name"), P.source_quality(F.col("source_id")).alias("quality"))


@query("publish_status", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'dry_run' WHEN event_type = 'click' THEN 'cli' WHEN event_type = 'view' THEN 'http' ELSE 'skipped' END AS status, count(*) AS n FROM events GROUP BY ALL")
def publish_status(spark, folder):
    kind = F.col("event_type")
    return read(spark, folder, "events").groupBy("event_type", B.publish_status(kind == "error", kind == "click", kind == "view").alias("status")).agg(F.count("*").alias("n"))


@query("source_groups", ONLY + "SELECT *, row_number() OVER (ORDER BY first, source_id) AS place FROM (SELECT source_id, count(*) AS n, min(ord) AS first FROM articles GROUP BY 1 ORDER BY first, source_id LIMIT 7)")
def source_groups(spark, folder):
    return G.source_groups(articles(spark, folder), "source_id", "ord", 7)


@query("first_by_url", "SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def first_by_url(spark, folder):
    return G.first_by_url(read(spark, folder, "pages").select("page_id", "url"), "url", "page_id", normal=False)


@query("unflagged", ONLY + "SELECT min(id) AS id, source_id FROM articles WHERE length(content) % 3 <> 0 GROUP BY 2")
def unflagged(spark, folder):
    rows = articles(spark, folder).select("id", "source_id", (F.length("content") % 3 == 0).alias("flag"))
    return G.unflagged(rows, "source_id", F.col("flag"), "id").select("id", "source_id")


_TOPICS = {"first": ("the", "of", "and", "therean"), "second": ("und", "der", "die", "das")}
_MET = {name: " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in words) for name, words in _TOPICS.items()}


@query("topic_keyword_matches", ONLY + ", t AS (" + " UNION ALL ".join(f"SELECT id, priority, '{name}' AS topic FROM articles WHERE {met} >= 3" for name, met in _MET.items()) + """)
SELECT t.id, t.topic, p.past_id FROM t JOIN (SELECT topic, min(id) AS past_id FROM t WHERE priority = 2 GROUP BY 1) p USING (topic) WHERE t.priority <> 2""")
def topic_keyword_matches(spark, folder):
    rows = articles(spark, folder)
    return G.topic_keyword_matches(rows.where("priority != 2"), rows.where("priority = 2"), _TOPICS)


@query("multi_source_topics", ONLY + """, tok AS (SELECT id, source_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (STOPS)))) AS t FROM articles),
p AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= 0.6 * greatest(len(a.t), len(b.t))
  WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.6),
s AS (SELECT * FROM p WHERE a NOT IN (SELECT b FROM p)), m AS (SELECT a AS seed, b AS member FROM s UNION SELECT a, a FROM s)
SELECT seed, count(*) AS n, count(DISTINCT source_id) AS sources FROM m JOIN tok ON m.member = tok.id GROUP BY 1 HAVING count(DISTINCT source_id) >= 2 OR count(*) >= 3""".replace("STOPS", ", ".join(f"'{w}'" for w in T.STOP_WORDS)))
def multi_source_topics(spark, folder):
    from gleanery.operators import similarity as S

    rows = articles(spark, folder)
    pairs = S.jaccard_pairs(rows.select("id", T.words(F.col("content")).alias("tokens")), 0.6)
    return G.multi_source_topics(G.seed_groups(pairs, rows), rows)


@query("json_rows", """SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def json_rows(spark, folder):
    return read(spark, folder, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("json"))


@query("merged_maps", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS level, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def merged_maps(spark, folder):
    rows = read(spark, folder, "events")
    defaults = F.create_map(F.lit("level"), F.lit("low"), F.lit("k"), F.lit("0"))
    over = F.map_concat(F.from_json("props", "map<string,string>"), F.when(F.col("event_type") == "error", F.create_map(F.lit("level"), F.lit("high"))).otherwise(F.create_map().cast("map<string,string>")))
    made = rows.select("event_id", G.merged_maps(defaults, over).alias("m"))
    return made.select("event_id", F.col("m")["level"].alias("level"), F.col("m")["k"].alias("k"))


@query("related_terms", ONLY + """, k AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 5))[1:8] AS w, list_distinct(list_filter(['therean', 'enonth', 'ingthe'], lambda t: contains(lower(content), t))) AS n FROM articles)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.n, b.n)) > 0 OR len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w), 1) >= 0.5 AS related FROM k a JOIN k b ON a.id // 10 = b.id // 10 AND a.id < b.id""")
def related_terms(spark, folder):
    terms = ["therean", "enonth", "ingthe"]
    low = F.lower("content")
    named = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms)))
    words = first_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0), lambda w: F.length(w) > 5), 8)
    rows = articles(spark, folder).select("id", F.floor(F.col("id") / 10).alias("g"), named.alias("n"), words.alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, F.expr("a.g = b.g and a.id < b.id"))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.coalesce(G.related(F.col("a.n"), F.col("b.n"), F.col("a.w"), F.col("b.w")), F.lit(False)).alias("related"))
