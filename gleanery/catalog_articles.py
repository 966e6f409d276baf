"""Queries on articles' points, relevance by the fixed lists, pairs, duplicates, citations and selection, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gleanery.catalog import ARTICLES, WITH, query, scored
from gleanery.functions import fixed as X
from gleanery.functions import japanese as J
from gleanery.functions import text as T
from gleanery.operators import content_rules as V
from gleanery.operators import pair_rules as P
from gleanery.operators import relevance_rules as R
from gleanery.operators import topics as C
from gleanery.sources.tables import articles, read

ONLY = f"WITH {ARTICLES}\n"
_BLANK = "[ \\t\\r\\n\\f\\v]+"
POINTED = (
    ONLY
    + """, lined AS (SELECT id, title, list_filter(list_transform(string_split(content, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS lines FROM articles),
pointed AS (SELECT id, title, list_filter(list_transform(lines, lambda s: CASE WHEN regexp_matches(s, '^(?:[-*•]\\s*|\\d+\\.\\s*|・)(.+)$') THEN regexp_extract(s, '^(?:[-*•]\\s*|\\d+\\.\\s*|・)(.+)$', 1)
  WHEN length(s) > 20 THEN s END), lambda s: s IS NOT NULL) AS points FROM lined),
each AS (SELECT id, unnest(points) AS p, generate_subscripts(points, 1) - 1 AS bullet FROM pointed),
joined AS (SELECT id, len(points) AS n, array_to_string(points, chr(10)) AS t, points FROM pointed),
words AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(p, '[a-zA-Zァ-ヶー一-龯]{2,}')) AS w FROM each) GROUP BY ALL)
"""
)


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _count(text: str, words, weight="1") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {weight} ELSE 0 END" for w in words) + ")"


def pointed(spark, folder):
    return articles(spark, folder).withColumn("points", V.bullets(F.col("content")))


_ENDS = " OR ".join(f"ends_with(trim(p, ' '), '{e}')" for e in X.ENDINGS)
RULES = f"""found AS (
  SELECT id, 'proper_sentence_ending' AS rule_id, 'warning' AS severity, bullet, CAST(NULL AS INTEGER) AS position, right(trim(p, ' '), 10) AS detail FROM each WHERE NOT ({_ENDS})
  UNION ALL SELECT id, 'bullet_point_count', 'error', NULL, NULL, CAST(n AS VARCHAR) FROM joined WHERE n < 3 OR n > 4
  UNION ALL SELECT id, 'bullet_point_length', 'warning', bullet, NULL, CAST(length(trim(p, ' ')) AS VARCHAR) FROM each WHERE length(trim(p, ' ')) NOT BETWEEN 20 AND 150
  UNION ALL SELECT id, 'specific_information', 'warning', bullet, NULL, NULL FROM each WHERE NOT regexp_matches(p, '[0-9]|[A-Z][a-zA-Z]+|[ァ-ヶー]+')
  UNION ALL SELECT id, 'repetitive_expressions', 'warning', NULL, NULL, string_agg(w, ',' ORDER BY w) FROM words WHERE c > 2 GROUP BY id
  UNION ALL SELECT id, 'number_format_consistency', 'info', NULL, NULL, NULL FROM joined WHERE regexp_matches(t, '[0-9]{{1,3}}(?:,[0-9]{{3}})+') AND regexp_matches(t, '\\b[0-9]{{4,}}\\b'))"""


@query("content_violations", POINTED + ", " + RULES + " SELECT id, rule_id, severity, CAST(bullet AS INTEGER) AS bullet, position, detail FROM found")
def content_violations(spark, folder):
    return V.violations(pointed(spark, folder), "id", V.content_violations(F.col("points")))


@query("content_quality", POINTED + ", " + RULES + """, s AS (SELECT a.id, greatest(0.0, 1 - coalesce(sum(CASE f.severity WHEN 'error' THEN 0.3::DOUBLE WHEN 'warning' THEN 0.1::DOUBLE WHEN 'info' THEN 0.05::DOUBLE END), 0)) AS score,
  count(*) FILTER (f.severity = 'error') AS errors FROM articles a LEFT JOIN found f ON a.id = f.id GROUP BY 1)
SELECT id, round(score, 6) AS score, CASE WHEN errors > 0 THEN 'failed' WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.8 THEN 'good' WHEN score >= 0.6 THEN 'acceptable' ELSE 'poor' END AS level FROM s""")
def content_quality(spark, folder):
    return V.judged(pointed(spark, folder), "id").select("id", F.round("score", 6).alias("score"), "level")


@query("production_rules", POINTED + f"""SELECT p.id, CAST((SELECT count(*) FROM each e WHERE e.id = p.id AND length(e.p) < 50) AS INTEGER) AS brief,
  CAST((SELECT count(*) FROM each e WHERE e.id = p.id AND NOT regexp_matches(e.p, '([0-9]+|{"|".join(w for w in X.SPECIFIC[5:-1].split("|"))})')) AS INTEGER) AS vague,
  title <> '' AND length(title) < 20 AS short_title, title <> '' AND NOT regexp_matches(title, '{X.TITLE_TERMS}') AS vague_title, len(points) < 3 AS few FROM pointed p""")
def production_rules(spark, folder):
    found = V.production_violations(F.col("points"), F.col("title"))
    rows = pointed(spark, folder).select("id", found.alias("f"))
    n = lambda rule: F.size(F.filter("f", lambda v: v["rule_id"] == rule))
    return rows.select("id", n("PROD_INSUFFICIENT_DETAIL").alias("brief"), n("PROD_VAGUE_CONTENT").alias("vague"), (n("PROD_TITLE_TOO_SHORT") > 0).alias("short_title"), (n("PROD_TITLE_VAGUE") > 0).alias("vague_title"), (n("PROD_INSUFFICIENT_POINTS") > 0).alias("few"))


@query("default_rules", POINTED + """SELECT id, rule_id, count(*) AS n FROM (
  SELECT id, 'summary_length' AS rule_id FROM each WHERE length(p) NOT BETWEEN 50 AND 200
  UNION ALL SELECT id, 'proper_ending' FROM each WHERE NOT regexp_matches(p, '(です|ます|した|きます|。)$')
  UNION ALL SELECT id, 'minimum_bullet_points' FROM joined WHERE n < 3 UNION ALL SELECT id, 'maximum_bullet_points' FROM joined WHERE n > 4) GROUP BY ALL""")
def default_rules(spark, folder):
    return V.violations(pointed(spark, folder), "id", V.default_violations(F.col("points"))).groupBy("id", "rule_id").agg(F.count("*").alias("n"))


@query("point_metrics", POINTED + """SELECT id, CAST(length(t) AS INTEGER) AS characters, CAST(n AS INTEGER) AS bullets, CASE WHEN n > 0 THEN round(list_sum(list_transform(points, lambda p: length(p))) / n, 6) ELSE 0 END AS mean_bullet,
  CAST(len(regexp_extract_all(t, '[0-9]+')) AS INTEGER) AS numbers, CAST(len(regexp_extract_all(t, '[A-Z][a-zA-Z]+|[ァ-ヶー]{2,}')) AS INTEGER) AS proper_nouns FROM joined""")
def point_metrics(spark, folder):
    m = V.metrics(F.col("points"))
    return pointed(spark, folder).select("id", m["characters"].alias("characters"), m["bullets"].alias("bullets"), F.round(m["mean_bullet"], 6).alias("mean_bullet"), m["numbers"].alias("numbers"), m["proper_nouns"].alias("proper_nouns"))


@query("repaired_points", POINTED + """, cut AS (SELECT id, list_transform(points, lambda p: CASE WHEN length(p) < 30 THEN p || ' more to say' WHEN length(p) > 300 THEN p[:297] || '...' ELSE p END) AS c FROM pointed)
SELECT id, array_to_string(list_concat(c, ['more to say', 'more to say', 'more to say'][1:greatest(3 - len(c), 0)])[1:4], '|') AS points FROM cut""")
def repaired_points(spark, folder):
    return pointed(spark, folder).select("id", F.array_join(V.repaired_points(F.col("points"), F.lit("more to say")), "|").alias("points"))


@query("sound_points", POINTED + """SELECT id, len(points) BETWEEN 1 AND 6 AND len(list_filter(points, lambda p: length(p) < 30)) = 0 AS valid, len(list_filter(points, lambda p: length(p) NOT BETWEEN 15 AND 300)) = 0 AS sound FROM pointed""")
def sound_points(spark, folder):
    return pointed(spark, folder).select("id", V.summary_is_valid(F.col("points")).alias("valid"), V.points_are_sound(F.col("points")).alias("sound"))


@query("fallback_summaries", ONLY + "SELECT id, title || '|' || content[:100] || CASE WHEN length(content) > 100 THEN '...' ELSE '' END || '|no model' AS points, CASE WHEN length(content) > 10000 THEN content[:10000] || '...' ELSE content END AS clipped FROM articles")
def fallback_summaries(spark, folder):
    return articles(spark, folder).select("id", F.array_join(V.fallback_summary(F.col("title"), F.col("content"), "no model"), "|").alias("points"), V.clipped(F.col("content")).alias("clipped"))


# The words of the test corpus beside the fixed ones, so that all tiers are met.
EXTRA = {"high": ("therean", "enonth"), "medium": ("tion", "ther"), "low": ("the", "of"), "negative": ("das", "les")}
LISTS = {t: (*w, *EXTRA[t]) for t, w in R.TIERS.items()}


def _tier(tier: str) -> str:
    words = sorted(dict.fromkeys(LISTS[tier]), key=lambda w: (-len(w), w))
    return "len(list_distinct(regexp_extract_all(t, '(?i)\\b(?:" + "|".join(re.escape(w) for w in words) + ")\\b')))"


_URL = "'https://www.' || CASE priority WHEN 1 THEN 'openai.com' WHEN 2 THEN 'wired.com' WHEN 3 THEN 'cs.mit.edu' ELSE 'blog.example.com' END || '/a/' || id"
LINKED = f"linked AS (SELECT *, {_URL} AS url FROM articles)"


def linked(spark, folder):
    host = F.when(F.col("priority") == 1, "openai.com").when(F.col("priority") == 2, "wired.com").when(F.col("priority") == 3, "cs.mit.edu").otherwise("blog.example.com")
    return articles(spark, folder).withColumn("url", F.concat(F.lit("https://www."), host, F.lit("/a/"), F.col("id").cast("string")))


@query("relevance_scores", ONLY + f""", {LINKED}, low AS (SELECT id, priority, lower(title || ' ' || content) AS full_text, regexp_replace(lower(title || ' ' || content), '[^\\x00-\\x7F]', 'z', 'g') AS t FROM linked),
n AS (SELECT *, {_tier("high")} AS h, {_tier("medium")} AS m, {_tier("low")} AS l, {_tier("negative")} AS g, len(list_filter(regexp_split_to_array(full_text, '{_BLANK}'), lambda w: w <> '')) AS wc FROM low),
s AS (SELECT id, h AS n_high, m AS n_medium, l AS n_low, g AS n_negative, CASE WHEN {_contains("full_text", [w.lower() for w in X.BLACKLIST])} THEN 0.0::DOUBLE WHEN wc = 0 THEN 0.0::DOUBLE
  ELSE least(greatest((3.0::DOUBLE * h + 1.5 * m + 0.5 * l - g + CASE priority WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.15::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0 END) / (wc / 100.0), 0), 1) END AS score FROM n)
SELECT id, n_high, n_medium, n_low, n_negative, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'High AI relevance: ' || n_high || ' high-priority keywords' WHEN score >= 0.6 THEN 'Good AI relevance: ' || n_high || ' high + ' || n_medium || ' medium keywords'
  WHEN score >= 0.4 THEN 'Moderate AI relevance: Mix of AI-related terms' WHEN score >= 0.2 THEN 'Low AI relevance: Few AI keywords, mostly general tech' WHEN n_negative > 0 THEN 'Non-AI content: ' || n_negative || ' negative keywords detected'
  ELSE 'Non-AI content: No significant AI keywords found' END AS reason FROM s""")
def relevance_scores(spark, folder):
    rows = linked(spark, folder).withColumn("source_type", F.lit("rss"))
    return R.relevance(rows, lexicon=LISTS).select("id", "n_high", "n_medium", "n_low", "n_negative", F.round("score", 6).alias("score"), "reason")


_WEIGHTS = X.WEIGHTED | {"therean": 1.0, "ther": 0.4}
_SUM = " + ".join(f"CASE WHEN contains(t, '{w}') THEN {x}::DOUBLE ELSE 0 END" for w, x in _WEIGHTS.items())


@query("weighted_relevance", ONLY + f""", low AS (SELECT id, lower(title || ' ' || content) AS t FROM articles)
SELECT id, round(CASE WHEN {_contains("t", (*X.EXCLUDING, "das die"))} THEN 0.05::DOUBLE WHEN {" OR ".join(f"regexp_matches(t, '{p}')" for p in X.EXCLUDING_PATTERNS)} THEN 0.03::DOUBLE ELSE least(({_SUM}) / 3, 1) END, 6) AS score FROM low""")
def weighted_relevance(spark, folder):
    return articles(spark, folder).select("id", F.round(R.weighted_relevance(F.col("title"), F.col("content"), _WEIGHTS, (*X.EXCLUDING, "das die")), 6).alias("score"))


_BROAD, _STRICTEST = ("src1", "src2", "src3", *X.BROAD_SOURCES), "src1"
_STRICT = (*X.STRICT_WORDS, "ther", "ing", "un")


@query("kept_subjects", POINTED.replace("FROM articles),", "FROM articles),", 1) + f""", low AS (SELECT a.id, a.source_id, lower(a.title || ' ' || a.content[:500] || ' ' || array_to_string(p.points, ' ')) AS t FROM articles a JOIN pointed p ON a.id = p.id)
SELECT id FROM low WHERE source_id NOT IN ({_listed(_BROAD)}) OR {_count("t", _STRICT)} >= CASE WHEN source_id = '{_STRICTEST}' THEN 3 ELSE 2 END""")
def kept_subjects(spark, folder):
    rows = pointed(spark, folder)
    return rows.where(R.keeps_subject(F.col("title"), F.col("content"), F.col("points"), F.col("source_id"), _BROAD, _STRICTEST, _STRICT)).select("id")


@query("relaxed_rows", WITH + """, c AS (SELECT count(*) FILTER (score >= 0.5) AS a, count(*) FILTER (score >= 0.5::DOUBLE * 0.9) AS b, count(*) FILTER (score >= 0.5::DOUBLE * 0.9 * 0.9) AS c, count(*) FILTER (score >= 0.5::DOUBLE * 0.9 * 0.9 * 0.9) AS d,
  count(*) FILTER (score >= 0.5::DOUBLE * 0.9 * 0.9 * 0.9 * 0.7) AS e FROM scored),
t AS (SELECT CASE WHEN a >= 400 THEN 0.5::DOUBLE WHEN b >= 400 THEN 0.5::DOUBLE * 0.9 WHEN c >= 400 THEN 0.5::DOUBLE * 0.9 * 0.9 WHEN d >= 400 THEN 0.5::DOUBLE * 0.9 * 0.9 * 0.9 WHEN e > d THEN 0.5::DOUBLE * 0.9 * 0.9 * 0.9 * 0.7 ELSE 0.5::DOUBLE * 0.9 * 0.9 * 0.9 END AS t FROM c)
SELECT id, round(t, 6) AS threshold FROM scored, t WHERE score >= t""")
def relaxed_rows(spark, folder):
    return R.relaxed(scored(spark, folder).select("id", "score"), 0.5, 400).select("id", F.round("threshold", 6).alias("threshold"))


@query("compliance", ONLY + "SELECT priority, count(*) AS n, count(DISTINCT source_id) AS sources, count(*) >= 7 AS enough, count(*) <= 60 AS not_too_many, count(*) BETWEEN 7 AND 60 AS complies FROM articles GROUP BY 1")
def compliance(spark, folder):
    return R.compliance(articles(spark, folder), "priority", 7, 60)


@query("readiness", WITH + """, q AS (SELECT priority, score * 0.4 + 0.8 * 0.3 + priority / 4.0 * 0.3 AS q, n_negative FROM scored)
SELECT priority, count(*) AS n, count(*) FILTER (q >= 0.7 AND n_negative = 0) AS ready, bool_and(q >= 0.7 AND n_negative = 0) AS passes FROM q GROUP BY 1""")
def readiness(spark, folder):
    q = R.overall_quality(F.col("score"), F.lit(0.8), F.col("priority") / 4.0)
    return R.gate(scored(spark, folder), "priority", R.ready(F.lit(True), q, F.col("n_negative")))


@query("script_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{L}\\p{N}ー]', '', 'g')), 1), 6) AS latin, true AS needs FROM documents")
def script_ratio(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.round(R.script_ratio(F.col("text"))["latin"], 6).alias("latin"), R.needs_translation(F.col("text")).alias("needs"))


@query("japanese_forms", ONLY + "SELECT id, length(trim(regexp_replace(regexp_replace(title, '\\s+([。、!?])', '\\1', 'g'), '([。、!?])\\s+', '\\1 ', 'g'), ' ')) AS n, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS plain FROM articles")
def japanese_forms(spark, folder):
    rows = articles(spark, folder)
    return rows.select("id", F.length(J.punctuation(F.col("title"))).cast("long").alias("n"), J.plain_style(F.col("title")).alias("plain"))


_TOK = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(title, ' ') || ' ' || trim(content, ' ')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (" + _listed(T.STOP_WORDS) + "))))"
_SUBJECTS = " + ".join(f"CASE WHEN {_contains('x', g)} AND {_contains('y', g)} THEN 1.0::DOUBLE WHEN {_contains('x', g)} OR {_contains('y', g)} THEN 0.3::DOUBLE ELSE 0 END" for g in X.SUBJECTS)
_ENTITIES = " + ".join(f"CASE WHEN contains(x, '{e}') AND contains(y, '{e}') THEN 1.0::DOUBLE WHEN contains(x, '{e}') OR contains(y, '{e}') THEN 0.2::DOUBLE ELSE 0 END" for e in X.ENTITIES)
_STRICTLY = " OR ".join(f"({_contains('lower(ta)', g)} AND {_contains('lower(tb)', h)}) OR ({_contains('lower(ta)', h)} AND {_contains('lower(tb)', g)})" for g, h in X.STRICT_CLASHES)
_BONUS = " + ".join(f"CASE WHEN contains(x[:500], '{k}') AND contains(y[:500], '{k}') THEN 0.1::DOUBLE ELSE 0 END" for k in X.IMPORTANT)


@query("pair_relevance", ONLY + f""", tok AS (SELECT id, title, lower(title || ' ' || content) AS full_text, {_TOK} AS t FROM articles), one AS (SELECT * FROM tok QUALIFY id = min(id) OVER (PARTITION BY t)),
p AS (SELECT a.id AS a, b.id AS b, a.full_text AS x, b.full_text AS y, a.title AS ta, b.title AS tb FROM one a JOIN one b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= 0.6 * greatest(len(a.t), len(b.t))
  WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.6),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(x[:500], '{_BLANK}'), lambda w: w <> '')) AS wx, list_distinct(list_filter(regexp_split_to_array(y[:500], '{_BLANK}'), lambda w: w <> '')) AS wy,
  list_distinct(list_filter(regexp_split_to_array(lower(ta), '{_BLANK}'), lambda w: w <> '')) AS va, list_distinct(list_filter(regexp_split_to_array(lower(tb), '{_BLANK}'), lambda w: w <> '')) AS vb FROM p),
s AS (SELECT *, least(len(list_intersect(wx, wy)) / len(list_distinct(list_concat(wx, wy))) + {_BONUS}, 1.0) AS sim, ({_SUBJECTS}) / 7 AS subjects, ({_ENTITIES}) / 20 AS entities,
  CASE WHEN len(va) + len(vb) = 0 THEN 1 ELSE len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))) END AS shared FROM w)
SELECT a, b, round(sim, 6) AS lexical, round(subjects, 6) AS subjects, round(entities, 6) AS entities,
  round(CASE WHEN {_STRICTLY} THEN 0 ELSE least(greatest(0.4 * sim + 0.3 * subjects + 0.25 * entities + 0.05 * CASE WHEN shared > 0.8 THEN -0.3 WHEN shared > 0.6 THEN -0.1 ELSE 0 END, 0), 1) END, 6) AS relevance,
  len(list_intersect(va, vb)) >= 2 AND len(list_filter(list_intersect(va, vb), lambda w: length(w) > 3)) > 0 AS related FROM s""")
def pair_relevance(spark, folder):
    rows = articles(spark, folder)
    pairs = P.candidate_pairs(rows, 0.6).where("similarity < 1")
    side = lambda s: rows.select(F.col("id").alias(s), F.col("title").alias(f"t{s}"), F.col("content").alias(f"c{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    x, y = F.lower(F.concat_ws(" ", "ta", "ca")), F.lower(F.concat_ws(" ", "tb", "cb"))
    return met.select(
        "a", "b", F.round(P.lexical_similarity(x, y), 6).alias("lexical"), F.round(P.subject_alignment(x, y), 6).alias("subjects"), F.round(P.entity_alignment(x, y), 6).alias("entities"),
        F.round(P.strict_relevance(F.col("ta"), F.col("ca"), F.col("tb"), F.col("cb")), 6).alias("relevance"), P.titles_related(F.col("ta"), F.col("tb")).alias("related"),
    )


@query("duplicate_rows")
def duplicate_rows(spark, folder):
    return P.duplicates(linked(spark, folder))


@query("article_terms", ONLY + f"""SELECT id, array_to_string(list_filter([{_listed(X.NAMED_COMPANIES)}], lambda w: contains(lower(title || ' ' || content), lower(w))), ',') AS companies,
  array_to_string(list_filter([{_listed(X.TECH_TERMS)}], lambda w: contains(lower(title || ' ' || content), lower(w))), ',') AS tech FROM articles""")
def article_terms(spark, folder):
    text = F.concat_ws(" ", "title", "content")
    return articles(spark, folder).select("id", F.array_join(P.terms(text, X.NAMED_COMPANIES), ",").alias("companies"), F.array_join(P.terms(text, X.TECH_TERMS), ",").alias("tech"))


@query("consolidated", POINTED + """, s AS (SELECT s.id, s.source_id, s.title, p.points, s.score, s.ord FROM (SELECT a.*, length(a.content) % 100 / 100.0 AS score FROM articles a) s JOIN pointed p ON s.id = p.id),
g AS (SELECT *, priority_group, row_number() OVER (PARTITION BY priority_group ORDER BY score DESC, id) AS r FROM (SELECT s.*, s.id // 4 AS priority_group FROM s)),
o AS (SELECT priority_group, array_to_string(list(array_to_string(list_transform(string_split(replace(source_id, '_', ' '), ' '), lambda w: upper(w[:1]) || lower(w[2:])), ' ') ORDER BY id), ', ') AS names, count(*) AS n FROM g WHERE r > 1 GROUP BY 1)
SELECT g.id, CASE WHEN o.n IS NOT NULL AND len(points) > 0 THEN '🆙 ' || title ELSE title END AS title, CASE WHEN o.n IS NOT NULL AND len(points) > 0 THEN points[-1] || ' [関連報道: ' || names || ']' ELSE points[-1] END AS last, coalesce(o.n, 0) AS dropped FROM g LEFT JOIN o USING (priority_group) WHERE r = 1""")
def consolidated(spark, folder):
    rows = pointed(spark, folder).withColumn("score", F.length("content") % 100 / 100.0)
    groups = rows.select("id", F.floor(F.col("id") / 4).alias("leader"))
    out = P.consolidated(rows, groups, F.col("score"))
    return out.select("id", "title", F.get("points", F.size("points") - 1).alias("last"), "dropped")


@query("topic_citations", ONLY + f""", {LINKED}, f AS (SELECT *, id // 8 AS g, row_number() OVER (PARTITION BY id // 8 ORDER BY length(content) DESC, id) AS lead FROM linked),
c AS (SELECT f.*, f.lead = 1 AS is_lead FROM f JOIN (SELECT g, source_id AS ls, title AS lt FROM f WHERE lead = 1) l USING (g) WHERE lead = 1 OR (source_id <> ls)),
one AS (SELECT *, row_number() OVER (PARTITION BY g, source_id ORDER BY is_lead DESC, id) AS a FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY is_lead DESC, id) AS rank FROM one WHERE a = 1)
SELECT g, rank, url FROM r WHERE rank <= 3""")
def topic_citations(spark, folder):
    rows = linked(spark, folder).withColumn("g", F.floor(F.col("id") / 8)).withColumn("title", F.substring("title", 1, 0))  # invented titles: none clashes
    got = P.citations(rows, "g", F.length("content"))
    return got.select("g", F.posexplode("citations").alias("rank", "c")).select("g", (F.col("rank") + 1).cast("long").alias("rank"), "c.url")


@query("impact_top", POINTED + f""", s AS (SELECT id, {_count("title || ' ' || array_to_string(points, ' ')", (*X.MAJOR_ENTITIES, "Th"), "2")} + {_count("title || ' ' || array_to_string(points, ' ')", X.IMPACT_TERMS)} + CASE WHEN regexp_matches(title || ' ' || array_to_string(points, ' '), '[0-9]+%|[0-9]+倍|[0-9]+[年月日]|\\$[0-9]+|¥[0-9]+') THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.5 ELSE 0 END + 0.8 AS s0,
  contains(title || ' ' || array_to_string(points, ' '), 'Th') AS th FROM pointed), t AS (SELECT id, s0 - CASE WHEN th THEN 2 ELSE 0 END AS impact FROM s)
SELECT id, round(impact, 6) AS impact FROM t ORDER BY impact DESC, id LIMIT 3""")
def impact_top(spark, folder):
    rows = pointed(spark, folder).withColumn("impact", P.impact(F.col("title"), F.col("points"), F.col("id") % 5 == 0, F.lit(0.8)))
    return rows.orderBy(F.desc("impact"), "id").limit(3).select("id", F.round("impact", 6).alias("impact"))


@query("trimmed_rows", WITH + "SELECT id FROM scored ORDER BY score * 0.4 + priority / 4.0 * 0.4 + 0.1 * (id % 3) DESC, id LIMIT 10")
def trimmed_rows(spark, folder):
    rows = scored(spark, folder).withColumns({"confidence": F.col("priority") / 4.0, "citations": F.array_repeat(F.lit("c"), (F.col("id") % 3).cast("int")), "points": F.array(F.lit("p"))})
    return P.trimmed(rows, 30, "score", "confidence").select("id")


@query("fallback_best", WITH + "SELECT id FROM scored ORDER BY score * 0.6 + priority / 4.0 * 0.4 DESC, id LIMIT 8")
def fallback_best(spark, folder):
    return P.fallback_best(scored(spark, folder).withColumn("confidence", F.col("priority") / 4.0), 8, "score", "confidence").select("id")


@query("representative_scores", WITH + """SELECT id, round(score + 0.5 + least(length(content) / 5000.0, 0.1) + greatest(0.0, 0.1 - id / 240.0), 6) AS of_duplicates, round(score + 0.5, 6) AS of_topics FROM scored""")
def representative_scores(spark, folder):
    rows = scored(spark, folder)
    one = P.representative_score(F.col("score"), F.lit(0.5), F.col("source_id"), F.col("content"), F.col("id"))
    other = P.topic_representative_score(F.col("score"), F.lit(0.5), F.col("source_id"), F.col("title"), F.array().cast("array<string>"))
    return rows.select("id", F.round(one, 6).alias("of_duplicates"), F.round(other, 6).alias("of_topics"))


NEAR = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
near AS (SELECT q.vec_id AS id, b.vec_id AS past_id, list_inner_product(q.e, b.e) AS similarity FROM v q JOIN v b ON q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id AND list_inner_product(q.e, b.e) >= 0.2)"""


@query("update_decisions", f"""WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, past_id) AS r FROM near),
g AS (SELECT id, max(similarity) AS similarity, array_to_string(list(past_id ORDER BY r), ',') AS refs FROM r WHERE r <= 3 GROUP BY 1)
SELECT v.vec_id, coalesce(g.similarity > 0.4, false) AS is_update, round(g.similarity, 6) AS similarity, coalesce(refs, '') AS refs FROM v LEFT JOIN g ON v.vec_id = g.id""")
def update_decisions(spark, folder):
    got = P.update_decisions(read(spark, folder, "embeddings"), _near(spark, folder), 0.4, "vec_id")
    return got.select("vec_id", "is_update", F.round("similarity", 6).alias("similarity"), F.array_join(F.transform("references", lambda r: r["id"].cast("string")), ",").alias("refs"))


def _near(spark, folder):
    from gleanery.operators import similarity as S

    vectors = read(spark, folder, "embeddings")
    return S.knn(vectors.where("vec_id % 50 = 0"), vectors, 3, 0.2).select(F.col("query_id").alias("id"), F.col("vec_id").alias("past_id"), "similarity")


@query("update_relations", f"""WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, past_id) AS r, max(similarity) OVER (PARTITION BY id) AS top FROM near)
SELECT past_id AS parent, id AS child, CASE WHEN top > 0.45 THEN 'update' WHEN similarity > 0.8 THEN 'sequel' ELSE 'related' END AS relation, round(similarity, 6) AS score FROM r WHERE r <= 3""")
def update_relations(spark, folder):
    got = P.update_decisions(read(spark, folder, "embeddings"), _near(spark, folder), 0.45, "vec_id")
    return P.update_relations(got.withColumn("decision", F.when(F.col("is_update"), "UPDATE").otherwise("KEEP")), "vec_id").withColumn("score", F.round("score", 6))


@query("cluster_edges", """WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1)
SELECT a.vec_id AS parent, b.vec_id AS child, 'related' AS relation, 0.75::DOUBLE AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id JOIN s ON s.label = a.label WHERE s.n <= 1000 OR a.vec_id = s.first""")
def cluster_edges(spark, folder):
    return P.cluster_edges(read(spark, folder, "embeddings"), "label", "vec_id")
