"""Queries on titles, replies, images, citations and whole documents; catalog.py holds the others and adds these."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.catalog import ARTICLES, DOMAINS, WITH, _tags, query
from gleanery.functions import images as I
from gleanery.functions import text as T
from gleanery.functions import titles as H
from gleanery.operators import compatible as P
from gleanery.operators import density as D
from gleanery.operators import documents as M
from gleanery.operators import relevance as R
from gleanery.operators import similarity as S
from gleanery.operators import topics as C
from gleanery.sources.tables import articles, read

ONLY = f"WITH {ARTICLES}\n"
#: Parameters for the test corpus.
EXCLUSIVE = [("one", "four"), ("two", "three")]
CLASHES = [(["therean", "ingthe"], [" les "]), (["und"], [" que "])]
EVENTS = {"first": (["the", "of", "and"], ["therean", "ingthe"]), "second": (["und", "der", "die"], ["das"])}
RATES = {"user": 0.0005, "assistant": 0.0008}
CLASSES = [(["timeout", "therean"], "retry"), (["quota", "und "], "wait"), ([" les "], "stop")]


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


@query("comparable_titles", ONLY + r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title),
  '(?i)^breaking[:\s]*', '', 'g'), '(?i)^exclusive[:\s]*', '', 'g'), '(?i)^report[:\s]*', '', 'g'), '(?i)\s*\[update\]$', '', 'g'), '(?i)\s*\(updated?\)$', '', 'g'), '(?i)\s*- report$', '', 'g'), '\s+', ' ', 'g')) AS title FROM articles""")
def comparable_titles(spark, folder):
    return articles(spark, folder).select("id", H.comparable(F.col("title")).alias("title"))


@query("mentions", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(\d+%)', 1), regexp_extract_all(text, '(v?\d+\.\d+)', 1)))), ',') AS found FROM documents")
def mentions(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.array_join(F.array_sort(H.mentions(F.col("text"), [r"\d+%", r"v?\d+\.\d+"])), ",").alias("found"))


@query("headings", ONLY + r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[#*_`\[\]]', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'), '[.,:;!?]+$', '', 'g')) AS heading FROM articles")
def headings(spark, folder):
    return articles(spark, folder).select("id", H.heading(F.col("title")).alias("heading"))


@query("cut_titles", ONLY + r"""SELECT id, CASE WHEN length(title) <= 60 THEN title WHEN regexp_extract(title[:60], '(?s)^(.*[.!?。！？])', 1) <> '' THEN regexp_extract(title[:60], '(?s)^(.*[.!?。！？])', 1)
  WHEN regexp_extract(title[:59], '(?s)^(.{30,})[,;、，]', 1) <> '' THEN regexp_extract(title[:59], '(?s)^(.{30,})[,;、，]', 1) || '…'
  WHEN regexp_extract(title[:59], '(?s)^(.{30,})\s', 1) <> '' THEN regexp_extract(title[:59], '(?s)^(.{30,})\s', 1) || '…' ELSE title[:59] || '…' END AS title FROM articles""")
def cut_titles(spark, folder):
    return articles(spark, folder).select("id", H.cut_at(F.col("title"), 60).alias("title"))


@query("title_quality")
def title_quality(spark, folder):
    return articles(spark, folder).select("id", H.title_quality(F.col("title")).alias("q")).select("id", "q.score", "q.level", "q.acceptable")


@query("title_accepted", ONLY + f"""SELECT id, score, accepted FROM (SELECT id, {_any("title", ["the", "und"])} AS named, (CASE WHEN named THEN 3 ELSE 0 END + CASE WHEN regexp_matches(title, '[0-9]+') THEN 2 ELSE 0 END
  + CASE WHEN {_any("title", ["ing"])} THEN 1 ELSE 0 END)::INTEGER AS score, length(title) BETWEEN 10 AND 60 AND named AND NOT regexp_matches(title, 'q') AND NOT (ends_with(title, 'of') OR ends_with(title, ',')) AS accepted FROM articles)""")
def title_accepted(spark, folder):
    got = H.title_accepted(F.col("title"), ["the", "und"], r"[0-9]+", ["ing"], ["q"], ["of", ","])
    return articles(spark, folder).select("id", got.alias("q")).select("id", "q.score", "q.accepted")


@query("budget", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, length(p) AS l, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM p)
SELECT doc_id, count(*) FILTER (s <= 500)::INTEGER AS n, COALESCE(sum(l) FILTER (s <= 500), 0)::INTEGER AS used FROM c GROUP BY 1""")
def budget(spark, folder):
    kept = H.within_budget(F.split("text", "\n"), 500)
    return read(spark, folder, "documents").where("text is not null").select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n"), F.length(F.array_join("k", "")).alias("used"))


@query("reply_points", r"""WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*•・]|\d+[.)])[ \t]*(\S[^\n]*)$', 1), lambda s: trim(s, ' ')) AS b,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\n]'), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 30 AND 300) AS s FROM documents),
q AS (SELECT doc_id, CASE WHEN len(b) > 0 THEN b ELSE s END AS p FROM p),
r AS (SELECT doc_id, len(p) AS n, list_transform(p[:4], lambda x: CASE WHEN length(x) < 30 THEN x || ' more' WHEN length(x) > 300 THEN x[:297] || '...' ELSE x END) AS p FROM q)
SELECT doc_id, n::INTEGER AS n, array_to_string(list_concat(p, CASE len(p) WHEN 0 THEN ['more', 'more', 'more'] WHEN 1 THEN ['more', 'more'] WHEN 2 THEN ['more'] ELSE [] END), chr(10)) AS points FROM r""")
def reply_points(spark, folder):
    rows = read(spark, folder, "documents").where("text is not null").select("doc_id", H.summary_points(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.array_join(H.repaired_points(F.col("p"), "more"), "\n").alias("points"))


@query("clean_bullets", r"""SELECT doc_id, array_to_string(list_transform(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[\n]'), lambda s: trim(s, ' ')), lambda s: length(s) >= 10),
  lambda p: regexp_replace(regexp_replace(p, '^[-*•・]\s*', ''), '^(?:also |and )', '')), lambda p: CASE WHEN ends_with(p, '.') OR ends_with(p, '!') THEN p ELSE p || '.' END), chr(10)) AS points FROM documents""")
def clean_bullets(spark, folder):
    points = H.bullets(F.split("text", r"\n"), 10, ("also ", "and "), (".", "!"))
    return read(spark, folder, "documents").select("doc_id", F.array_join(points, "\n").alias("points"))


@query("model_cost", "SELECT conv_id, round(sum(CASE WHEN COALESCE(length(text), 0) = 0 THEN 0.0 ELSE round((greatest(length(text) // 4, 1) * 2) / 1000 * CASE role WHEN 'user' THEN 0.0005 WHEN 'assistant' THEN 0.0008 ELSE 0.0 END, 4) END)::DOUBLE, 4) AS cost FROM conversations GROUP BY 1")
def model_cost(spark, folder):
    price = H.cost(F.col("role"), F.col("text"), F.col("text"), RATES)
    return read(spark, folder, "conversations").groupBy("conv_id").agg(F.round(F.sum(price), 4).alias("cost"))


@query("first_class", "SELECT CASE " + " ".join(f"WHEN {_any('lower(text)', terms)} THEN '{name}'" for terms, name in CLASSES) + " ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1")
def first_class(spark, folder):
    return read(spark, folder, "documents").groupBy(H.first_class(F.col("text"), CLASSES, "other").alias("class")).agg(F.count("*").alias("n"))


_PAIRS = "articles a JOIN articles b ON b.id = a.id + 1"


@query("clashing_neighbours", ONLY + f"SELECT a.id AS a, b.id AS b FROM {_PAIRS} WHERE " + " OR ".join(f"({_any('lower(a.content)', x)} AND {_any('lower(b.content)', y)})" for p, q in CLASHES for x, y in ((p, q), (q, p))))
def clashing_neighbours(spark, folder):
    a = articles(spark, folder).select(F.col("id").alias("a"), F.col("content").alias("x"), (F.col("id") + 1).alias("b"))
    b = articles(spark, folder).select(F.col("id").alias("b"), F.col("content").alias("y"))
    return a.join(b, "b").where(P.clash(F.col("x"), F.col("y"), CLASHES)).select("a", "b")


_APART = " OR ".join(f"(list_contains({u}, '{p}') AND list_contains({v}, '{q}'))" for p, q in EXCLUSIVE for u, v in (("a.t", "b.t"), ("b.t", "a.t")))


@query("same_field_neighbours", ONLY + f""", t AS (SELECT id, {_tags("content")} AS t FROM articles)
SELECT a.id AS a, b.id AS b, len(a.t) = 0 OR len(b.t) = 0 OR (len(list_intersect(a.t, b.t)) > 0 AND NOT ({_APART})) AS same, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) END, 6) AS likeness
FROM t a JOIN t b ON b.id = a.id + 1""")
def same_field_neighbours(spark, folder):
    tagged = articles(spark, folder).select("id", C.tags(F.col("content"), DOMAINS).alias("t"))
    a = tagged.select(F.col("id").alias("a"), F.col("t").alias("x"), (F.col("id") + 1).alias("b"))
    rows = a.join(tagged.toDF("b", "y"), "b")
    return rows.select("a", "b", P.same_field(F.col("x"), F.col("y"), EXCLUSIVE).alias("same"), F.round(P.likeness_terms(F.col("x"), F.col("y")), 6).alias("likeness"))


@query("coherent_groups", ONLY + f""", t AS (SELECT id, strftime(published, '%Y%m%d%H')[:9] AS part, {_tags("content")} AS t FROM articles)
SELECT part, count(*) AS n, NOT EXISTS (SELECT 1 FROM t a JOIN t b ON a.part = b.part AND a.id <> b.id WHERE a.part = o.part AND ({_APART})) AS coherent FROM t o GROUP BY part""")
def coherent_groups(spark, folder):
    part = F.substring(F.date_format("published", "yyyyMMddHH"), 1, 9)
    rows = articles(spark, folder).select("id", part.alias("part"), C.tags(F.col("content"), DOMAINS).alias("t"))
    return P.coherent_groups(rows, "part", "t", EXCLUSIVE)


_TOLD = " UNION ALL ".join(f"SELECT id, published, '{n}' AS event FROM articles WHERE {' + '.join(f'''contains(lower(content), '{t}')::INT''' for t in core)} >= 2 AND {_any('lower(content)', var)}" for n, (core, var) in EVENTS.items())


@query("event_matches", ONLY + f", t AS ({_TOLD}), p AS (SELECT event, min(id) AS past_id FROM t WHERE published < TIMESTAMP '2024-01-08 00:00:00' GROUP BY 1) SELECT id, event, past_id FROM t JOIN p USING (event) WHERE published >= TIMESTAMP '2024-01-08 00:00:00'")
def event_matches(spark, folder):
    rows, day = articles(spark, folder), F.expr("timestamp'2024-01-08 00:00:00'")
    return P.event_matches(rows.where(F.col("published") >= day), rows.where(F.col("published") < day), EVENTS)


@query("dealt_out", """WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_regionkey = 0 AS had, (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM supplier) AS u FROM nation),
s AS (SELECT *, CASE WHEN had THEN greatest(2, greatest(u // a, 1) + (i < u % a)::INT) ELSE greatest(u // a, 1) + (i < u % a)::INT END AS n FROM o),
f AS (SELECT *, COALESCE(sum(n) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM s),
x AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT n_nationkey, s_suppkey, place FROM f JOIN x ON place >= lo AND place < lo + n""")
def dealt_out(spark, folder):
    owners = read(spark, folder, "nation").select("n_nationkey", (F.col("n_regionkey") == 0).alias("had"), F.col("n_nationkey").alias("ord"))
    items = read(spark, folder, "supplier").select("s_suppkey", F.col("s_suppkey").alias("ord"))
    return P.dealt_out(owners, items, "n_nationkey", "s_suppkey")


@query("sequence_ratio")
def sequence_ratio(spark, folder):
    """The likeness of candidate pairs by matching blocks of their titles."""
    rows = articles(spark, folder).withColumn("tokens", T.words(F.col("content")))
    pairs, titles = S.jaccard_pairs(rows, 0.8), rows.select("id", "title")
    both = pairs.join(titles.toDF("a", "x"), "a").join(titles.toDF("b", "y"), "b")
    return both.select("a", "b", F.round(P.sequence_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


@query("density_groups", """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE 2 - 2 * list_inner_product(a.e, b.e) <= 0.09),
r AS (SELECT DISTINCT a AS vec_id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id)
SELECT vec_id, COALESCE(m, -1) AS "group" FROM embeddings LEFT JOIN (SELECT vec_id, min(root) AS m FROM r GROUP BY 1) USING (vec_id)""")
def density_groups(spark, folder):
    vectors = read(spark, folder, "embeddings")
    return D.density_groups(vectors, 0.3, vectors.select(F.max(F.size("embedding"))).first()[0])


_FOUND = r"""found AS (SELECT doc_id, unnest(list_filter([CASE WHEN trim(COALESCE(text, '')) = '' THEN {'rule': 'empty', 'severity': 'critical'} END, CASE WHEN length(p[1]) < 100 THEN {'rule': 'short_lead', 'severity': 'major'} END,
  CASE WHEN length(p[1]) > 1000 THEN {'rule': 'long_lead', 'severity': 'minor'} END, CASE WHEN len(p) - 1 < 3 THEN {'rule': 'few_sections', 'severity': 'major'} END, CASE WHEN len(p) - 1 > 10 THEN {'rule': 'many_sections', 'severity': 'minor'} END,
  CASE WHEN NOT regexp_matches(text, '[.!?。！？]\s*$') THEN {'rule': 'open_end', 'severity': 'minor'} END], lambda x: x IS NOT NULL), recursive := true) FROM (SELECT doc_id, text, regexp_split_to_array(text, '\n#{1,3}\s+') AS p FROM documents))"""


@query("document_findings", f"WITH {_FOUND} SELECT doc_id, rule, severity FROM found")
def document_findings(spark, folder):
    return M.findings(read(spark, folder, "documents"), "doc_id", "text")


@query("document_verdicts", f"""WITH {_FOUND}, c AS (SELECT doc_id, count(rule) FILTER (severity = 'critical') AS critical, count(rule) FILTER (severity = 'major') AS major, count(rule) FILTER (severity = 'minor') AS minor FROM documents LEFT JOIN found USING (doc_id) GROUP BY 1),
s AS (SELECT *, round(greatest(1 - critical * 0.2 - major * 0.1 - minor * 0.05, 0)::DOUBLE, 6) AS score FROM c) SELECT *, score < 0.5 OR critical > 0 AS redo FROM s""")
def document_verdicts(spark, folder):
    docs = read(spark, folder, "documents")
    return M.verdicts(docs, "doc_id", M.findings(docs, "doc_id", "text"))


@query("document_reports", f"""WITH {_FOUND}, l AS (SELECT doc_id, severity, severity || ': ' || string_agg(DISTINCT rule, ', ' ORDER BY rule) AS line FROM found GROUP BY 1, 2)
SELECT doc_id, string_agg(line, chr(10) ORDER BY severity) AS report FROM l GROUP BY 1""")
def document_reports(spark, folder):
    return M.report(M.findings(read(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@query("document_links", r"""WITH u AS (SELECT doc_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS url FROM (SELECT doc_id, regexp_extract_all(text, '(https?://[^\s)"''<>]+)', 1) AS f FROM documents))
SELECT doc_id, count(url) AS links, count(DISTINCT url) AS distinct_links, count(DISTINCT regexp_extract(url, '://([^/]+)', 1)) AS hosts, CASE WHEN count(url) > 0 THEN round(1 - count(DISTINCT url) / count(url), 6) ELSE 0 END AS repeated FROM u GROUP BY 1""")
def document_links(spark, folder):
    return M.addresses(read(spark, folder, "documents"), "doc_id", "text").withColumn("repeated", F.round("repeated", 6))


@query("document_sections", r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,3}[ \t\r\f\v]+)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS place FROM p)
SELECT doc_id, CAST(place AS INTEGER) AS place, CASE WHEN place > 0 THEN regexp_replace(split_part(p, chr(10), 1), '^#{1,3}[ \t\r\f\v]+', '') ELSE '' END AS title,
  regexp_replace(CASE WHEN place > 0 THEN regexp_replace(p, '^[^\n]*\n?', '') ELSE p END, '^[ \n]+|[ \n]+\z', '', 'g') AS body FROM e""")
def document_sections(spark, folder):
    return M.sections(read(spark, folder, "documents"), "doc_id", "text")


@query("contents", WITH + """, r AS (SELECT source_id, title, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, id) AS k FROM scored)
SELECT source_id, string_agg(k || '. ' || title, chr(10) ORDER BY k) AS contents FROM r WHERE k <= 5 GROUP BY 1""")
def contents(spark, folder):
    from gleanery.catalog import scored

    best = R.best_of_each(scored(spark, folder).withColumn("score", F.round("score", 9)), "source_id", 5, F.desc("score"), F.asc("id"))
    return M.numbered(best.drop("rank"), "source_id", F.col("title"), F.desc("score"), F.asc("id"))


@query("page_images")
def page_images(spark, folder):
    return read(spark, folder, "pages").select("page_id", I.chosen_image(F.col("url"), F.col("html")).alias("image"))


_FOLDER = r"regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)"


@query("full_links", rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][\w+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][\w+.-]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) || href ELSE CASE WHEN ends_with({_FOLDER}, '/') THEN {_FOLDER} ELSE {_FOLDER} || '/' END || href END AS link FROM l""")
def full_links(spark, folder):
    rows = read(spark, folder, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return rows.select("page_id", I.resolved(F.col("url"), F.col("href")).alias("link"))
