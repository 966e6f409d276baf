"""Rules on articles, pairs, sinks, joins and composed texts on literal inputs, against plain Python where there is one."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import compose, fixed, japanese
from gleanery.functions import text as T
from gleanery.operators import audits, boundaries, compatible, content_rules, density, joins, pair_rules, relevance_rules, sinks, stores, topics
from gleanery.sources import feeds

LONG = "OpenAI has released a model of 120 billion weights, as was announced today."


def rules_of(spark, points, rule=None, made=content_rules.content_violations):
    df = spark.createDataFrame([(1, points)], "id long, points array<string>")
    got = content_rules.violations(df, "id", made(F.col("points"))).collect()
    return [(r.rule_id, r.bullet, r.position, r.detail) for r in got if rule in (None, r.rule_id)]


def test_content_rules(spark):
    assert rules_of(spark, ["AI 技術の発表が 3 件です", "その 会社", "x"], "no_demonstrative_pronouns") == [("no_demonstrative_pronouns", None, 16, "その")]
    assert [r[1] for r in rules_of(spark, ["新しい製品です", "値は三", "終わり。"], "proper_sentence_ending")] == [1]
    assert rules_of(spark, ["発表です", "製品である"], "consistent_politeness")
    assert not rules_of(spark, ["発表です"], "consistent_politeness")
    for n, broken in ((2, True), (3, False), (4, False), (5, True)):
        assert bool(rules_of(spark, [LONG] * n, "bullet_point_count")) == broken
    for size, broken in ((19, True), (20, False), (150, False), (151, True)):
        assert bool(rules_of(spark, ["x" * size], "bullet_point_length")) == broken
    assert [r[1] for r in rules_of(spark, ["nothing here", "12 things", "Names", "カタカナ"], "specific_information")] == [0]
    assert rules_of(spark, ["これは、とても、長く、そして、複雑"], "sentence_complexity")
    assert rules_of(spark, ["word word", "word other other"], "repetitive_expressions") == [("repetitive_expressions", None, None, "word")]
    assert rules_of(spark, ["AI と 人工知能"], "foreign_term_usage") == [("foreign_term_usage", None, None, "AI|人工知能")]
    assert rules_of(spark, ["LLM は大規模言語モデル"], "ai_terminology_consistency")
    assert rules_of(spark, ["1,200 と 3400"], "number_format_consistency") and not rules_of(spark, ["1,200"], "number_format_consistency")
    assert rules_of(spark, None, "bullet_point_count") == [("bullet_point_count", None, None, "0")]
    assert rules_of(spark, [None, ""], "bullet_point_length")
    meta = rules_of(spark, ["はい、承知いたしました", LONG], None, lambda p: content_rules.production_violations(p, F.lit("AI")))
    assert {r[0] for r in meta} == {"PROD_META_TEXT", "PROD_INSUFFICIENT_DETAIL", "PROD_VAGUE_CONTENT", "PROD_TITLE_TOO_SHORT", "PROD_INSUFFICIENT_POINTS"}


def test_points_keep_the_digits_of_their_places(spark):
    points = ["10 rows and 2010", "11 rows or 1", "22 rows and 22"]
    assert [r[3] for r in rules_of(spark, points, "proper_sentence_ending")] == [p[-10:] for p in points]
    assert [r[3] for r in rules_of(spark, points, "bullet_point_length")] == [str(len(p)) for p in points]


def test_matches_have_places(spark):
    text = "この a その。どの b"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.inline(content_rules.matches(F.col("t"), "(?U)" + fixed.POINTERS, "r", "error"))).collect()
    assert [(r.position, r.detail) for r in got] == [(m.start(), m.group()) for m in re.finditer(fixed.POINTERS, text)]


def test_judged(spark):
    df = spark.createDataFrame([(1, [LONG + "です"] * 3, LONG), (2, None, None), (3, [], "")], "id long, points array<string>, title string")
    got = {r.id: r for r in content_rules.judged(df, "id").collect()}
    assert got[2].level == got[3].level == "failed" and got[2].title_score is None and got[1].merged == pytest.approx((got[1].score + got[1].title_score) / 2)
    short, repaired = spark.createDataFrame([(["x", "y" * 301],)], "p array<string>").select(F.array("p").alias("q"), content_rules.repaired_points(F.col("p"), F.lit("more")).alias("r")).first()
    assert repaired == ["x more", "y" * 297 + "...", "more"]
    assert spark.range(1).select(content_rules.finished_points(F.array(F.lit("発表した"), F.lit("新製品 "))).alias("p")).first().p == ["発表した", "新製品です"]


def test_relevance_of_videos_and_blacklist(spark):
    rows = [
        (1, "GPT news", "chatgpt and openai", "https://openai.com/x", "openai_news", "rss"),
        (2, "A short #shorts", "chatgpt", "https://youtube.com/1", "openai", "youtube"),
        (3, "career", "hiring and leadership", "https://youtube.com/2", "ycombinator", "youtube"),
        (4, "GPT", "靴 chatgpt", "https://x.com", "s", "rss"),
        (5, None, None, None, None, None),
        (6, "gaming", "bitcoin game", "https://x.com", "s", "rss"),
        (7, "plain words here", "of no kind", "https://x.org/shorts/9", "a16z", "youtube"),
    ]
    df = spark.createDataFrame(rows, "id long, title string, content string, url string, source_id string, source_type string")
    got = {r.id: r for r in relevance_rules.relevance(df).collect()}
    assert got[1].score == 1.0 and got[1].n_high == 3 and got[1].reason.startswith("High")
    assert [got[i].score for i in (2, 3, 4, 5, 6, 7)] == [0.0, 0.15, 0.0, 0.0, 0.0, 0.0]
    assert got[6].reason == "Non-AI content: 3 negative keywords detected"
    bonus = spark.createDataFrame([("https://www.openai.com/a", "x", 0.3), ("https://wired.com", "x", 0.15), ("https://cs.mit.edu", "", 0.2), ("https://zenn.dev/x", None, 0.1), (None, "openai_news", 0.25), ("nothing", "tldr_ai", 0.1), ("", "?", 0.0)], "u string, s string, b double")
    assert all(r.got == r.b for r in bonus.select("b", relevance_rules.host_bonus(F.col("u"), F.col("s")).alias("got")).collect())
    kept = spark.createDataFrame([("wired", "chatgpt and claude", True), ("wired", "chatgpt", False), ("bay_area_times", "chatgpt and claude", False), ("wired", "openai claude russia war", False), ("own", "x", True)], "s string, t string, want boolean")
    assert all(r.got == r.want for r in kept.select("want", relevance_rules.keeps_subject(F.col("t"), F.lit(None), F.lit(None).cast("array<string>"), F.col("s")).alias("got")).collect())
    assert relevance_rules.lexicon_sizes()["total"] > 200


def test_titles_that_clash(spark):
    pairs = [("Meta hiring spree", "New research model", True, False), ("Claude grows", "ChatGPT grows", True, True), ("学習中のメモ", "公式発表の話", True, False), ("Rain today", "Sun today", False, False), (None, "x", False, False)]
    df = spark.createDataFrame(pairs, "a string, b string, any boolean, strict boolean")
    for r in df.select("any", "strict", pair_rules.incompatible(F.col("a"), F.col("b")).alias("x"), pair_rules.incompatible(F.col("b"), F.col("a")).alias("y"), pair_rules.strictly_incompatible(F.col("a"), F.col("b")).alias("z")).collect():
        assert (r.x, r.y, r.z) == (r.any, r.any, r.strict)


def likeness(a, b):
    words = lambda t: [w for w in re.sub(r"[^\w\s]", "", t.lower()).split() if w not in T.STOP_WORDS]

    def jaccard(x, y):
        x, y = set(x), set(y)
        return 1.0 if not x | y else len(x & y) / len(x | y)

    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    ta, tb = a[1].lower(), b[1].lower()
    ca, cb = (" ".join(words(f"{r[1]} {r[2]}")) for r in (a, b))
    titles = max(jaccard(ta.split(), tb.split()), ratio(ta, tb))
    basic = max(jaccard(ca.split(), cb.split()), ratio(ca, cb))
    more = min(0.4 * titles + 0.35 * basic + 0.2 * ratio(a[2][:500], b[2][:500]), 1.0)
    return more if abs(more - basic) > 0.15 else basic


def weighted(b, a, hosts: bool) -> float:
    """likeness() of rows whose hosts may differ."""
    plain = lambda r: " ".join(w for w in f"{r[1]} {r[2]}".lower().split() if w not in T.STOP_WORDS)
    share = lambda x, y: len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()})
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    titles, basic = (max(share(x, y), ratio(x, y)) for x, y in ((b[1], a[1]), (plain(b), plain(a))))
    more = min(0.4 * titles + 0.35 * basic + 0.2 * ratio(b[2][:500], a[2][:500]) + 0.1 * hosts, 1.0)
    return more if abs(more - basic) > 0.15 else basic


def test_duplicates_against_python(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "First title", base), (2, "First title", base + " nu"), (3, "Other", "quite different words stand here"), (4, "first Title", base.replace("alpha", "omega")), (5, "First title", base), (6, "", "")]
    df = spark.createDataFrame([(*r, "https://x.com") for r in rows], "id long, title string, content string, url string")
    got = {r.id: (r.duplicate_of, round(r.score, 6)) for r in pair_rules.duplicates(df).collect()}
    want = {}
    for i, b in enumerate(rows[:4]):
        scores = [(likeness(b, a), -a[0]) for a in rows[:i]]
        if scores and max(scores)[0] >= 0.65:
            want[b[0]] = (-max(scores)[1], round(max(scores)[0], 6))
    want[5] = (1, 1.0)  # a copy goes with the first row of its words
    assert got == want


def test_duplicates_find_the_likeliest_of_many_alike(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7))) for _ in range(200)]
    bases = [rng.sample(vocabulary, 50) for _ in range(4)]
    changed = lambda b, p: [rng.choice(vocabulary) if rng.random() < p else w for w in b]
    rows = [(i, " ".join(changed(bases[i % 4][:4], 0.2)), " ".join(changed(bases[i % 4], 0.04 * (i % 7))), f"https://{('cnet.com', 'wired.com', 'x.com')[i % 3]}/{i}") for i in range(80)]
    got = {r.id: (-r.duplicate_of, r.score) for r in pair_rules.duplicates(spark.createDataFrame(rows, "id long, title string, content string, url string")).collect()}
    want, hosts = {}, lambda r: r[3].split("/")[2]
    sets = [{*f"{r[1]} {r[2]}".split()} - {*T.STOP_WORDS} for r in rows]
    first = [sets.index(s) for s in sets]
    for b in rows:
        found = []
        for a in rows[: b[0]] if first[b[0]] == b[0] else [rows[first[b[0]]]]:  # a copy goes with the first row of its words
            p, q = sets[a[0]], sets[b[0]]
            if first[a[0]] == a[0] and len(p & q) / len(p | q) >= 0.4:
                found.append((weighted(b, a, hosts(a) != hosts(b) and "x.com" not in (hosts(a), hosts(b))), -a[0]))
        if found and max(found)[0] >= 0.65:
            want[b[0]] = max(found)[::-1]
    assert len(want) > 40 and got.keys() == want.keys()
    assert [(i, got[i], w) for i, w in want.items() if got[i][0] != w[0] or abs(got[i][1] - w[1]) > 1e-12] == []


def test_ratios_over_a_floor_are_those_of_difflib():
    rng = random.Random(6)
    for n in (0, 1, 30, 300, 900):
        a = "".join(rng.choices("abcdeghiouzq ", k=n))
        for b in (a, "", a[n // 3 :] + a[: n // 3], "".join(c if rng.random() > 0.1 else "x" for c in a)):
            for x, y in ((a, b), (b, a)):
                whole = difflib.SequenceMatcher(None, x, y).ratio()
                assert [compatible.ratio_over(x, y, f) for f in (0.0, 0.5, 0.9, 1.0)] == [max(whole, f) for f in (0.0, 0.5, 0.9, 1.0)]


def test_consolidated_and_citations(spark):
    rows = spark.createDataFrame([(1, "T one", ["a", "b"], "src_a", 0.5, "https://a.com/1", "c"), (2, "T two", ["c"], "src_b", 0.9, "https://b.com/2", "c"), (3, "T three", ["d"], "src_c", 0.9, "https://b.com/2", "c"), (4, "Alone", [], "src_a", 0.1, "https://a.com/4", "c")], "id long, title string, points array<string>, source_id string, s double, url string, content string")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, leader long")
    got = {r.id: r for r in pair_rules.consolidated(rows, groups, F.col("s")).collect()}
    assert set(got) == {2, 4} and got[2].title == "🆙 T two" and got[2].points == ["c [関連報道: Src A, Src C]"] and got[2].dropped == 2 and got[4].title == "Alone"
    cited = {r.leader: [c.url for c in r.citations] for r in pair_rules.citations(rows.join(groups, "id"), "leader", F.col("s")).collect()}
    assert cited == {1: ["https://b.com/2", "https://a.com/1"], 4: ["https://a.com/4"]}
    line = spark.range(1).select(pair_rules.citation_line(pair_rules.citation(F.lit("the_source"), F.lit("https://github.com/x"), F.lit("t" * 120), F.lit(None))).alias("l")).first().l
    assert line == "**The Source (GitHub)** (https://github.com/x): " + "t" * 97 + "..."


def test_cluster_edges_of_large_groups(spark):
    df = spark.createDataFrame([(i, 1) for i in range(6)] + [(10, 2), (11, 2), (20, -1), (21, -1), (30, 3)], "id long, g int")
    small = {(r.parent, r.child) for r in pair_rules.cluster_edges(df, "g").collect()}
    assert small == {(a, b) for a in range(6) for b in range(a + 1, 6)} | {(10, 11)}
    assert {(r.parent, r.child) for r in pair_rules.cluster_edges(df, "g", most=3).collect()} == {(0, b) for b in range(1, 6)} | {(10, 11)}


def test_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert sorted(sinks.create_tables(spark, folder)) == sorted(sinks.TABLES) and sinks.create_tables(spark, folder) == []
    assert all(there and not lacks for there, lacks in sinks.health(spark, folder).values())
    assert sinks.health(spark, folder, {"none": ["x"]}) == {"none": (False, ["x"])}
    path = f"{folder}/t"
    first = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k long, v string, at int")
    sinks.upsert_table(first, path, ["k"], "at")
    sinks.upsert_table(spark.createDataFrame([(1, "b", 1), (1, "old", 0), (2, "c", 1), (None, "m", 2)], "k long, v string, at int"), path, ["k"], "at")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "b"), (2, "c"), (None, "m")}
    for _ in range(2):
        sinks.insert_missing(spark.createDataFrame([(None, "z", 1), (3, "d", 1), (3, "e", 1)], "k long, v string, at int"), path, ["k"])
    assert sorted((r.k or 0, r.v) for r in spark.read.parquet(path).collect()) == [(0, "m"), (1, "b"), (2, "c"), (3, "d")]
    copy = sinks.backup(spark, path, f"{folder}/backups", "2024-01-01")
    assert spark.read.parquet(copy).count() == 4
    sinks.markdown_files(spark.createDataFrame([("a.md", "# A\n\ntext"), ("b.md", "B")], "file string, text string"), f"{folder}/md")
    assert {r.file for r in spark.read.text(f"{folder}/md").collect()} == {"a.md", "b.md"}
    sinks.export_json(first, f"{folder}/j")
    assert spark.read.json(f"{folder}/j").count() == 2
    sinks.save_run(spark.createDataFrame([("d", "e", 1)], "processing_date string, edition string, updated int"), spark.createDataFrame([("d", "e", 1)], "processing_date string, edition string, ended int"), f"{folder}/docs", f"{folder}/logs")
    assert spark.read.parquet(f"{folder}/logs").count() == 1
    assert sinks.next_version(["1.0", "1.2"]) == "1.3" and sinks.next_version([]) == "1.0" and sinks.backoff(3, 1, 5, 0.5) == 5.0
    old = spark.createDataFrame([(None, "a")], "k long, v string")
    assert stores.insert_new(stores.insert_new(old, old, ["k"]), old, ["k"]).count() == 1
    assert [r.v for r in stores.upsert(old.withColumn("at", F.lit(1)), spark.createDataFrame([(None, "z", 1), (None, "y", 1)], "k long, v string, at int"), ["k"], "at").collect()] == ["y"]


def test_vectors_from_text(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[1,",), ("[1, 2, 3]",), (None,), ('["x", 1]',), ("[1, null]",)], "t string")
    assert [r.embedding for r in sinks.parsed_vectors(df, "t", 2).collect()] == [[1.0, 2.0]]


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (None, 9), (2, None)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 5, "c"), (1, 9, "d"), (None, 1, "n")], "k long, u long, v string")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {(1, 5): "c", (1, 1): None, (None, 9): None, (2, None): None}
    points = spark.createDataFrame([(x / 2,) for x in range(40)] + [(None,)], "p double")
    spans = spark.createDataFrame([(1, 0.0, 3.0), (2, 2.5, 2.5), (3, 2.9, 17.2), (4, None, 2.0)], "s long, a double, b double")
    for width in (0.7, 5.0, 100.0):
        got = sorted((r.s, r.p) for r in joins.within(points, spans, "p", "a", "b", width).collect())
        assert got == sorted((s, x / 2) for s, a, b in ((1, 0.0, 3.0), (3, 2.9, 17.2)) for x in range(40) if a <= x / 2 < b)
    assert sorted(r.v for r in joins.first_of_each(right, ["k"], "u").collect()) == ["a", "n"]


def test_references_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    unit = lambda n: [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))]
    rows, good, bad = (spark.createDataFrame(unit(n), "id long, embedding array<double>") for n in (20, 30, 9))
    whole = {r.id: round(r.score, 9) for r in topics.contrast(rows, good, bad).collect()}
    monkeypatch.setattr(topics, "REFERENCES", 7)
    assert whole == {r.id: round(r.score, 9) for r in topics.contrast(rows, good, bad).collect()}


def test_long_chains_settle(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(14)], "a long, b long")
    got = {r.id: r.leader for r in topics.leader_groups(spark.range(15), pairs).collect()}
    assert got == {i: i - i % 2 for i in range(15)}
    assert {r.root for r in density.linked(pairs).collect()} == {0}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(japanese.plain_style(F.lit("これは製品だ。 新しい。。という形で"))) == "これは製品です。 新しい。"
    assert one(japanese.punctuation(F.lit("はい，そう ．　本当！ "))) == "はい、そう。 本当!"
    assert one(japanese.shortened(F.lit("一。二三四五六"), 4)) == "一。" and one(japanese.shortened(F.lit("abcdef"), 4)) == "abc…"
    assert one(japanese.sentences(F.lit("x" * 30 + "。sorry " + "y" * 30 + "。z"))) == ["x" * 30]
    assert one(relevance_rules.script_ratio(F.lit("日本ab"))).cjk == 0.5 and one(relevance_rules.needs_translation(F.lit("")))
    assert one(compose.title_summary(F.lit("OpenAI and GPT"))) == "AI技術・GPTモデル領域の最新技術進展"
    assert one(compose.title_summary(F.lit(None).cast("string"))) == "の技術的進展と影響"
    assert one(compose.point_summary(F.lit("t"), F.array(F.lit("- " + "あ" * 170 + "。" + "い" * 60)))) == "あ" * 170 + "。"
    assert one(compose.point_summary(F.lit("t"), F.array(F.lit("あ" * 201)))) == "あ" * 190 + "..."
    assert one(compose.generic_title(F.lit("新製品について"))) and not one(compose.generic_title(F.lit("新製品")))
    assert [one(compose.lead_paragraph_verdict(F.lit(t))) for t in ("短い", "企業が。とても長い文があります。", "新しい製品が公開されました。", "あ" * 201, "新しい製品が公開された模様")] == ["short", "broken", "ok", "long", "ending"]
    assert one(compose.search_slug(F.lit("【速報】「Big News」about API"))) == "Big+News+API"
    assert one(compose.safe_lead(F.array(F.lit("Google x"), F.lit("Meta")), F.lit(2)))[0].startswith("AI分野においてGoogle、Metaを")
    assert one(pair_rules.cited_terms(F.lit("nothing"))) == list(fixed.DEFAULT_TERMS)
    v = one(boundaries.embedded(F.lit("one two\none"), 16))
    assert abs(sum(x * x for x in v) - 1) < 1e-5 and one(boundaries.embedded(F.lit(None).cast("string"), 16)) is None


def test_scan_of_feeds(spark):
    item = "<item><title>T{0}</title><link>https://x.com/{0}</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><category>c</category></item>"
    rows = [("a", "<rss>" + item.format(1) + item.format(2) + "</rss>", "rss", ["own"]), ("b", None, "rss", None), ("c", "<html/>", "web", None), ("d", "<rss>" + item.format(3) + "</rss>", "fax", None), ("e", "<rss>" + item.format(4) + "</rss>", "YouTube", None)]
    df = spark.createDataFrame(rows, "source string, xml string, kind string, tags array<string>")
    found, failed = feeds.scan(df, "source", "xml", "kind", F.expr("timestamp'2024-01-02 00:00:00'"), 48, 5, "tags")
    assert sorted((r.source, r.title, r.tags) for r in found.collect()) == [("a", "T1", ["own", "c"]), ("a", "T2", ["own", "c"]), ("e", "T4", ["c"])]
    assert {(r.source, r.reason) for r in failed.collect()} == {("b", "missing"), ("c", "no entries")}


def test_breaker_and_prompts(spark):
    calls = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True] * 2 + [False] * 5 + [True] * 2)] + [("b", i, ok) for i, ok in enumerate([False] * 5 + [True] * 3)] + [("c", 0, False)], "g string, i int, ok boolean")
    assert {r.g: r.state for r in audits.breaker(calls, "g", F.col("ok"), F.asc("i")).collect()} == {"a": "open", "b": "closed", "c": "closed"}
    empty = spark.createDataFrame([], "id long, v array<double>")
    r = audits.vector_stats(empty, "v").first()
    assert (r.n, r.dimension, r.bytes) == (0, 0, 0)
