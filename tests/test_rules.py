import difflib
import random
import re

from pyspark.sql import functions as F

from gleanery.functions import images as I
from gleanery.functions import titles as H
from gleanery.operators import compatible as P
from gleanery.operators import density as D
from gleanery.operators import documents as M
from gleanery.sources import feeds


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


def test_title_quality_matches_the_rules_in_python(spark):
    dice = random.Random(1)
    titles = [" ".join(dice.choice(["a", "at", "cat", "LLMの技術", "LLM", "AI技術", "long words", "🆙🚀☀", "..."]) for _ in range(dice.randint(1, 6))) for _ in range(200)] + ["AI技術", ""]

    def score(t):
        lost = 30 * bool(re.search(r"(\w+)\s+\1\b", t)) + 30 * bool(re.search(r"(LLM|AI|GPT)の技術.*?\1", t)) + 30 * bool(re.search(r"(\w+)技術\s*\1", t))
        lost += 40 * any(re.search(g, t) for g in H.GENERIC_TITLES) + 25 * t.endswith("...") + 15 * (len(t) < 15) + 10 * (len(re.findall("[\U0001f300-\U0001faff☀-⟿]", t)) > 2)
        return max(0, 100 - lost)

    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", H.title_quality(F.col("t")).alias("q")).collect()
    assert [r.q.score for r in got] == [score(r.t) for r in got]
    assert all(r.q.acceptable == (r.q.score >= 60) for r in got)


def test_titles(spark):
    t = F.col("t")
    assert one(spark, H.comparable(t), t="BREAKING: New  Model [Update]") == "new model"
    assert one(spark, H.said_once(t, ["LLM", "AI"], ["で", "が"]), t="LLMでLLM と AI AI") == "LLM と AI"
    assert one(spark, H.headline(t, F.lit(True)), t="【続報】Foo が公開") == "Foo が公開🆙"
    assert one(spark, H.headline(t, F.lit(False), 12), t="The price of a Thing falls") == "The price…"
    assert one(spark, H.cut_at(t, 12), t="One. Two is longer") == "One."
    assert one(spark, H.cut_at(t, 6), t="abcdefghi") == "abcde…"
    assert one(spark, H.mentions(t, H.PRODUCTS), t="GPT-4 and Claude-3, GPT-4") == ["GPT-4", "Claude-3"]
    assert one(spark, H.clause(t, [["企業"], ["開発者"]], 3, 20), t="長い話。開発者が喜ぶ。") == "開発者が喜ぶ"
    assert one(spark, H.clause(t, [["企業"]]), t="長い話。") == ""
    assert one(spark, H.bullets(F.col("p")), p=["- また、これは長い文です。", "短い", None, "これも十分に長い文です"]) == ["また、これは長い文です。"[3:], "これも十分に長い文です。"]
    assert one(spark, H.display_name(t, {"x_y": "Known"}), t="some-source") == "Some Source"
    assert one(spark, H.reply_text(t, ["sure", "here is"], [r"(?i)^title:\s*"], [r"\s*\(end\)$"]), t='Sure, here it is:\n"A longer title (end)"\nno') == "A longer title"
    assert one(spark, H.first_class(t, H.RECOVERY, "retry"), t="Auth failed") == "fail_fast"
    assert one(spark, H.run_date(t, F.to_date(F.lit("2020-01-01"))), t="2025-06-29_x").isoformat() == "2025-06-29"
    assert one(spark, H.run_date(t, F.to_date(F.lit("2020-01-01"))), t="run").isoformat() == "2020-01-01"
    assert [one(spark, H.context_decision(t.cast("double")), t=x) for x in ("0.999", "0.95", "0.5", None)] == ["SKIP", "UPDATE", "KEEP", "KEEP"]


def test_replies(spark):
    t = F.col("t")
    assert one(spark, H.summary_points(t), t='{"summary_points": ["a", "b"]}') == ["a", "b"]
    assert one(spark, H.summary_points(t), t='Here:\n```json\n{"summary_points": ["a"]}\n```') == ["a"]
    assert one(spark, H.summary_points(t), t="Points:\n- one\n 2. two") == ["one", "two"]
    assert one(spark, H.summary_points(t), t="This sentence is quite long enough to stay. No.") == ["This sentence is quite long enough to stay"]
    assert one(spark, H.repaired_points(F.col("p"), "n", 3, 8), p=["a", "abcdefghij"]) == ["a n", "abcde...", "n"]
    assert one(spark, H.within_budget(F.col("p"), 5), p=["abc", "de", "", "f", "g"]) == ["abc", "de", ""]


def test_images(spark):
    t = F.col("t")
    assert one(spark, I.video_id(t), t="https://youtu.be/abc?t=1") == "abc"
    assert one(spark, I.video_id(t), t="https://example.com/") is None
    html = '<meta name="og:image" content="b.png"><meta content="a.png" property="og:image"><img src="logo.png"><img width="100" height="100" src="c.png"><img src="d.png">'
    assert one(spark, I.meta_image(t), t=html) == "a.png"
    assert one(spark, I.page_image(t), t=html) == "d.png"
    assert one(spark, I.chosen_image(F.lit("https://www.youtube.com/watch?v=xy&z=1"), t), t=html) == "https://img.youtube.com/vi/xy/maxresdefault.jpg"
    assert one(spark, I.chosen_image(F.lit("https://example.com"), t), t="<p>") is None
    for link, full in (("x.html", "http://h/a/x.html"), ("/x", "http://h/x"), ("//k/x", "http://k/x"), ("https://z", "https://z")):
        assert one(spark, I.resolved(F.lit("http://h/a/b?q#f"), t), t=link) == full
    assert one(spark, I.resolved(F.lit("http://h"), t), t="x") == "http://h/x"
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    assert [one(spark, I.valid_image(w, h), w=a, h=b) for a, b in (("200", "100"), ("99", "100"), ("400", "100"))] == [True, False, False]
    assert one(spark, I.fetchable(F.lit("image/png"), w), w="5000") and not one(spark, I.fetchable(F.lit("text/html"), w), w="5000")


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), ("a" * 300 + "b", "b" + "a" * 300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("*", P.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_density_groups(spark):
    dice = random.Random(5)
    base = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(60, 140):
        rows.append((i, [x + dice.gauss(0, 0.1) for x in rows[dice.randrange(i)][1]]))
    rows += [(140, base[3]), (141, [0.0] * 8), (142, None), (143, [1.0])]
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v and len(v) == 8 and any(v)}
    near = {(a, b) for a in unit for b in unit if a != b and sum((x - y) ** 2 for x, y in zip(unit[a], unit[b])) <= 0.09}
    root = {i: i for i in unit}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    want = {i: root[i] if i in unit and sum(r == root[i] for r in root.values()) > 1 else -1 for i, _ in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.group for r in D.density_groups(frame, 0.3, 8).collect()} == want
    assert D.density_groups(frame.limit(0), 0.3, 8).count() == 0


def test_close_pairs_in_blocks(spark):
    """All pairs, however the vectors fall into blocks, and their groups; no pair of places is joined to itself."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16))
    v[200:] = v[:200] + rng.normal(size=(200, 16)) * 0.06
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(400, v[7].tolist())]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(2 - 2 * unit @ unit.T <= 0.09, 1)))} | {(7, 400)}
    assert 100 < len(want) < 400
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (D.BLOCK, 50):
        assert [tuple(r) for r in D.close_pairs(frame, 0.3, 16, block=block).orderBy("a", "b").collect()] == sorted(want)
        groups = lambda pairs: {(r.id, r.root) for r in D.linked(pairs).collect()}
        assert groups(D.close_pairs(frame, 0.3, 16, block=block, forest=True)) == groups(spark.createDataFrame(sorted(want), "a long, b long"))


def test_sections_and_numbered(spark):
    docs = spark.createDataFrame([(1, "lead\nmore\n# A\nx\n## B\ny"), (2, None), (3, "")], "id long, t string")
    got = [tuple(r) for r in M.sections(docs, "id", "t").where("id = 1").orderBy("place").collect()]
    assert got == [(1, 0, "", "lead\nmore"), (1, 1, "A", "x"), (1, 2, "B", "y")]


def test_feed_entries(spark):
    rss = """<rss><channel><title>c</title><item><title><![CDATA[A & b]]></title><link>http://x/1</link><pubDate>Tue, 03 Jun 2025 10:00:00 +0000</pubDate><category>ai</category><description>d &amp;lt; e</description></item>
<item><title>no link</title></item><item><title>old</title><link>http://x/2</link><pubDate>Sun, 01 Jun 2025 10:00:00 +0000</pubDate></item></channel></rss>"""
    atom = """<feed><entry><title>T</title><link rel="alternate" href="http://y/1"/><author><name>N</name></author><updated>2025-06-03T11:00:00Z</updated><category term="ml"/></entry></feed>"""
    df = spark.createDataFrame([("r", rss), ("a", atom), ("n", None), ("b", "<item>")], "source string, xml string")
    got = {r.source: r for r in feeds.entries(df, "source", "xml", F.expr("timestamp'2025-06-03 12:00:00'"), 24, 3).collect()}
    assert set(got) == {"r", "a"}
    assert (got["r"].title, got["r"].url, got["r"].content, got["r"].tags) == ("A & b", "http://x/1", "d &lt; e", ["ai"])
    assert (got["a"].title, got["a"].url, got["a"].author, got["a"].tags, got["a"].published.hour) == ("T", "http://y/1", "N", ["ml"], 11)
