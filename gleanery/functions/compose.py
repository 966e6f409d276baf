"""Texts composed without a model: summaries and titles from an article's own words, slugs, lines and documents of markdown. Null strings count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

# Terms met in titles and how they are named.
TITLE_TERMS = {
    "AI": "AI技術", "LLM": "大規模言語モデル", "GPT": "GPTモデル", "ChatGPT": "ChatGPT", "OpenAI": "OpenAI", "Google": "Google",
    "Microsoft": "Microsoft", "Meta": "Meta", "Anthropic": "Anthropic", "Claude": "Claude", "Gemini": "Gemini", "model": "モデル",
    "API": "API", "training": "学習", "dataset": "データセット", "performance": "性能", "benchmark": "ベンチマーク",
    "robotics": "ロボティクス", "automation": "自動化",
}
# Patterns of companies, figures, and of titles that say nothing.
COMPANY_PATTERN = r"([A-Z][a-z]+(?:[A-Z][a-z]+)*|OpenAI|Google|Microsoft|Meta|Apple|Amazon|Tesla)"
FIGURE_PATTERN = r"(\d+(?:\.\d+)?(?:億|万|千|百)?(?:ドル|円|%|件|人))"
NAMED_FIRMS, NAMED_MODELS = r"(?i)(OpenAI|Google|Meta|Microsoft|Apple|Amazon|NVIDIA|Anthropic)", r"(?i)(GPT|Claude|Gemini|ChatGPT|AI|LLM)"
GENERIC = (r"^AI関連ニュース$", r"^最新AI動向$", r"^技術ニュース$", r"^業界動向$", r"^最新情報$", r"^.*について$", r"^.*に関して$", r"^.*を発表🆙$", r"^.*の$", r".*を発表しながら")
# Broken sentences, said-twice phrases and proper endings of lead paragraphs.
BROKEN = (r"^[^。！？]*[がはをにで]。", r"[A-Za-z゠-ヿ぀-ゟ一-龯]+が。", r"[はがをに]$", r"[がはをにで]。\s*[^。！？]*$")
SAID_TWICE = r"(されています|しています).*?(と発表|と報告|と説明)"
LEAD_ENDINGS = ("です。", "ます。", "ました。", "ています。", "でした。", "ません。")
LEAD_FIRMS = ("OpenAI", "Google", "Meta", "Microsoft", "Anthropic", "Apple")
SLUG_TERMS = r"(AI|LLM|API|CLI|GPU|CPU|SDK|開発|技術|システム|ツール|プラットフォーム)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def title_summary(title: Column) -> Column:
    """A sentence on what a title tells: by its terms, else its company and figure, else its beginning."""
    t = _text(title)
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower(t), F.lit(k.lower())), F.lit(v)) for k, v in TITLE_TERMS.items())))
    company, figure = F.regexp_extract(t, COMPANY_PATTERN, 1), F.regexp_extract(t, FIGURE_PATTERN, 1)
    start = F.split_part(F.split_part(F.translate(t, "【】", ""), F.lit("、"), F.lit(1)), F.lit("："), F.lit(1))
    start = F.regexp_replace(F.regexp_replace(start, r"^(新|最新|初|初回)", ""), r"(を発表|を公開|をリリース)$", "")
    return (
        F.when(F.size(found) == 1, F.concat(F.get(found, F.lit(0)), F.lit("技術の新進展と実用化の動向")))
        .when(F.size(found) > 1, F.concat(F.get(found, F.lit(0)), F.lit("・"), F.get(found, F.lit(1)), F.lit("領域の最新技術進展")))
        .when((company != "") & (figure != ""), F.concat(company, F.lit("、"), figure, F.lit("の新たな成果を発表")))
        .when(company != "", F.concat(company, F.lit("の最新技術発表と今後の展望")))
        .when(figure != "", F.concat(figure, F.lit("の大型技術進展が発表")))
        .otherwise(F.concat(F.substring(start, 1, 40), F.lit("の技術的進展と影響")))
    )


def entity_summary(title: Column) -> Column:
    """One of four sentences, by the company and the model that a title names."""
    firm, model = F.regexp_extract(_text(title), NAMED_FIRMS, 1), F.regexp_extract(_text(title), NAMED_MODELS, 1)
    return (
        F.when((firm != "") & (model != ""), F.concat(firm, F.lit("が"), model, F.lit("の新技術を発表。業界への影響と将来性について詳細解説。")))
        .when(firm != "", F.concat(firm, F.lit("がAI技術分野で重要な発表。市場への影響と競争力強化を分析。")))
        .when(model != "", F.concat(model, F.lit("の最新アップデートが公開。機能向上とユーザー体験の改善を実現。")))
        .otherwise(F.lit("AI技術の重要な進展が発表。業界動向と将来への影響を詳細に解説。"))
    )


def last_place(text: Column, mark: str) -> Column:
    """The place of the last mark in a text, from 1; 0 without one."""
    back = F.instr(F.reverse(text), mark)
    return F.when(back > 0, F.length(text) - back + 1).otherwise(F.lit(0))


def point_summary(title: Column, points: Column) -> Column:
    """The first point without its bullet, of 200 characters at most: cut after the last full stop or comma of the first 190 if that leaves over 150,
    else with dots; without points what the title tells."""
    first = F.regexp_replace(F.trim(F.get(F.coalesce(points, F.array().cast("array<string>")), F.lit(0))), r"^[-•*]\s*", "")
    cut = F.substring(first, 1, 190)
    stop, comma = last_place(cut, "。"), last_place(cut, "、")
    short = F.when(stop > 151, F.left(cut, stop)).when(comma > 151, F.concat(F.left(cut, comma), F.lit("..."))).otherwise(F.concat(cut, F.lit("...")))
    return F.when(first.isNull(), title_summary(title)).when(F.length(first) <= 200, first).otherwise(short)


def short_summary(title: Column, points: Column) -> Column:
    """The first point, of 120 characters at most, else what the title tells."""
    first = F.get(F.coalesce(points, F.array().cast("array<string>")), F.lit(0))
    return F.when(first.isNull(), title_summary(title)).when(F.length(first) <= 120, first).otherwise(F.concat(F.substring(first, 1, 117), F.lit("...")))


def generic_title(title: Column) -> Column:
    """Whether a title says nothing of its own or is broken off."""
    return F.exists(F.array(*(F.lit("(?i)" + p) for p in GENERIC)), lambda p: F.regexp_like(_text(title), p))


def lead_paragraph_verdict(paragraph: Column) -> Column:
    """ok, or what is wrong with a lead paragraph: short, broken, twice, long, ending."""
    p = F.trim(_text(paragraph))
    return (
        F.when(F.length(p) < 10, "short")
        .when(F.exists(F.array(*map(F.lit, BROKEN)), lambda r: F.regexp_like(p, r)), "broken")
        .when(p.rlike(SAID_TWICE), "twice")
        .when(F.length(p) > 200, "long")
        .when(~F.exists(F.array(*map(F.lit, LEAD_ENDINGS)), lambda e: F.endswith(p, e)), "ending")
        .otherwise("ok")
    )


def said_points(reply: Column) -> Column:
    """Points of a free text, five at most: its bullets of over 15 characters and lines of over 30 with a full stop, but no headers; else its sentences of
    over 20; else its first 100 characters."""
    text = _text(reply)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.lower(s).rlike("要約|summary|以下|上記"))
    marked, bare = (lambda s: s.rlike(r"^(?:[-*•]|\d+\.)")), (lambda s: F.regexp_replace(F.regexp_replace(s, r"^[-*•]\s*", ""), r"^\d+\.\s*", ""))
    found = F.array_compact(F.transform(lines, lambda s: F.when(marked(s), F.when(F.length(bare(s)) > 15, bare(s))).when((F.length(s) > 30) & F.contains(s, F.lit("。")), s)))
    sentences = F.transform(F.filter(F.transform(F.split(text, r"[。.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 20), lambda s: F.concat(s, F.lit("。")))
    start = F.when(F.length(text) > 100, F.concat(F.lit("記事の要約："), F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
    return F.slice(F.when(F.size(found) > 0, found).when(F.size(sentences) > 0, sentences).otherwise(F.array(start)), 1, 5)


def search_slug(title: Column) -> Column:
    """Up to three key terms of a title (quoted ones, then technical ones), else its first four words, encoded for an address."""
    t = F.regexp_replace(F.regexp_replace(_text(title), r"^(【[^】]*】|\[.*?\]|\d+[.)]\s*)", ""), r"🆙|[☀-⛿✀-➿]", "")
    terms = F.concat(F.regexp_extract_all(t, F.lit("""[「『"'](.*?)[」』"']"""), 1), F.regexp_extract_all(t, F.lit(SLUG_TERMS), 1))
    words = F.slice(F.filter(F.split(t, r"\s+"), lambda w: w != ""), 1, 4)
    return F.url_encode(F.array_join(F.when(F.size(terms) > 0, F.slice(terms, 1, 3)).otherwise(words), " "))


def theme_title(first_title: Column, n: Column) -> Column:
    """A document's title by what its first article's title names, else by how many articles it has."""
    t = _text(first_title)
    return (
        F.when(t.rlike("OpenAI|Google|Meta|Microsoft|Anthropic"), "大手AI企業による技術発表・戦略転換")
        .when(t.rlike("ChatGPT|GPT|Gemini|Claude|LLM"), "主要AIモデルの機能強化・新展開")
        .when(t.rlike("研究|Research|論文"), "AI研究の最新成果・技術ブレイクスルー")
        .when(t.rlike("投資|資金|funding"), "AI業界の投資動向・企業動向")
        .when(n > 0, F.concat(F.lit("注目AI企業"), n.cast("string"), F.lit("社の重要発表")))
        .otherwise("AI技術の重要な進展")
    )


def safe_lead(titles: Column, n: Column) -> Column:
    """Three plain paragraphs: the first two firms that the first five titles name, how many articles there are, and an outlook."""
    five = F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, 5)

    def says(word: str) -> Column:
        return F.exists(five, lambda t: F.contains(_text(t), F.lit(word)))

    named = F.array_compact(F.array(*(F.when(says(w), F.lit(w)) for w in LEAD_FIRMS)))
    firms = F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 2), "、")).otherwise(F.lit("主要AI企業"))
    return F.array(
        F.concat(F.lit("AI分野において"), firms, F.lit("を含む複数の企業が新たな取り組みを発表しました。")),
        F.concat(F.lit("今回は"), n.cast("string"), F.lit("件のAI関連ニュースをお届けします。")),
        F.lit("これらの動向は今後のAI技術の発展に大きな影響を与えることが予想されます。"),
    )


def article_markdown(title: Column, points: Column, citation_lines: Column) -> Column:
    """An article as markdown: heading, points as bullets, citations as quotes."""
    lines = F.concat(F.array(F.concat(F.lit("### "), _text(title)), F.lit("")), F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.concat(F.lit("- "), p)), F.array(F.lit("")), F.transform(F.coalesce(citation_lines, F.array().cast("array<string>")), lambda c: F.concat(F.lit("> "), c)))
    return T.tidy(F.array_join(lines, "\n"))


def documents(df: DataFrame, group: str, order: str, title: str, markdown: str, n: int = 10) -> DataFrame:
    """group, n, text: a document of each group's first n articles: its title, lead, contents and articles, in order (ties by title)."""
    from pyspark.sql import Window

    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, title))).where(F.col("_r") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_r", F.col(title).alias("t"), F.col(markdown).alias("m"))))
    out = ranked.groupBy(group).agg(F.count("*").alias("n"), rows.alias("_rows"))
    titles = F.transform("_rows", lambda r: r["t"])
    contents = F.array_join(F.transform("_rows", lambda r: F.concat(r["_r"].cast("string"), F.lit(". "), r["t"])), "\n")
    body = F.array_join(F.transform("_rows", lambda r: r["m"]), "\n\n---\n\n")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), theme_title(F.get(titles, F.lit(0)), F.col("n"))), F.array_join(safe_lead(titles, F.col("n")), "\n"), F.lit("## 目次"), contents, body)
    return out.select(group, "n", text.alias("text"))
