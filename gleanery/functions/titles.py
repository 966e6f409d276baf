"""Column functions on titles, bullets and replies; all stay in the JVM. Lists of terms and patterns are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import fold

# Beginnings and ends that titles are compared without.
TITLE_PREFIXES = [r"(?i)^breaking[:\s]*", r"(?i)^exclusive[:\s]*", r"(?i)^report[:\s]*"]
TITLE_SUFFIXES = [r"(?i)\s*\[update\]$", r"(?i)\s*\(updated?\)$", r"(?i)\s*- report$"]
# Companies and products whose names are looked for.
COMPANIES = ["OpenAI|ChatGPT|GPT-\\d+", "Google|Alphabet|DeepMind|Gemini", "Meta|Facebook|Instagram", "Microsoft|Azure|Copilot", "Apple|iPhone|iPad|macOS", "Amazon|AWS|Alexa", "NVIDIA|Tesla|SpaceX", "Anthropic|Claude", "IBM|Watson", "Samsung|LG|Sony"]
PRODUCTS = ["GPT-\\d+(?:\\.\\d+)?|ChatGPT|GPT", "Claude(?:-\\d+)?", "Gemini(?:\\s+\\d+\\.\\d+)?", "LLaMA|Llama", "DALL-E|DALL·E", "Midjourney|Stable Diffusion", "TensorFlow|PyTorch", "Transformer|BERT|T5"]
METRICS = ["\\d+%", "\\d+倍", "\\$\\d+(?:\\.\\d+)?(?:[MKB]illion)?", "v?\\d+\\.\\d+", "\\d+(?:GB|TB|PB)"]
# Titles that say nothing, and what a title may not end on.
GENERIC_TITLES = [r"^LLM（大規模言語モデル）$", r"^技術進展$", r"^AI技術$", r"^新技術$"]
PARTICLES = ["は", "が", "を", "に", "で", "と", "から", "まで", "より", "への"]
REPORT_ENDINGS = ["と発表しました", "と報告しました", "と述べました", "と語りました"]
ACTION_VERBS = ["発表", "開始", "実装", "展開", "公開", "導入", "拡大", "改善", "向上", "開発"]


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds any of the terms."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def ends_with(text: Column, ends: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, ends)), lambda t: F.endswith(text, t))


def comparable(title: Column, prefixes: Sequence[str] = TITLE_PREFIXES, suffixes: Sequence[str] = TITLE_SUFFIXES) -> Column:
    """A title for comparisons: lower case, without such beginnings and ends, single blanks."""
    return F.trim(fold(F.lower(title), [*((p, "") for p in (*prefixes, *suffixes)), (r"\s+", " ")]))


def said_once(title: Column, terms: Sequence[str], links: Sequence[str]) -> Column:
    """A title in which none of the terms follows itself, joined by one of the links or by blanks."""
    named, link = "|".join(terms), "|".join(links)
    return F.trim(fold(title, [(rf"({named})(?:(?:{link})|\s+)\1", "$1"), (r"\s+", " ")]))


def mentions(text: Column, patterns: Sequence[str], n: int | None = None, longer: int = 0) -> Column:
    """All matches of the patterns, pattern by pattern, each once and without the blanks around it; only those of over `longer` characters, the first n."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), 1), lambda m: F.trim(m)) for p in patterns]))
    kept = F.array_distinct(F.filter(found, lambda m: F.length(m) > longer))
    return F.slice(kept, 1, n) if n else kept


def clause(text: Column, cues: Sequence[Sequence[str]], low: int = 15, high: int = 100, mark: str = "。") -> Column:
    """The first sentence that holds a cue and is longer than low and shorter than high; groups of cues are tried in order. Empty where there is none."""
    parts = F.split(text, f"[{mark}]")
    tries = []
    for group in cues:
        holds = partial(any_of, terms=group)
        first = F.trim(F.get(F.filter(parts, lambda s: holds(s)), F.lit(0)))  # noqa: B023  called at once
        tries.append(F.when((F.length(first) > low) & (F.length(first) < high), first))
    return F.coalesce(*tries, F.lit(""))


def bullets(points: Column, shortest: int = 10, openers: Sequence[str] = ("また、", "さらに、", "なお、", "一方、"), ends: Sequence[str] = ("。", "！", "？")) -> Column:
    """Points without bullet signs and opening conjunctions, closed by a mark; short and null ones left out."""
    kept = F.filter(F.transform(points, lambda p: F.trim(p)), lambda p: p.isNotNull() & (F.length(p) >= shortest))
    plain = F.transform(kept, lambda p: fold(p, [(r"^[-*•・]\s*", ""), (f"^(?:{'|'.join(openers)})", "")]))
    return F.transform(plain, lambda p: F.when(ends_with(p, ends), p).otherwise(F.concat(p, F.lit(ends[0]))))


def heading(text: Column) -> Column:
    """A heading without marks of emphasis and links, web addresses and closing punctuation; single blanks."""
    return F.trim(fold(F.coalesce(text, F.lit("")), [(r"[#*_`\[\]]", ""), (r"https?://\S+", ""), (r"\s+", " "), (r"^ | $", ""), (r"[.,:;!?]+$", "")]))


def cut_at(text: Column, limit: int, marks: str = ".!?。！？", softer: str = ",;、，") -> Column:
    """At most `limit` characters: up to the last mark within them, or else the last softer one in their latter half, or else the last blank there, or else all but
    one of them, with an ellipsis."""
    short = F.substring(text, 1, limit)
    end = F.regexp_extract(short, rf"(?s)^(.*[{marks}])", 1)
    room = F.substring(text, 1, limit - 1)
    soft = F.regexp_extract(room, rf"(?s)^(.{{{limit // 2},}})[{softer}]", 1)
    blank = F.regexp_extract(room, rf"(?s)^(.{{{limit // 2},}})\s", 1)
    dots = F.lit("…")
    return F.when(F.length(text) <= limit, text).when(end != "", end).when(soft != "", F.concat(soft, dots)).when(blank != "", F.concat(blank, dots)).otherwise(F.concat(room, dots))


def headline(point: Column, update: Column, limit: int = 50, follow_up: str = r"【?続報】?\s*[:：]?\s*", sign: str = "🆙") -> Column:
    """A title from a point: no follow-up marker, the entity it names set before it where the cut would lose it, the sign once if it is an update."""
    plain = F.trim(F.regexp_replace(point, follow_up, ""))
    entity = F.coalesce(F.nullif(F.regexp_extract(plain, "「([^」]+)」", 1), F.lit("")), F.regexp_extract(plain, r"\b([A-Z][a-zA-Z0-9]+)\b", 1))
    short = cut_at(plain, limit)
    base = F.when((entity != "") & ~F.contains(short, entity), F.concat(entity, F.lit("、"), short)).otherwise(short)
    return F.when(update & ~F.contains(base, F.lit(sign)), F.concat(base, F.lit(sign))).otherwise(base)


def title_quality(title: Column, generic: Sequence[str] = GENERIC_TITLES) -> Column:
    """score (100 less 30 for each way of repeating a word, 40 for saying nothing, 25 for dots at the end, 15 for under 15 characters, 10 for over two emoji), level, acceptable."""
    lost = [
        (title.rlike(r"(?U)(\w+)\s+\1\b"), 30),
        (title.rlike(r"(LLM|AI|GPT)の技術.*?\1"), 30),
        (title.rlike(r"(?U)(\w+)技術\s*\1"), 30),
        (F.lit(False) if not generic else title.rlike("|".join(generic)), 40),
        (F.endswith(title, F.lit("...")), 25),
        (F.length(title) < 15, 15),
        (F.regexp_count(title, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27FF}]")) > 2, 10),
    ]
    score = F.greatest(F.lit(100) - sum((F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n in lost), F.lit(0)), F.lit(0))
    level = F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")
    return F.struct(score.alias("score"), level.alias("level"), (score >= 60).alias("acceptable"))


def title_accepted(title: Column, names: Sequence[str], numbers: str, verbs: Sequence[str] = ACTION_VERBS, refused: Sequence[str] = (), ends: Sequence[str] = (*PARTICLES, *REPORT_ENDINGS)) -> Column:
    """score (3 for a name, 2 for a number, 1 for a verb) and accepted: 10 to 60 characters, a name, a score of 2 or more, no refused pattern, no such end."""
    named = any_of(title, names)
    score = sum((F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n in ((named, 3), (title.rlike(numbers), 2), (any_of(title, verbs), 1))), F.lit(0))
    bad = ends_with(title, ends)
    for p in refused:
        bad = bad | title.rlike(p)
    return F.struct(score.alias("score"), (F.length(title).between(10, 60) & named & (score >= 2) & ~bad).alias("accepted"))


def within_budget(paragraphs: Column, limit: int) -> Column:
    """The paragraphs from the first on whose lengths add up to no more than the limit."""
    none = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(s: Column, p: Column) -> Column:
        fits = s["open"] & (s["used"] + F.length(p) <= limit)
        return F.struct(F.when(fits, s["used"] + F.length(p)).otherwise(s["used"]).alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.slice(paragraphs, F.lit(1), F.aggregate(paragraphs, none, add, lambda s: s["n"]))


def reply_text(reply: Column, skipped: Sequence[str], prefixes: Sequence[str], tails: Sequence[str], lines: int = 3) -> Column:
    """The longest of the first lines of a reply that is no remark about the reply itself, without announcing words, quotes and stock endings."""
    kept = F.filter(F.transform(F.split(reply, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.exists(F.array(*map(F.lit, skipped)), lambda p: F.startswith(F.lower(s), p)))
    best = F.get(F.array_sort(F.slice(kept, 1, lines), lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    return F.trim(fold(F.coalesce(best, F.lit("")), [*((p, "") for p in prefixes), (r"""^["'「『]+|["'」』]+$""", ""), *((t, "") for t in tails)]))


def summary_points(reply: Column) -> Column:
    """Points of a reply: those of its JSON, whole or between braces; else its bullets; else its sentences of 30 to 300 characters."""
    of = "summary_points array<string>"
    json = F.coalesce(F.from_json(reply, of)["summary_points"], F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), of)["summary_points"])
    listed = F.transform(F.regexp_extract_all(reply, F.lit(r"(?md)^[ \t]*(?:[-*•・]|\d+[.)])[ \t]*(\S[^\n]*)$"), 1), lambda s: F.trim(s))
    said = F.filter(F.transform(F.split(reply, r"[.!?。！？\n]"), lambda s: F.trim(s)), lambda s: F.length(s).between(30, 300))
    return F.when(F.size(F.coalesce(json, F.array())) > 0, json).when(F.size(listed) > 0, listed).otherwise(said)


def repaired_points(points: Column, notice: str, low: int = 30, high: int = 300, least: int = 3, most: int = 4) -> Column:
    """least to most points: short ones lengthened by the notice, long ones cut with dots, the notice for missing ones."""
    fit = F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.when(F.length(p) < low, F.concat(p, F.lit(f" {notice}"))).when(F.length(p) > high, F.concat(F.substring(p, 1, high - 3), F.lit("..."))).otherwise(p))
    return F.slice(F.concat(fit, F.array_repeat(F.lit(notice), F.greatest(F.lit(least) - F.size(fit), F.lit(0)))), 1, most)


def contents_line(text: Column, limit: int = 80) -> Column:
    """A line of a table of contents: a heading, cut."""
    return cut_at(heading(text), limit)


def display_name(key: Column, known: Mapping[str, str]) -> Column:
    """A source's name: as listed, or its id in title case."""
    named = F.lit(None).cast("string")
    for k, v in known.items():
        named = F.when(key == k, F.lit(v)).otherwise(named)
    return F.coalesce(named, F.initcap(F.regexp_replace(key, "[_-]+", " ")))


def first_class(text: Column, table: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The class of the first entry of the table of which the text, in lower case, holds a term."""
    low, out = F.lower(text), F
    for terms, name in table:
        out = out.when(any_of(low, terms), name)
    return out.otherwise(default) if table else F.lit(default)


#: What to do after an error, by its text.
RECOVERY = [(["timeout"], "retry"), (["rate", "quota"], "circuit_breaker"), (["validation"], "fallback"), (["permission", "auth"], "fail_fast")]


def context_decision(similarity: Column) -> Column:
    """SKIP over 0.998, UPDATE over 0.92, else KEEP; KEEP where there is no neighbour."""
    return F.when(similarity > 0.998, "SKIP").when(similarity > 0.92, "UPDATE").otherwise("KEEP")


def cost(model: Column, prompt: Column, reply: Column, rates: Mapping[str, float]) -> Column:
    """Estimated price: four characters a token, at the model's rate for 1000 tokens, four decimals; 0 for unknown models and empty texts."""
    rate = F.lit(0.0)
    for name, r in rates.items():
        rate = F.when(model == name, F.lit(r)).otherwise(rate)
    tokens = F.greatest(F.floor(F.length(prompt) / 4), F.lit(1)) + F.greatest(F.floor(F.length(reply) / 4), F.lit(1))
    empty = (F.coalesce(F.length(prompt), F.lit(0)) == 0) | (F.coalesce(F.length(reply), F.lit(0)) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.round(tokens / 1000 * rate, 4))


def run_date(run: Column, today: Column) -> Column:
    """The date that a run's id begins with, or today."""
    return F.coalesce(F.try_to_date(F.regexp_extract(run, r"^(\d{4}-\d{2}-\d{2})(?:_|$)", 1)), today)
