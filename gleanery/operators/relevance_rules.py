"""Relevance of articles by fixed word lists, hosts and channels; gates before publication.

Null titles, texts, addresses and sources count as empty. An empty table gives an empty result. Scores depend on a row alone, so repeated rows have
equal ones. Columns that are added replace columns of the same name; all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed as X
from gleanery.functions import text as T

POINTS = {"high": 3.0, "medium": 1.5, "low": 0.5, "negative": -1.0}
TIERS = {"high": X.HIGH, "medium": X.MEDIUM, "low": X.LOW, "negative": X.NEGATIVE}


def any_word(words: Sequence[str]) -> str:
    """A pattern of whole words, longest first, whatever their case."""
    return r"(?iU)\b(?:" + "|".join(re.escape(w) for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))) + r")\b"


def empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def hits(text: Column, words: Sequence[str]) -> Column:
    """The different words of a list that a text holds as whole words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(any_word(words)), 0))


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains any of some strings."""
    met = F.lit(False)
    for w in words:
        met = met | F.contains(text, F.lit(w))
    return met


def host_bonus(url: Column, source: Column) -> Column:
    """What a source's standing adds: by the address's host, else by the source's name; the first that is met counts."""
    host, name = T.url_host(empty(url)), F.lower(empty(source))
    return (
        F.when(holds(host, X.OFFICIAL_HOSTS), 0.3)
        .when(holds(host, X.REPUTABLE_HOSTS), 0.15)
        .when(holds(host, X.ACADEMIC_MARKS), 0.2)
        .when(holds(host, X.QUALITY_HOSTS), 0.1)
        .when(name.isin(*X.OFFICIAL_SOURCES), 0.25)
        .when(name.isin(*X.CURATED_SOURCES), 0.1)
        .otherwise(F.lit(0.0))
    )


def relevance(df: DataFrame, title: str = "title", content: str = "content", url: str = "url", source: str = "source_id", kind: str = "source_type", lexicon: dict[str, Sequence[str]] | None = None, blacklist: Sequence[str] = X.BLACKLIST) -> DataFrame:
    """Adds n_high, n_medium, n_low, n_negative, score (0 to 1) and reason.

    score: points for the different words of each tier, of the channel and of the host, for each hundred words. A word of the blacklist, and a
    short video, give 0; a video with phrases that speak against it and no high word gives 0.15.
    """
    tiers = TIERS | (lexicon or {})
    text = F.lower(F.concat_ws(" ", empty(title), empty(content)))
    found = {t: F.size(hits(text, w)) for t, w in tiers.items()}
    rows = df.select(*[c for c in df.columns if c not in {f"n_{t}" for t in tiers}], *(n.cast("long").alias(f"n_{t}") for t, n in found.items()))
    n = {t: F.col(f"n_{t}") for t in tiers}
    channel, video = F.lower(empty(source)), F.coalesce(F.col(kind) == "youtube", F.lit(False))
    short = holds(F.lower(empty(url)), ("shorts/", "/shorts")) | holds(F.lower(empty(title)), ("#shorts", "[shorts]"))
    business = F.when(n["high"] > 0, 0.25).when(n["medium"] > 0, 0.15).otherwise(F.lit(-0.2))
    of_channel = F.when(holds(channel, X.SPECIALIST_CHANNELS), 0.6).when(holds(channel, X.ADJACENT_CHANNELS), 0.35).when(holds(channel, X.BUSINESS_CHANNELS), business).otherwise(F.lit(0.0))
    against = sum((F.contains(text, F.lit(w)).cast("int") for w in X.VIDEO_NEGATIVE), F.lit(0))
    of_video = F.when(video, of_channel - F.when(against > 2, 0.2).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    raw = sum((n[t] * w for t, w in POINTS.items()), F.lit(0.0)) + of_video + host_bonus(F.col(url), F.col(source))
    words = T.word_count(text)
    score = F.when(words > 0, T.clip(raw / F.greatest(words / F.lit(100.0), F.lit(1e-9)))).otherwise(F.lit(0.0))
    score = F.when(holds(text, [w.lower() for w in blacklist]), 0.0).when(video & short, 0.0).when(video & (against > 0) & (n["high"] == 0), 0.15).otherwise(score)
    rows = rows.withColumn("score", score)
    s = F.col("score")
    reason = (
        F.when(s >= 0.8, F.format_string("High AI relevance: %d high-priority keywords", n["high"]))
        .when(s >= 0.6, F.format_string("Good AI relevance: %d high + %d medium keywords", n["high"], n["medium"]))
        .when(s >= 0.4, F.lit("Moderate AI relevance: Mix of AI-related terms"))
        .when(s >= 0.2, F.lit("Low AI relevance: Few AI keywords, mostly general tech"))
        .when(n["negative"] > 0, F.format_string("Non-AI content: %d negative keywords detected", n["negative"]))
        .otherwise(F.lit("Non-AI content: No significant AI keywords found"))
    )
    return rows.withColumn("reason", reason)


def lexicon_sizes(tiers: dict[str, Sequence[str]] | None = None) -> dict[str, int]:
    """How many different words each tier has, and all together."""
    sizes = {t: len(set(w)) for t, w in (tiers or TIERS).items()}
    return sizes | {"total": sum(sizes.values())}


def weighted_relevance(title: Column, content: Column, weights: dict[str, float] | None = None, excluding: Sequence[str] = X.EXCLUDING) -> Column:
    """A third of the sum of the weights of the keywords contained, 1 at most; 0.05 where an excluding phrase, 0.03 where an excluding pattern is met."""
    text = F.lower(F.concat_ws(" ", empty(title), empty(content)))
    total = sum((F.when(F.contains(text, F.lit(w)), F.lit(float(x))).otherwise(F.lit(0.0)) for w, x in (weights or X.WEIGHTED).items()), F.lit(0.0))
    pattern = F.lit(False)
    for p in X.EXCLUDING_PATTERNS:
        pattern = pattern | text.rlike(p)
    return F.when(holds(text, excluding), 0.05).when(pattern, 0.03).otherwise(F.least(total / 3.0, F.lit(1.0)))


def keeps_subject(title: Column, content: Column, points: Column, source: Column, broad: Sequence[str] = X.BROAD_SOURCES, strictest: str = X.STRICTEST_SOURCE, words: Sequence[str] = X.STRICT_WORDS) -> Column:
    """Whether an article of a broad source keeps to the subject: two of the strict words or more (three for the strictest source), and no world news.
    Articles of other sources do."""
    points = F.coalesce(points, F.array().cast("array<string>"))
    text = F.lower(F.concat_ws(" ", empty(title), F.substring(empty(content), 1, 500), F.array_join(points, " ")))
    n = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    world = F.lit(False)
    for p in X.WORLD_NEWS:
        world = world | text.rlike(p)
    return F.when(empty(source).isin(*broad), (n >= F.when(source == strictest, 3).otherwise(2)) & ~world).otherwise(F.lit(True))


def relaxed(df: DataFrame, threshold: float, wanted: int = 10, floor: float = 0.15, score: str = "score") -> DataFrame:
    """Rows over the threshold; while fewer than `wanted` are and the next is at least `floor`, over 0.9 of it, three times at most; then, if that gives
    more, over 0.7 of the last, 0.1 at least. All are counted in one pass. Adds threshold."""
    steps = [threshold]
    while len(steps) < 4 and steps[-1] * 0.9 >= floor:
        steps.append(steps[-1] * 0.9)
    last = max(0.1, steps[-1] * 0.7)
    counts = df.agg(*(F.count_if(F.col(score) >= t).alias(f"n{i}") for i, t in enumerate([*steps, last])))
    pick = F.coalesce(*(F.when(F.col(f"n{i}") >= wanted, F.lit(t)) for i, t in enumerate(steps)), F.when(F.col(f"n{len(steps)}") > F.col(f"n{len(steps) - 1}"), F.lit(last)), F.lit(steps[-1]))
    return df.drop("threshold").crossJoin(F.broadcast(counts.select(pick.alias("threshold")))).where(F.col(score) >= F.col("threshold"))


def compliance(df: DataFrame, group: str, low: int, high: int, sources: str = "source_id") -> DataFrame:
    """Of each document: n, sources, and whether it has enough articles, not too many, and both."""
    n = F.col("n")
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(sources).alias("sources"))
    return out.withColumns({"enough": n >= low, "not_too_many": n <= high, "complies": n.between(low, high)})


def overall_quality(content: Column, structure: Column, style: Column) -> Column:
    return content * 0.4 + structure * 0.3 + style * 0.3


def ready(valid: Column, quality: Column, violations: Column) -> Column:
    """Whether an article may go into a document: valid, of a quality of 0.7 or more, without any violation."""
    return valid & (quality >= 0.7) & (violations == 0)


def publishable(level: Column, quality: Column, errors: Column) -> Column:
    return level.isin("excellent", "good") & (quality >= 0.75) & (errors == 0)


def gate(df: DataFrame, group: str, is_ready: Column) -> DataFrame:
    """Of each document: n, how many are ready, and whether all are."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(is_ready).alias("ready"), F.bool_and(is_ready).alias("passes"))


def script_ratio(text: Column) -> Column:
    """Shares of Chinese and Japanese, Latin and other characters among letters, digits and those scripts; 0 without any."""
    cjk = F.regexp_count(text, F.lit(r"[぀-ゟ゠-ヿ一-龯]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    every = F.regexp_count(text, F.lit(r"[\p{L}\p{N}ー]"))
    share = lambda x: F.when(every > 0, x / every).otherwise(F.lit(0.0))
    return F.struct(share(cjk).alias("cjk"), share(latin).alias("latin"), share(F.greatest(every - cjk - latin, F.lit(0))).alias("other"))


def needs_translation(title: Column) -> Column:
    """Whether less than half of a title is Chinese or Japanese, or it has no letters at all."""
    return script_ratio(empty(title))["cjk"] < 0.5
