"""Rules on an article's points: violations as a long table, scores, levels, repairs and metrics.

A table of articles has a key, `points` (array<string>) and, for some, `title`. Null points count as none, null strings in them as empty; an empty
table gives an empty result; rows of repeated key are judged one by one. Helper columns are not made: nothing can clash with other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed as X

WEIGHTS = {"error": 0.3, "warning": 0.1, "info": 0.05}
_U = "(?U)"
VIOLATION = "struct<rule_id:string,severity:string,bullet:int,position:int,detail:string>"


def clean_points(points: Column) -> Column:
    return F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))


def _found(rule: str, severity: str, bullet: Column | None = None, position: Column | None = None, detail: Column | None = None) -> Column:
    fields = [F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(None) if bullet is None else bullet).cast("int").alias("bullet"), (F.lit(None) if position is None else position).cast("int").alias("position"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")]
    return F.struct(*fields)


def _each(points: Column, rule: str, severity: str, broken, detail) -> Column:
    """A violation for each point that is broken(point), by its place from 0."""
    marked = F.transform(points, lambda p, i: F.when(broken(p), _found(rule, severity, i, None, detail(p))))
    return F.filter(marked, lambda v: v.isNotNull())


def _once(met: Column, rule: str, severity: str, detail: Column | None = None) -> Column:
    return F.filter(F.array(F.when(met, _found(rule, severity, None, None, detail))), lambda v: v.isNotNull())


def matches(text: Column, pattern: str, rule: str, severity: str) -> Column:
    """A violation for each match of a pattern, with the match and where it begins, from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    # What comes before the nth match is what the text's split by the pattern gives up to it.
    parts = F.split(text, pattern)
    before = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda n, s: n + F.length(s))
    return F.transform(found, lambda m, i: _found(rule, severity, None, before(i), m))


def _ends(p: Column, endings) -> Column:
    return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(p, e))


def _some(text: Column, words) -> Column:
    """How many of some words a text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def content_violations(points: Column) -> Column:
    """array<violation> of the eleven content rules, in their order."""
    points = clean_points(points)
    text = F.array_join(points, "\n")
    trimmed = F.transform(points, lambda p: F.trim(p))  # not F.trim itself, which would take the place for characters to trim
    size = F.size(points)
    polite, casual = _some(text, X.POLITE), _some(text, X.CASUAL)
    words = F.flatten(F.transform(points, lambda p: F.regexp_extract_all(p, F.lit(X.CONTENT_WORD), 0)))
    # In order, a word that occurs three times or more stands beside itself, two places on.
    in_order = F.array_sort(words)
    repeated = F.array_compact(F.array_distinct(F.zip_with(in_order, F.slice(in_order, 3, F.greatest(F.size(in_order), F.lit(1))), lambda a, b: F.when(a == b, a))))
    clauses = lambda p: 1 + F.length(p) - F.length(F.translate(p, X.CLAUSE_MARKS, ""))
    pairs = lambda table, severity, rule: F.filter(F.array(*[F.when(F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)), _found(rule, severity, None, None, F.lit(f"{a}|{b}"))) for a, b in table]), lambda v: v.isNotNull())
    return F.concat(
        matches(text, _U + X.POINTERS, "no_demonstrative_pronouns", "error"),
        _each(trimmed, "proper_sentence_ending", "warning", lambda p: ~_ends(p, X.ENDINGS), lambda p: F.right(p, F.lit(10))),
        _once((polite > 0) & (casual > 0) & (F.least(polite, casual) / F.greatest(polite, casual, F.lit(1)) > 0.3), "consistent_politeness", "info", F.concat_ws(",", polite, casual)),
        _once((size < 3) | (size > 4), "bullet_point_count", "error", size),
        _each(trimmed, "bullet_point_length", "warning", lambda p: (F.length(p) < 20) | (F.length(p) > 150), F.length),
        _each(points, "specific_information", "warning", lambda p: ~p.rlike(X.NUMBER) & ~p.rlike(X.PROPER_NOUN), lambda p: F.lit(None)),
        _each(points, "sentence_complexity", "info", lambda p: clauses(p) > 4, clauses),
        _once(F.size(repeated) > 0, "repetitive_expressions", "warning", F.array_join(repeated, ",")),
        pairs([(a, b) for a, others in X.VARIANTS.items() for b in others], "info", "foreign_term_usage"),
        pairs(X.FULL_FORMS.items(), "warning", "ai_terminology_consistency"),
        _once(text.rlike(r"\d{1,3}(?:,\d{3})+") & text.rlike(r"\b\d{4,}\b"), "number_format_consistency", "info"),
    )


def production_violations(points: Column, title: Column) -> Column:
    """array<violation> of the stricter rules before publication; rules on titles only where there is one."""
    points = clean_points(points)
    titled = F.coalesce(title, F.lit("")) != ""
    return F.concat(
        _each(points, "PROD_META_TEXT", "error", lambda p: F.exists(F.array(*map(F.lit, X.META_TEXT)), lambda r: F.regexp_like(p, r)), lambda p: F.substring(p, 1, 50)),
        _each(points, "PROD_INSUFFICIENT_DETAIL", "error", lambda p: F.length(p) < 50, F.length),
        _each(points, "PROD_VAGUE_CONTENT", "warning", lambda p: ~p.rlike(X.SPECIFIC), lambda p: F.lit(None)),
        _once(titled & (F.length(title) < 20), "PROD_TITLE_TOO_SHORT", "error", F.length(title)),
        _once(titled & ~title.rlike(X.TITLE_TERMS), "PROD_TITLE_VAGUE", "warning"),
        _once(F.size(points) < 3, "PROD_INSUFFICIENT_POINTS", "error", F.size(points)),
    )


def default_violations(points: Column) -> Column:
    """array<violation> of the declared default rules: length, pronouns, ending, number of points."""
    points = clean_points(points)
    return F.concat(
        _each(points, "summary_length", "error", lambda p: ~F.length(p).between(50, 200), F.length),
        _each(points, "forbidden_pronouns", "error", lambda p: F.exists(F.array(*map(F.lit, X.POINTING)), lambda w: F.contains(p, w)), lambda p: F.lit(None)),
        _each(points, "proper_ending", "warning", lambda p: ~p.rlike(X.SCHEMA_ENDING), lambda p: F.right(p, F.lit(10))),
        _once(F.size(points) < 3, "minimum_bullet_points", "error", F.size(points)),
        _once(F.size(points) > 4, "maximum_bullet_points", "error", F.size(points)),
    )


def violations(df: DataFrame, key: str, found: Column) -> DataFrame:
    """A row for each violation: key, rule_id, severity, bullet, position, detail."""
    return df.select(key, F.explode(found).alias("_one")).select(key, "_one.*")


def errors_in(found: Column, severity: str = "error") -> Column:
    return F.size(F.filter(found, lambda v: v["severity"] == severity))


def quality_score(found: Column) -> Column:
    """1 less the violations' weights, 0 at least."""
    weight = lambda v: F.when(v["severity"] == "error", WEIGHTS["error"]).when(v["severity"] == "warning", WEIGHTS["warning"]).otherwise(WEIGHTS["info"])
    return F.greatest(F.lit(0.0), 1 - F.aggregate(found, F.lit(0.0), lambda s, v: s + weight(v)))


def quality_level(score: Column, errors: Column) -> Column:
    return F.when(errors > 0, "failed").when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.6, "acceptable").otherwise("poor")


def judged(df: DataFrame, key: str, points: str = "points", title: str = "title") -> DataFrame:
    """key, score and level of the points; title_score and merged (mean of both scores; the points' alone without a title); production_score and
    production_level after the stricter rules."""
    p, t = F.col(points), F.col(title)
    rows = df.select(F.col(key), content_violations(p).alias("found"), content_violations(title_points(t)).alias("of_title"), production_violations(p, t).alias("strict"), (F.coalesce(t, F.lit("")) != "").alias("titled"))
    score, title_score = quality_score(F.col("found")), quality_score(F.col("of_title"))
    merged = F.when(F.col("titled"), (score + title_score) / 2).otherwise(score)
    errors, warnings = errors_in(F.col("strict")), errors_in(F.col("strict"), "warning")
    return rows.select(
        key,
        score.alias("score"),
        quality_level(score, errors_in(F.col("found"))).alias("level"),
        F.when(F.col("titled"), title_score).alias("title_score"),
        merged.alias("merged"),
        F.greatest(F.lit(0.0), merged - errors * 0.3 - warnings * 0.1).alias("production_score"),
        F.when(errors > 0, "poor").when(warnings > 2, "acceptable").otherwise("excellent").alias("production_level"),
    )


def bullets(text: Column) -> Column:
    """The points of a text: lines after a bullet, a number or a middle dot; other lines of over 20 characters as they are."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    mark = r"^(?:[-*•]\s*|\d+\.\s*|・)(.+)$"
    made = F.transform(lines, lambda s: F.when(s.rlike(mark), F.regexp_extract(s, mark, 1)).when(F.length(s) > 20, s))
    return F.filter(made, lambda s: s.isNotNull())


def title_points(title: Column) -> Column:
    """A title judged as a text of its own."""
    return bullets(title)


def metrics(points: Column) -> Column:
    """Counts on the points and their joined text."""
    points = clean_points(points)
    text = F.array_join(points, "\n")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    mean = F.when(F.size(points) > 0, F.aggregate(points, F.lit(0), lambda n, p: n + F.length(p)) / F.size(points)).otherwise(F.lit(0.0))
    return F.struct(
        F.length(text).alias("characters"), F.size(points).alias("bullets"), mean.alias("mean_bullet"), count("[。！？]").alias("sentences"),
        (F.length(text) - F.length(F.translate(text, "、", ""))).alias("commas"), count(r"\d+").alias("numbers"), count("[A-Z][a-zA-Z]+|[ァ-ヶー]{2,}").alias("proper_nouns"),
    )


def repaired_points(points: Column, filler: Column) -> Column:
    """Three to four points: short ones (under 30) get the filler after them, long ones (over 300) are cut to 297 and dots, missing ones are fillers."""
    cut = F.transform(clean_points(points), lambda p: F.when(F.length(p) < 30, F.concat_ws(" ", p, filler)).when(F.length(p) > 300, F.concat(F.substring(p, 1, 297), F.lit("..."))).otherwise(p))
    return F.slice(F.concat(cut, F.when(F.size(cut) < 3, F.array_repeat(filler, 3 - F.size(cut))).otherwise(F.array().cast("array<string>"))), 1, 4)


def summary_is_valid(points: Column) -> Column:
    """One to six points, each of 30 characters or more."""
    points = clean_points(points)
    return F.size(points).between(1, 6) & F.forall(points, lambda p: F.length(p) >= 30)


def points_are_sound(points: Column, low: int = 15, high: int = 300) -> Column:
    """Whether all points have a length within bounds and none points at something unnamed."""
    return F.forall(clean_points(points), lambda p: F.length(p).between(low, high) & ~F.exists(F.array(*map(F.lit, X.POINTING)), lambda w: F.contains(p, w)))


def finished_points(points: Column) -> Column:
    """Points that end as sentences do: those that don't get a closing word."""
    return F.transform(clean_points(points), lambda p: F.when(F.trim(p).rlike(X.SCHEMA_ENDING), p).otherwise(F.concat(F.trim(p), F.lit("です"))))


def fallback_summary(title: Column, content: Column, notice: str) -> Column:
    """Points made without a model: the title, the first 100 characters and a notice."""
    start = F.coalesce(content, F.lit(""))
    return F.array(F.coalesce(title, F.lit("")), F.concat(F.substring(start, 1, 100), F.when(F.length(start) > 100, F.lit("...")).otherwise(F.lit(""))), F.lit(notice))


def clipped(text: Column, limit: int = 10_000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
