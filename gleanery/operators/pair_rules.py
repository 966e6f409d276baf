"""Pairs of articles: clashes by fixed tables, alignment, relevance of one to the other, duplicates, citations.

Functions of columns judge pairs that a join has found; null texts count as empty. Joins take few candidates and never pair all rows. Ties go to the
smaller key. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import fixed as X
from gleanery.functions import text as T
from gleanery.functions.titles import any_of
from gleanery.operators.compatible import clash, overall_likeness, ratio_over
from gleanery.operators.relevance_rules import empty, holds
from gleanery.operators.similarity import class_pairs, gathered, near_pairs, token_classes


def incompatible(a: Column, b: Column) -> Column:
    """Whether two titles must not cite each other: by fields, by words, by phrases, whichever way round."""
    pairs = [((x,), (y,)) for x, y in (*X.CLASHING_WORDS, *X.CLASHING_PHRASES)]
    return clash(empty(a), empty(b), (*X.CLASHING_FIELDS, *pairs))


def strictly_incompatible(a: Column, b: Column) -> Column:
    return clash(empty(a), empty(b), X.STRICT_CLASHES)


def subjects_clash(a: Column, b: Column) -> Column:
    return clash(empty(a), empty(b), X.SUBJECT_CLASHES)


def _aligned(a: Column, b: Column, groups: Sequence[Sequence[str]], one_sided: float) -> Column:
    total = F.lit(0.0)
    for words in groups:
        x, y = holds(a, words), holds(b, words)
        total = total + F.when(x & y, 1.0).when(x | y, one_sided).otherwise(F.lit(0.0))
    return total / len(groups)


def subject_alignment(a: Column, b: Column) -> Column:
    """1 for each of the subjects of both lower-case texts, 0.3 for those of one, over their number."""
    return _aligned(a, b, X.SUBJECTS, 0.3)


def entity_alignment(a: Column, b: Column) -> Column:
    """1 for each entity of both lower-case texts, 0.2 for those of one, over their number."""
    return _aligned(a, b, [(e,) for e in X.ENTITIES], 0.2)


def lexical_similarity(a: Column, b: Column) -> Column:
    """Shared words of the first 500 characters, and 0.1 for each important keyword in both, 1 at most; 0 where either has no words."""
    x, y = F.lower(F.substring(empty(a), 1, 500)), F.lower(F.substring(empty(b), 1, 500))
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    bonus = sum((F.when(F.contains(x, F.lit(k)) & F.contains(y, F.lit(k)), 0.1).otherwise(F.lit(0.0)) for k in X.IMPORTANT), F.lit(0.0))
    return F.when((F.size(words(x)) == 0) | (F.size(words(y)) == 0), F.lit(0.0)).otherwise(F.least(T.jaccard(words(x), words(y)) + bonus, F.lit(1.0)))


def title_penalty(a: Column, b: Column) -> Column:
    """What two titles of nearly the same words lose."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(empty(t)), r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    shared = T.jaccard(words(a), words(b))
    return F.when(shared > 0.8, -0.3).when(shared > 0.6, -0.1).otherwise(F.lit(0.0))


def strict_relevance(title_a: Column, text_a: Column, title_b: Column, text_b: Column, similarity: Column | None = None) -> Column:
    """0.4 similarity (of vectors, if given, else lexical), 0.3 subjects, 0.25 entities and 0.05 of the titles' penalty, between 0 and 1; 0 for
    strictly incompatible titles."""
    a, b = (F.lower(F.concat_ws(" ", empty(t), empty(c))) for t, c in ((title_a, text_a), (title_b, text_b)))
    near = lexical_similarity(a, b) if similarity is None else F.coalesce(similarity, lexical_similarity(a, b))
    total = 0.4 * near + 0.3 * subject_alignment(a, b) + 0.25 * entity_alignment(a, b) + 0.05 * title_penalty(title_a, title_b)
    return F.when(strictly_incompatible(title_a, title_b), F.lit(0.0)).otherwise(T.clip(total))


def terms(text: Column, listed: Sequence[str]) -> Column:
    """The terms of a list that a text contains, whatever their case, in the list's order."""
    low = F.lower(empty(text))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in listed)))


def _share(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1)))


def final_relevance(similarity: Column, a: Column, b: Column) -> Column:
    """Half the similarity, and a quarter each of the share of companies and of technical terms that two texts have in common, 1 at most."""
    companies, tech = (_share(terms(a, listed), terms(b, listed)) for listed in (X.NAMED_COMPANIES, X.TECH_TERMS))
    return F.least(similarity * 0.5 + companies * 0.25 + tech * 0.25, F.lit(1.0))


def cited_terms(text: Column) -> Column:
    """The first three subject terms of a text, or three of general kind."""
    found = F.slice(terms(text, X.CITED_TERMS), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, X.DEFAULT_TERMS)))


def comparison_words(title: Column, content: Column) -> Column:
    """The words by which articles are compared: of title and content."""
    return T.words(F.concat_ws(" ", F.trim(empty(title)), F.trim(empty(content))))


def candidate_pairs(rows: DataFrame, least: float, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """(a, b, similarity), a < b: articles of which at least a share of the words is common. Copies go with the first row of their words only."""
    members, own = token_classes(rows.select(F.col(key).alias("id"), comparison_words(F.col(title), F.col(content)).alias("tokens")))
    copies = members.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    near = class_pairs(own, least).select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")
    return near.unionByName(copies)


def duplicates(rows: DataFrame, least: float = 0.65, candidates: float = 0.4, key: str = "id", title: str = "title", content: str = "content", url: str = "url") -> DataFrame:
    """(id, duplicate_of, score): each row that is a duplicate of a row of smaller key, with the likeliest such.

    A pair's basic likeness is the larger of the share of common words and of the sequence ratio of the compared words; where a weighted likeness of
    titles, contents, excerpts and hosts is more than 0.15 away, that counts. Candidates share `candidates` of their words or more; only
    for these are sequences compared, where texts meet (gathered), and no further than until a pair can't be the likeliest. A row that is a copy of an
    earlier one is held against that one alone.
    """
    members, own = token_classes(rows.select(F.col(key).alias("id"), comparison_words(F.col(title), F.col(content)).alias("tokens")))
    copies = members.where("id != rep").select(F.col("rep").cast("long").alias("x"), F.col("id").cast("long").alias("y"))
    host = T.url_host(F.col("u"))
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.lower(F.trim(empty(title))).alias("t"), F.array_join(comparison_words(F.col(title), F.col(content)), " ").alias("c"), F.substring(empty(content), 1, 500).alias("e"), F.col(url).alias("u"))
    met = gathered(near_pairs(own, candidates).unionByName(copies), texts.withColumn("u", F.when(any_of(host, X.REPUTABLE_HOSTS), host)))

    def share(p: set[str], q: set[str]) -> float:
        return len(p & q) / len(p | q) if p or q else 1.0

    def judged(held: dict[int, list[tuple]], pairs: list[tuple[int, int]]) -> Iterator[tuple]:
        best: dict[int, float] = {}
        alike = [(s, x, y, p, q) for x, y in pairs for p in held[x] for q in held[y] if (s := share(p[1], q[1])) >= candidates]
        for s, x, y, (ta, _, ca, ea, ua), (tb, _, cb, eb, ub) in sorted(alike, key=lambda r: r[:3], reverse=True):
            differ, most = ua is not None and ub is not None and ua != ub, max(least, best.get(y, 0.0))
            # Texts that are no more alike than this have a score under the best so far, whatever is left (titles, starts) has.
            under = lambda titles, starts: min(most, (most - 0.4 * titles - 0.2 * starts - 0.1 * differ) / 0.35) - 1e-9  # noqa: B023, E731
            basic = ratio_over(cb, ca, max(s, under(1.0, 1.0)))
            if basic <= under(1.0, 1.0):
                continue
            titles = ratio_over(tb, ta, share({*ta.split(" ")} - {""}, {*tb.split(" ")} - {""}))
            if basic <= under(titles, 1.0):
                continue
            starts = ratio_over(eb, ea, 0.0)
            if basic > under(titles, starts):
                more = min(0.4 * titles + 0.35 * basic + 0.2 * starts + 0.1 * differ, 1.0)
                away = abs(more - basic) - 0.15
                best[y] = max(best.get(y, 0.0), (min(more, basic) if abs(away) < 1e-9 else more if away > 0 else basic) - 1e-9)
                yield x, y, titles, basic, starts, differ

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, here, held, pairs = ["a", "b", "of_titles", "of_texts", "of_starts", "differ"], None, {}, []

        def out() -> Iterator[pa.RecordBatch]:
            if found := [*judged(held, pairs)]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

        for batch in batches:
            for place, x, y, *text in zip(*(c.to_pylist() for c in batch.columns)):
                if place != here:
                    yield from out()
                    here, held, pairs = place, {}, []
                if y is None:
                    held.setdefault(x, []).append((text[0], {*text[1].split(" ")} - {""}, *text[1:]))
                else:
                    pairs.append((x, y))
        yield from out()

    met = met.mapInArrow(judge, "a long, b long, of_titles double, of_texts double, of_starts double, differ boolean")
    met = met.withColumn("score", overall_likeness(F.col("of_titles"), F.col("of_texts"), F.col("of_starts"), F.col("of_texts"), F.col("differ"))).where(F.col("score") >= least)
    best = met.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("minus"))).alias("m"))
    return best.select(F.col("b").alias("id"), (-F.col("m.minus")).alias("duplicate_of"), F.col("m.score").alias("score"))


def representative_score(relevance: Column, confidence: Column, source: Column, content: Column, age_hours: Column) -> Column:
    """What decides which row of a group of duplicates stays: relevance, confidence, source, length and age."""
    boost = F.lit(0.0)
    for name, value in X.SOURCE_BOOSTS.items():
        boost = F.when(source == name, value).otherwise(boost)
    return relevance + F.coalesce(confidence, F.lit(0.0)) + boost + F.least(F.length(empty(content)) / 5000.0, F.lit(0.1)) + F.greatest(F.lit(0.0), 0.1 - age_hours / 240.0)


def topic_representative_score(relevance: Column, confidence: Column, source: Column, title: Column, points: Column) -> Column:
    """What decides which row stands for a topic: relevance, confidence, source; broad sources that hardly name the subject lose, long points gain."""
    points = F.coalesce(points, F.array().cast("array<string>"))
    text = F.lower(F.concat_ws(" ", empty(title), F.array_join(points, " ")))
    n = sum((F.contains(text, F.lit(w)).cast("int") for w in X.REPRESENTATIVE_WORDS), F.lit(0))
    size = F.aggregate(points, F.lit(0), lambda s, p: s + F.length(F.coalesce(p, F.lit(""))))
    return (
        relevance + F.coalesce(confidence, F.lit(0.0)) + F.when(empty(source).isin(*X.BOOSTED_SOURCES), 0.2).otherwise(F.lit(0.0))
        + F.when(empty(source).isin(*X.BROAD_SOURCES) & (n < 3), -0.5).otherwise(F.lit(0.0)) + F.when(size > 400, 0.1).otherwise(F.lit(0.0))
    )


def consolidated(rows: DataFrame, groups: DataFrame, score: Column, key: str = "id", group: str = "leader", source: str = "source_id", title: str = "title", points: str = "points", mark: str = "🆙") -> DataFrame:
    """One row of each group (key, group): the one of the highest score, ties to the smaller key. Where others are dropped for it, its last point names
    their sources in order of their keys, and its title is marked. Adds dropped, how many."""
    joined = rows.join(groups.select(key, F.col(group).alias("_g")), key).withColumn("_s", score)
    best = joined.groupBy("_g").agg(F.max(F.struct("_s", (-F.col(key)).alias("_m"))).alias("_b"), F.count("*").alias("_n"))
    flagged = joined.join(best, "_g").withColumn("_stays", -F.col(key) == F.col("_b._m"))
    # Only the sources' names are gathered, each with its first key.
    names = F.initcap(F.replace(F.col(source), F.lit("_"), F.lit(" ")))
    others = flagged.where("not _stays").groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), names.alias("n")))).alias("_o"))
    out = flagged.where("_stays").join(others, "_g", "left")
    told = F.concat(F.lit("[関連報道: "), F.array_join(F.transform("_o", lambda o: o["n"]), ", "), F.lit("]"))
    last = F.concat(F.slice(points, 1, F.size(points) - 1), F.array(F.concat_ws(" ", F.element_at(points, -1), told)))
    many = F.col("_o").isNotNull() & (F.size(points) > 0)
    out = out.withColumn(points, F.when(many, last).otherwise(F.col(points)))
    out = out.withColumn(title, F.when(many & ~F.startswith(F.col(title), F.lit(mark)), F.concat(F.lit(mark + " "), F.col(title))).otherwise(F.col(title)))
    return out.withColumn("dropped", F.col("_n") - 1).select(*rows.columns, "dropped")


def titles_related(a: Column, b: Column) -> Column:
    """Whether two titles share two words or more, one of them of over three characters; whatever their case."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(empty(t)), r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    shared = F.array_intersect(words(a), words(b))
    return (F.size(shared) >= 2) & F.exists(shared, lambda w: F.length(w) > 3)


def named_in(rows: DataFrame, documents: DataFrame, key: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """The rows whose title stands as a line in one of the rendered documents."""
    lines = documents.select(F.explode(F.split(F.col(text), "\n")).alias("_line")).select(F.trim(F.regexp_replace("_line", r"^#+\s*", "")).alias("_line")).distinct()
    return rows.join(lines, F.trim(F.col(title)) == F.col("_line"), "left_semi")


def source_name(source: Column, url: Column) -> Column:
    """A source's name for readers, with what its address tells of it."""
    name, host = F.initcap(F.replace(empty(source), F.lit("_"), F.lit(" "))), T.url_host(empty(url))
    return F.when(holds(host, X.OFFICIAL_HOSTS[:4]), F.concat(name, F.lit(" Official"))).when(F.contains(host, F.lit("youtube.com")), F.concat(name, F.lit(" (YouTube)"))).when(F.contains(host, F.lit("github.com")), F.concat(name, F.lit(" (GitHub)"))).otherwise(name)


def source_quality(source: Column) -> Column:
    value = F.lit(0.5)
    for name, q in X.SOURCE_QUALITY.items():
        value = F.when(source == name, q).otherwise(value)
    return value


def cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def citation(source: Column, url: Column, title: Column, summary: Column) -> Column:
    """A citation: name, url, title of 100 characters at most, summary of 100 at most."""
    return F.struct(source_name(source, url).alias("name"), url.alias("url"), cut(empty(title), 100).alias("title"), cut(empty(summary), 100).alias("summary"))


def citation_line(c: Column) -> Column:
    """A citation as a line of markdown."""
    return F.format_string("**%s** (%s): %s", c["name"], c["url"], c["title"])


def citations(rows: DataFrame, group: str, first: Column, k: int = 3, key: str = "id", url: str = "url", source: str = "source_id", title: str = "title", summary: str = "content") -> DataFrame:
    """group and its citations, k at most: the representative (of the highest `first`, ties to the smaller key), then other rows in key order, each with a
    source and an address that none before it has, and a title that doesn't clash with the representative's. Every group has one citation at least.
    """
    rows = rows.withColumn("_f", first).withColumn("_u", T.normalise_url(empty(url)))
    lead = rows.groupBy(group).agg(F.max(F.struct("_f", (-F.col(key)).alias("_m"), F.col(title).alias("_t"), F.col(source).alias("_src"), F.col("_u").alias("_lu"))).alias("_lead"))
    met = rows.join(lead, group).withColumn("_is", -F.col(key) == F.col("_lead._m"))
    fit = met.where(F.col("_is") | ((F.col(source) != F.col("_lead._src")) & (F.col("_u") != F.col("_lead._lu")) & ~incompatible(F.col("_lead._t"), F.col(title))))
    order = [F.desc("_is"), F.asc(key)]
    one = fit.withColumn("_a", F.row_number().over(Window.partitionBy(group, source).orderBy(*order))).where("_a = 1")
    one = one.withColumn("_b", F.row_number().over(Window.partitionBy(group, "_u").orderBy(*order))).where("_b = 1")
    one = one.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k)
    made = F.struct("_r", citation(F.col(source), F.col(url), F.col(title), F.col(summary)).alias("c"))
    return one.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(made)), lambda x: x["c"]).alias("citations"))


def trimmed(df: DataFrame, most: int, relevance: str, confidence: str, citations: str = "citations", points: str = "points", key: str = "id") -> DataFrame:
    """The min(most, 10) best rows by 0.4 relevance, 0.4 confidence and 0.1 for each citation; ties: fewer points, smaller key."""
    score = F.col(relevance) * 0.4 + F.col(confidence) * 0.4 + F.size(citations) * 0.1
    return df.orderBy(F.desc(score), F.size(points), key).limit(min(most, 10))


def fallback_best(df: DataFrame, most: int, relevance: str, confidence: str, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(F.col(relevance) * 0.6 + F.col(confidence) * 0.4), key).limit(min(most, 10))


def impact(title: Column, points: Column, update: Column, confidence: Column) -> Column:
    """2 for each major entity, 1 for each term of impact, 1.5 for a figure, 0.5 for an update, and the confidence."""
    text = F.concat_ws(" ", empty(title), F.array_join(F.coalesce(points, F.array().cast("array<string>")), " "))
    score = sum((F.contains(text, F.lit(w)).cast("int") * 2.0 for w in X.MAJOR_ENTITIES), F.lit(0.0)) + sum((F.contains(text, F.lit(w)).cast("int") * 1.0 for w in X.IMPACT_TERMS), F.lit(0.0))
    return score + F.when(text.rlike(X.FIGURES), 1.5).otherwise(F.lit(0.0)) + F.when(F.coalesce(update, F.lit(False)), 0.5).otherwise(F.lit(0.0)) + F.coalesce(confidence, F.lit(0.0))


def update_relations(decisions: DataFrame, child: str = "id", references: str = "references", decision: str = "decision") -> DataFrame:
    """(parent, child, relation, score): the first three references of each row; update where that was decided, else sequel over 0.8, else related."""
    each = decisions.select(F.col(child).alias("child"), F.col(decision).alias("d"), F.explode(F.slice(references, 1, 3)).alias("r"))
    kind = F.when(F.col("d") == "UPDATE", "update").when(F.col("r.score") > 0.8, "sequel").otherwise("related")
    return each.select(F.col("r.id").alias("parent"), "child", kind.alias("relation"), F.col("r.score").alias("score"))


def cluster_edges(df: DataFrame, group: str, key: str = "id", score: float = 0.75, most: int = 1000) -> DataFrame:
    """(parent, child, relation, score): all pairs of different members of a group, parent < child; of a group of over `most` members its first member
    with each other instead, which connects the same rows. Noise (group -1) has none."""
    rows = df.where((F.col(group) != -1) & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("id")).distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    placed = rows.join(sizes, "g")
    a, b = placed.where(F.col("n") <= most).alias("a"), placed.where(F.col("n") <= most).alias("b")
    small = a.join(b, F.expr("a.g = b.g and a.id < b.id")).select(F.col("a.id").alias("parent"), F.col("b.id").alias("child"))
    large = placed.where((F.col("n") > most) & (F.col("id") != F.col("first"))).select(F.col("first").alias("parent"), F.col("id").alias("child"))
    return small.unionByName(large).withColumn("relation", F.lit("related")).withColumn("score", F.lit(score))


def update_decisions(now: DataFrame, near: DataFrame, same_event: float = 0.95, key: str = "id") -> DataFrame:
    """key, is_update, similarity, references (three at most, the nearest first) of all rows: near has (id, past_id, similarity). A row is an update if
    one of its three nearest is over same_event; without near rows it has no references."""
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "past_id"))).where("_r <= 3")
    refs = F.array_sort(F.collect_list(F.struct("_r", F.struct(F.col("past_id").alias("id"), F.col("similarity").alias("score")).alias("x"))))
    got = ranked.groupBy("id").agg(F.max("similarity").alias("similarity"), F.transform(refs, lambda r: r["x"]).alias("references"))
    out = now.select(F.col(key).alias("id")).join(got, "id", "left")
    none = F.array().cast("array<struct<id:bigint,score:double>>")
    return out.select(F.col("id").alias(key), F.coalesce(F.col("similarity") > same_event, F.lit(False)).alias("is_update"), "similarity", F.coalesce("references", none).alias("references"))


