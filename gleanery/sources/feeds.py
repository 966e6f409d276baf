"""Entries of landed RSS and Atom files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]


def _field(entry: Column, *tags: str) -> Column:
    """The first of the tags that isn't empty, without CDATA marks and with the five entities read."""
    tries = []
    for tag in tags:
        body = F.regexp_extract(entry, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        body = F.trim(F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            body = F.replace(body, F.lit(name), F.lit(sign))
        tries.append(F.nullif(body, F.lit("")))
    return F.coalesce(*tries)


def entries(df: DataFrame, source: str, xml: str, now: Column, hours: int, k: int) -> DataFrame:
    """source, place, title, url, author, content, published, tags of the entries of each feed.

    Of the first 2 k entries, those with a title and an address that are no older than `hours`; of these the first k. A date is that of publishing, else of
    the update, else now. Files that hold no entry, null and broken ones give no rows.
    """
    found = df.select(source, F.posexplode(F.slice(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1), 1, 2 * k)).alias("place", "e"))
    e = F.col("e")
    link = F.coalesce(_field(e, "link"), F.nullif(F.regexp_extract(e, r"""(?s)<link\s[^>]*href\s*=\s*["']([^"']*)["']""", 1), F.lit("")))
    dated = [F.try_to_timestamp(F.regexp_replace(_field(e, tag), r"^[A-Za-z]{3},\s*", ""), F.lit(f)) for tag in ("pubDate", "published", "updated") for f in DATE_FORMATS]
    rows = found.select(
        source,
        "place",
        _field(e, "title").alias("title"),
        link.alias("url"),
        _field(F.coalesce(_field(e, "author", "dc:creator"), F.lit("")), "name").alias("_name"),
        _field(e, "author", "dc:creator").alias("_author"),
        _field(e, "content:encoded", "content", "summary", "description", "subtitle").alias("content"),
        F.coalesce(*dated, now).alias("published"),
        F.filter(F.concat(F.regexp_extract_all(e, F.lit(r"(?s)<category[^>]*>([^<]+)</category>"), 1), F.regexp_extract_all(e, F.lit(r"""<category\s[^>]*term=["']([^"']+)["']"""), 1)), lambda t: t != "").alias("tags"),
    )
    kept = rows.where(F.col("title").isNotNull() & F.col("url").isNotNull() & (F.col("published") >= now - F.expr(f"interval {hours} hours")))
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy("place"))).where(F.col("_r") <= k)
    return kept.select(source, "place", "title", "url", F.coalesce("_name", "_author").alias("author"), "content", "published", "tags")


def scan(df: DataFrame, source: str, xml: str, kind: str, now: Column, hours: int, k: int, tags: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, failures) of landed files of sources of any number. Kinds rss, atom, web and youtube (a feed of videos) are read; other kinds give no rows
    and no failure. A file that is null, or of a kind that is read but without an entry, fails: source and reason. Tags of the source come
    before those of the entry."""
    known = F.lower(F.coalesce(F.col(kind), F.lit(""))).isin("rss", "atom", "web", "youtube")
    rows = df.where(known)
    found = entries(rows, source, xml, now, hours, k)
    if tags:
        own = rows.select(F.col(source).alias("_s"), F.coalesce(tags, F.array().cast("array<string>")).alias("_tags")).dropDuplicates(["_s"])
        found = found.join(own, F.col(source) == F.col("_s")).withColumn("tags", F.array_distinct(F.concat("_tags", "tags"))).drop("_s", "_tags")
    broken = F.when(F.col(xml).isNull(), "missing").when(~F.col(xml).rlike(r"<(?:item|entry)[\s>]"), "no entries")
    return found, rows.select(source, broken.alias("reason")).where("reason is not null")
