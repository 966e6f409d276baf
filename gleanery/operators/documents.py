"""Checks of whole markdown documents: sections, leads, contents, and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a finding takes off a document's score.
LOST = {"critical": 0.2, "major": 0.1, "minor": 0.05}


def sections(df: DataFrame, key: str, text: str, mark: str = r"#{1,3}[ \t\r\f\x0B]+") -> DataFrame:
    """key, place, title, body: the parts of a document between its headings, lines that begin with the mark; place 0, without a title, is what stands
    before the first. Bodies have no blanks or empty lines around them. Null texts have no part."""
    t = F.col(text)
    parts = F.split(t, rf"(?md)(?=^{mark})")
    parts = F.when(t.rlike(f"^{mark}"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    each = df.where(t.isNotNull()).select(key, F.posexplode(parts).alias("place", "_p"))
    headed = F.col("place") > 0
    title = F.when(headed, F.regexp_replace(F.split_part("_p", F.lit("\n"), F.lit(1)), f"^{mark}", "")).otherwise(F.lit(""))
    body = F.when(headed, F.regexp_replace("_p", r"^[^\n]*\n?", "")).otherwise(F.col("_p"))
    return each.select(key, "place", title.alias("title"), F.regexp_replace(body, r"^[ \n]+|[ \n]+\z", "").alias("body"))


def findings(df: DataFrame, key: str, text: str, lead: tuple[int, int] = (100, 1000), entries: tuple[int, int] = (3, 10)) -> DataFrame:
    """key, rule, severity: one row for each rule that a document breaks."""
    parts = F.split(F.col(text), r"\n#{1,3}\s+")
    first = F.length(F.get(parts, F.lit(0)))
    rules = [
        ("empty", "critical", F.coalesce(F.trim(text), F.lit("")) == ""),
        ("short_lead", "major", first < lead[0]),
        ("long_lead", "minor", first > lead[1]),
        ("few_sections", "major", F.size(parts) - 1 < entries[0]),
        ("many_sections", "minor", F.size(parts) - 1 > entries[1]),
        ("open_end", "minor", ~F.col(text).rlike(r"[.!?。！？]\s*$")),
    ]
    broken = F.array(*[F.when(met, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, met in rules])
    return df.select(key, F.explode(F.array_compact(broken)).alias("f")).select(key, "f.*")


def verdicts(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """key, counts by severity, score (1 less what they take off, 0 at least) and redo: a score under 0.5, or anything critical."""
    counts = found.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in LOST])
    rows = df.select(key).join(counts, key, "left").fillna(0, list(LOST))
    score = F.greatest(F.lit(1.0) - sum((F.col(s) * n for s, n in LOST.items()), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("redo", (F.col("score") < 0.5) | (F.col("critical") > 0))


def report(found: DataFrame, key: str) -> DataFrame:
    """key and report: a line for each severity, worst first, with its rules in order."""
    order = F.map_from_arrays(F.array(*map(F.lit, LOST)), F.array(*[F.lit(i) for i in range(len(LOST))]))
    lines = found.groupBy(key, "severity").agg(F.concat_ws(": ", "severity", F.array_join(F.array_sort(F.collect_set("rule")), ", ")).alias("line"))
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order[F.col("severity")].alias("o"), "line"))).alias("l"))  # three lines at most
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))


def addresses(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, links, distinct_links, hosts, and repeated, the share of links that repeat one."""
    found = df.select(key, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(r"(https?://[^\s)\"'<>]+)"), 1)).alias("url"))
    out = found.groupBy(key).agg(F.count("url").alias("links"), F.count_distinct("url").alias("distinct_links"), F.count_distinct(F.regexp_extract("url", "://([^/]+)", 1)).alias("hosts"))
    return out.withColumn("repeated", F.when(F.col("links") > 0, 1 - F.col("distinct_links") / F.col("links")).otherwise(F.lit(0.0)))


def numbered(df: DataFrame, group: str, title: Column, *order: Column) -> DataFrame:
    """group and contents: its numbered titles, a line each."""
    lines = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(group, "_r", F.concat_ws(". ", F.col("_r").cast("string"), title).alias("_l"))
    rows = lines.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", "_l"))).alias("_a"))
    return rows.select(group, F.array_join(F.transform("_a", lambda x: x["_l"]), "\n").alias("contents"))
