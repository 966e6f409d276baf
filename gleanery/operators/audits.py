"""Statistics, names and decisions on tables and logs. Nulls are left out of counts by value; an empty table gives an empty result, or zeros where there
is one row in all; ties go to the smaller name or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import fixed as X


def store_audit(df: DataFrame, time: str, source: str) -> DataFrame:
    """One row: n, first, last, days, sources."""
    return df.agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(F.to_date(time)).alias("days"), F.count_distinct(source).alias("sources"))


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source)


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows of each side, and keys that only one side has."""
    keys = a.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = keys.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return each.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row: n, the largest dimension, and the bytes that the vectors take as 32-bit floats."""
    size = F.size(vector)
    return df.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("dimension"), F.coalesce(F.sum(size.cast("long")) * 4, F.lit(0)).alias("bytes"))


def stage_telemetry(df: DataFrame, stage: str, ins: str, outs: str, failed: Column) -> DataFrame:
    """Of each stage: runs, share completed, and rows out over rows in."""
    out = df.groupBy(stage).agg(F.count("*").alias("runs"), F.avg(F.when(failed, 0.0).otherwise(F.lit(1.0))).alias("completed"), F.sum(ins).alias("_i"), F.sum(outs).alias("_o"))
    return out.select(stage, "runs", "completed", F.when(F.col("_i") > 0, F.col("_o") / F.col("_i")).otherwise(F.lit(0.0)).alias("efficiency"))


def stage_log(df: DataFrame, duplicate: Column) -> DataFrame:
    """One row: n, duplicates and their rate."""
    n = df.agg(F.count("*").alias("n"), F.count_if(duplicate).alias("duplicates"))
    return n.withColumn("rate", F.when(F.col("n") > 0, F.col("duplicates") / F.col("n")).otherwise(F.lit(0.0)))


def session_summary(df: DataFrame, session: str, kind: str, tokens: str, quality: str, cost: str) -> DataFrame:
    """Of each session: events by kind (a map), tokens by key (a map), mean quality and cost."""
    kinds = df.groupBy(session, kind).agg(F.count("*").alias("n")).groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("events"))
    used = df.select(session, F.explode(tokens).alias("k", "v")).groupBy(session, "k").agg(F.sum("v").alias("v")).groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tokens"))
    rest = df.groupBy(session).agg(F.avg(quality).alias("quality"), F.sum(cost).alias("cost"))
    return rest.join(kinds, session, "left").join(used, session, "left").select(session, "events", "tokens", "quality", "cost")


def errors_by_type(df: DataFrame, operation: str, kind: str, time: str, message: str, now: Column) -> DataFrame:
    """Of each operation: total, those of the hour before `now`, counts by type (a map), and the last message."""
    kinds = df.groupBy(operation, kind).agg(F.count("*").alias("n")).groupBy(operation).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("types"))
    rest = df.groupBy(operation).agg(F.count("*").alias("total"), F.count_if(F.col(time) > now - F.expr("interval 1 hour")).alias("last_hour"), F.max_by(message, F.struct(time, message)).alias("last"))
    return rest.join(kinds, operation)


def ring(df: DataFrame, group: str | None, n: int, *order: Column) -> DataFrame:
    """The last n rows (of each group): those first in `order`."""
    if group is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def degrades(rate: Column, load: Column, errors: Column) -> Column:
    """Whether service is to be reduced: too many errors by share or number, or too much load."""
    return (rate > 0.5) | (load > 0.9) | (errors > 10)


def degradation(errors: Column) -> Column:
    """The level of reduced service by recent errors."""
    return F.when(errors > 20, "minimal").when(errors > 15, "reduced").when(errors > 10, "limited").when(errors > 0, "watch").otherwise("full")


def breaker(df: DataFrame, group: str, ok: Column, *order: Column, failures: int = 5, successes: int = 3) -> DataFrame:
    """Of each group the state of its breaker after its last calls: open after so many failures running, closed again after so many successes."""
    w = Window.partitionBy(group).orderBy(*order)
    runs = df.withColumn("_ok", ok).withColumn("_new", (F.lag("_ok").over(w).isNull() | (F.lag("_ok").over(w) != F.col("_ok"))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w)).groupBy(group, "_run", "_ok").agg(F.count("*").alias("_n"))
    state = F.max_by(F.col("_ok"), F.when((~F.col("_ok") & (F.col("_n") >= failures)) | (F.col("_ok") & (F.col("_n") >= successes)), F.col("_run")))
    return runs.groupBy(group).agg(F.when(F.coalesce(state, F.lit(True)), "closed").otherwise("open").alias("state"))


def topic_name(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """group and name: its most frequent phrase of capitalised words, ties to the one met first (by row order, then place); else its most frequent
    technical term; a name has 3 to 30 characters. Groups without one get no name."""
    body = F.coalesce(F.col(text), F.lit(""))
    phrases = F.regexp_extract_all(body, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b"), 0)
    low = F.lower(body)
    known = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in X.TECH_TERMS)))

    def most(found: Column, rank: int) -> DataFrame:
        each = df.select(group, order, F.posexplode(found).alias("at", "name")).where(F.length("name").between(3, 30))
        return each.groupBy(group, "name").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first")).withColumn("kind", F.lit(rank))

    both = most(phrases, 0).unionByName(most(known, 1))
    one = both.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("kind", F.desc("n"), "first"))).where("_r = 1")
    return df.select(group).distinct().join(one.select(group, "name"), group, "left")


def priorities(df: DataFrame, source: str, known: dict[str, int], names: dict[int, str], default: int = 3) -> DataFrame:
    """Adds priority (of unknown sources the default) and its description."""
    p = F.lit(default)
    for name, value in known.items():
        p = F.when(F.col(source) == name, value).otherwise(p)
    d = F.lit("unknown")
    for value, name in names.items():
        d = F.when(F.col("priority") == value, name).otherwise(d)
    return df.withColumn("priority", p).withColumn("description", d)


def publication_summary(df: DataFrame) -> DataFrame:
    """edition, date, articles, quality, words and minutes of reading of documents, as readers see them."""
    return df.select("edition", F.date_format("created", "yyyy-MM-dd").alias("date"), "articles", F.round("quality", 2).alias("quality"), "words", F.format_string("%.1f min", F.col("words") / 200.0).alias("read_time"))


def log_rows(df: DataFrame, kind: str, key: Column, value: Column, time: Column) -> DataFrame:
    """Rows of one log for events of any kind: kind, key, value as JSON, time."""
    return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.to_json(F.struct(value.alias("value"))).alias("value"), time.alias("time"))


def found_prompts(df: DataFrame, query: str | None = None, tags: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Prompts (name, text, tags, variables, uses) whose name or text has the query, that have any of the tags and any of the variables; by uses, name."""
    rows = df
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "name", "text")), F.lit(query.lower())))
    for column, wanted in (("tags", tags), ("variables", names)):
        if wanted:
            rows = rows.where(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    return rows.orderBy(F.desc("uses"), "name")
