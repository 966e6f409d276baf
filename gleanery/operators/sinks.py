"""Tables and files that results are written to, and read back from. Paths may be of any file system that Spark writes; the driver writes no file itself.

Writes are whole: a table is replaced only by a finished one beside it, so that a lost executor or a stopped job leaves the old table. Null keys are
equal to each other here, so that a row without a key isn't written again each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _path(spark, path)
    return files.exists(place)


def load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at a path, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Puts the rows in the place of the table at `path`, which they may be made from."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    files, old = _path(spark, path)
    if files.exists(old):
        files.delete(old, True)
    else:
        files.mkdirs(old.getParent())
    if not files.rename(_path(spark, beside)[1], old):
        raise OSError(f"can't move the new table to {path}")


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return met


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order`, then by all columns, so that ties are settled the same way each time."""
    rest = [F.to_json(F.struct(*df.columns))]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).where("_r = 1").drop("_r")


def upsert_table(new: DataFrame, path: str, keys: list[str], version: str) -> None:
    """The table at `path` with the rows of `new`: of each key the highest version, of equal ones the new row."""
    old = load(new.sparkSession, path, new.schema).withColumn("_new", F.lit(0))
    both = old.unionByName(new.withColumn("_new", F.lit(1)))
    replace(latest(both, keys, F.desc(version), F.desc("_new")).drop("_new"), path)


def insert_missing(new: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows of `new` whose key the table hasn't, one for each key (the first by all columns)."""
    old = load(new.sparkSession, path, new.schema)
    rows = latest(new, keys).alias("n").join(old.select(*keys).distinct().alias("o"), same_keys("n", "o", keys), "left_anti")
    rows.select(new.columns).write.mode("append").parquet(path)


def dated_documents(df: DataFrame, path: str, date: str = "created", overwrite: bool = False) -> None:
    """Documents in folders of year and month; rows without a date go to those of null."""
    parts = df.withColumns({"year": F.year(date), "month": F.month(date)})
    parts.repartition("year", "month").write.mode("overwrite" if overwrite else "append").partitionBy("year", "month").parquet(path)


def file_name(created: Column, edition: Column) -> Column:
    return F.concat(F.date_format(created, "yyyy-MM-dd_HHmm"), F.lit("_"), edition, F.lit("_newsletter.md"))


def markdown_files(df: DataFrame, path: str, name: str = "file", text: str = "text") -> None:
    """Each document as text in a folder of its file's name."""
    df.select(F.col(name).alias("file"), F.col(text).alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def index_of(df: DataFrame, date: str = "created", name: str = "file") -> DataFrame:
    """year, month, n and files, newest first: the contents of each folder. Folders without a document don't appear."""
    files = F.transform(F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(name).alias("f"))), asc=False), lambda x: x["f"])
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count("*").alias("n"), files.alias("files"))


def dates_of_files(df: DataFrame, name: str = "file") -> DataFrame:
    """Adds year and month from names that begin with a date; rows of other names are left out."""
    pattern = r"^(\d{4})-(\d{2})-\d{2}"
    rows = df.where(F.col(name).rlike(pattern))
    return rows.withColumns({"year": F.regexp_extract(name, pattern, 1).cast("int"), "month": F.regexp_extract(name, pattern, 2).cast("int")})


def backup(spark: SparkSession, path: str, folder: str, day: str) -> str:
    """A copy of a table under the day's name, replaced if there is one; gives its path."""
    to = f"{folder.rstrip('/')}/{day}"
    spark.read.parquet(path).write.mode("overwrite").parquet(to)
    return to


def append_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines after those that are there."""
    df.write.mode("append").json(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run_logs(events: DataFrame, path: str, keys: list[str], run: str, time: str, value: str, error: Column, message: Column) -> None:
    """Rolls the events of each run up and upserts the rows by `keys`: n, errors, duration, the errors' messages in order of time, status."""
    told = F.transform(F.array_sort(F.collect_list(F.when(error, F.struct(F.col(time).alias("t"), message.alias("m"))))), lambda x: x["m"])
    out = events.groupBy(*dict.fromkeys([*keys, run])).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.sum(value).alias("duration"), F.max(time).alias("ended"), F.array_join(told, "; ").alias("error_details"))
    status = F.when(F.col("errors") * 2 > F.col("n"), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    upsert_table(out.withColumn("status", status), path, keys, "ended")


def save_run(documents: DataFrame, logs: DataFrame, documents_path: str, logs_path: str) -> None:
    """Documents first, then the log rows that tell of them."""
    upsert_table(documents, documents_path, ["processing_date", "edition"], "updated")
    upsert_table(logs, logs_path, ["processing_date", "edition"], "ended")


def parsed_vectors(df: DataFrame, text: str, dim: int, vector: str = "embedding") -> DataFrame:
    """Vectors from JSON text; rows whose text isn't an array of `dim` numbers are left out."""
    v = F.from_json(text, "array<double>")
    rows = df.withColumn(vector, v)
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))


def refresh_vectors(history: DataFrame, path: str, since: Column, time: str, text: str, dim: int) -> None:
    """The vector table made anew from the history from `since` on."""
    replace(parsed_vectors(history.where(F.col(time) >= since), text, dim), path)


def prune_table(spark: SparkSession, path: str, time: str, since: Column) -> int:
    """Deletes rows older than `since` (rows without a time stay) and says how many."""
    rows = spark.read.parquet(path)
    old = F.coalesce(F.col(time) < since, F.lit(False))
    n = rows.where(old).count()
    if n:
        replace(rows.where(~old), path)
    return n


def recent(df: DataFrame, time: str, since: Column, key: str, n: int) -> DataFrame:
    """The n newest rows from `since` on, newest first, ties by key."""
    return df.where(F.col(time) >= since).orderBy(F.desc(time), key).limit(n)


def restored_texts(df: DataFrame, text: str, title: str, summary: str) -> DataFrame:
    """Texts that were cut with dots are made again from title and summary."""
    return df.withColumn(text, F.when(F.endswith(F.col(text), F.lit("...")), F.concat_ws(" ", title, summary)).otherwise(F.col(text)))


# The tables, their keys, and where a column refers to another table.
TABLES = {
    "contextual_articles": ("id string, article_id string, title string, content_summary string, embedding string, published_date timestamp, source_url string, topic_cluster string, created_at timestamp, source_id string, ai_relevance_score double, summary_points string, japanese_title string, is_update boolean", ["article_id"], {}),
    "article_relationships": ("id string, parent_article_id string, child_article_id string, relationship_type string, similarity_score double, created_at timestamp, reasoning string", ["parent_article_id", "child_article_id", "relationship_type"], {"parent_article_id": "contextual_articles", "child_article_id": "contextual_articles"}),
    "processed_content": ("id string, processing_date date, edition string, content_type string, title string, lead_paragraph string, articles_count int, multi_source_topics int, content_md string, metadata string, created_at timestamp, updated_at timestamp", ["processing_date", "edition", "content_type"], {}),
    "processing_logs": ("id string, processing_date date, edition string, status string, articles_processed int, articles_failed int, llm_calls int, total_tokens int, processing_time_seconds double, data string, error_details string, created_at timestamp", ["processing_date", "edition", "status"], {}),
}


def create_tables(spark: SparkSession, folder: str) -> list[str]:
    """Empty tables where there are none; gives the names of those made."""
    made = []
    for name, (schema, _, _) in TABLES.items():
        if not exists(spark, f"{folder}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def migrated(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns (name: (type, default)) that are missing; others stay as they are."""
    missing = {c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def key_breaches(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose column names no row of the parents; nulls name none and are no breach."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def health(spark: SparkSession, folder: str, required: dict[str, list[str]] | None = None) -> dict[str, tuple[bool, list[str]]]:
    """For each table whether it can be read, and which required columns it lacks."""
    wanted = required or {t: [c.split()[0] for c in schema.split(", ")] for t, (schema, _, _) in TABLES.items()}
    out = {}
    for name, columns in wanted.items():
        there = exists(spark, f"{folder}/{name}")
        have = spark.read.parquet(f"{folder}/{name}").columns if there else []
        out[name] = (there, [c for c in columns if c not in have])
    return out


def next_version(versions: list[str]) -> str:
    """One tenth after the last version by letters, as names of versions are compared; 1.0 without any."""
    return f"{float(max(versions)) + 0.1:.1f}" if versions else "1.0"


def backoff(attempt: int, base: float, most: float, drawn: float) -> float:
    """Seconds to wait before a further try: doubled each time up to a most, times 0.5 to 1.5 by a number drawn in [0, 1)."""
    return min(base * 2**attempt, most) * (0.5 + drawn)
