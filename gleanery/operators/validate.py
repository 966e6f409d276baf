"""Rules on texts: violations as long tables, scores and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a violation of each severity costs.
WEIGHTS = {"error": 0.3, "warning": 0.1, "info": 0.05}


def rules(text: Column) -> dict[str, tuple[str, Column]]:
    """rule -> (severity, condition that is met where the rule is broken). A null text breaks those that an empty one breaks."""
    text = F.coalesce(text, F.lit(""))
    return {
        "too_short": ("error", F.length(text) < 200),
        "too_long": ("warning", F.length(text) > 5000),
        "no_ending": ("warning", ~F.right(F.rtrim(F.translate(text, "\t\r\n\f\x0b", "     ")), F.lit(1)).isin(".", "!", "?")),
        "no_number": ("info", ~text.rlike(r"[0-9]")),
        "shouting": ("error", F.regexp_count(text, F.lit("[A-Z]")) * 2 > F.greatest(F.regexp_count(text, F.lit("[a-zA-Z]")), F.lit(1))),
        "many_commas": ("info", F.regexp_count(text, F.lit(",")) > 40),
    }


def violations(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each broken rule: key, rule_id, severity."""
    broken = F.array(*[F.when(met, F.struct(F.lit(name).alias("rule_id"), F.lit(sev).alias("severity"))) for name, (sev, met) in rules(F.col(text)).items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("v")).select(key, "v.rule_id", "v.severity")


def quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """score: 1 less the broken rules' weights, and a level by score and errors."""
    found = rules(F.col(text))
    lost = sum((F.when(met, F.lit(WEIGHTS[s])).otherwise(F.lit(0.0)) for s, met in found.values()), F.lit(0.0))
    errors = sum((F.when(met, F.lit(1)).otherwise(F.lit(0)) for s, met in found.values() if s == "error"), F.lit(0))
    out = df.select(key, F.greatest(F.lit(0.0), 1 - lost).alias("score"), errors.cast("long").alias("errors"))
    level = F.when((F.col("score") >= 0.9) & (F.col("errors") == 0), "excellent").when((F.col("score") >= 0.75) & (F.col("errors") == 0), "good").when(F.col("score") >= 0.6, "acceptable").when(F.col("score") >= 0.4, "poor").otherwise("failed")
    return out.withColumn("level", level)
