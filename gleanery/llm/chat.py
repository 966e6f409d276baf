"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table

TURNS_A_PART = 256
START, END = "<|start|>", "<|end|>\n"


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns_a_part: int = TURNS_A_PART) -> DataFrame:
    """For every conversation and every participant of it: the dialogue with that speaker as the assistant and the others as named users.

    conv_id, speaker, part, n_turns, n_assistant_turns, text, mask_spans, mask_chars. A turn is written <|start|>assistant\\n...<|end|> or
    <|start|>user name=NAME\\n...<|end|>; mask_spans lists [start, end) in characters of what the assistant says, its <|end|> included, which is
    what a loss is taken over. system is no participant: such turns are rendered as system, for everyone.

    A dialogue's part p holds the turns numbered from p * turns_a_part on, so that no row grows with the length of a conversation; each part
    starts over at character 0. Turns go by number, equal numbers by role and text; exact repeats of a turn count once. Null role: 'unknown';
    null text: empty; null turn: numbered 0; rows without conv_id are left out. A conversation of system turns only, or none, gives no row.
    Other columns are left out.
    """
    rows = (
        turns.select(
            F.col(conv_id).alias("conv_id"),
            F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("turn"),
            F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("said"),
        )
        .where("conv_id is not null")
        .distinct()
    )
    parts = rows.groupBy("conv_id", F.expr(f"turn div {turns_a_part}").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "said"))).alias("turns"), F.collect_set("role").alias("here")
    )
    # Roles of the whole conversation: a part lists its own, and other parts' speakers are added.
    roles = parts.select("conv_id", F.explode("here").alias("speaker")).where("speaker != 'system'").distinct()
    seen = parts.join(roles, "conv_id")
    body = F.expr(
        "transform(turns, t -> named_struct("
        f"'head', concat('{START}', case when t.role = speaker then 'assistant' when t.role = 'system' then 'system' else concat('user name=', t.role) end, '\\n'), "
        f"'tail', concat(t.said, '{END}'), 'own', t.role = speaker))"
    )
    laid = F.expr(
        "aggregate(body, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)), (a, t) -> named_struct("
        "'at', a.at + char_length(t.head) + char_length(t.tail), "
        "'spans', case when t.own then array_append(a.spans, named_struct('start', a.at + char_length(t.head), 'end', a.at + char_length(t.head) + char_length(t.tail))) else a.spans end))"
    )
    return (
        seen.withColumn("body", body)
        .withColumn("laid", laid)
        .select(
            "conv_id",
            "speaker",
            F.col("part").cast("long").alias("part"),
            F.size("turns").cast("long").alias("n_turns"),
            F.size(F.filter("body", lambda t: t["own"])).cast("long").alias("n_assistant_turns"),
            F.array_join(F.transform("body", lambda t: F.concat(t["head"], t["tail"])), "").alias("text"),
            F.col("laid.spans").alias("mask_spans"),
            F.aggregate("laid.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("mask_chars"),
        )
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogues with mask_spans as text start-end,start-end so that SQL can be held against it."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("mask_spans", spans)


OP6_SQL = f"""
WITH r AS (
  SELECT DISTINCT conv_id, COALESCE(turn, 0) AS turn, COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT *, turn // {TURNS_A_PART} AS part FROM r),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
x AS (
  SELECT p.conv_id, s.speaker, p.part, p.turn, p.role, p.said, (p.role = s.speaker) AS own,
    '{START}' || CASE WHEN p.role = s.speaker THEN 'assistant' WHEN p.role = 'system' THEN 'system' ELSE 'user name=' || p.role END || chr(10) AS head,
    p.said || '<|end|>' || chr(10) AS tail
  FROM p JOIN s USING (conv_id)
), y AS (
  SELECT *, CAST(SUM(length(head) + length(tail)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, said) AS BIGINT) AS upto FROM x
)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, COUNT(*) AS n_turns, CAST(SUM(CAST(own AS INT)) AS BIGINT) AS n_assistant_turns,
  string_agg(head || tail, '' ORDER BY turn, role, said) AS text,
  COALESCE(string_agg(CASE WHEN own THEN (upto - length(tail)) || '-' || upto END, ',' ORDER BY turn, role, said), '') AS mask_spans,
  CAST(SUM(CASE WHEN own THEN length(tail) ELSE 0 END) AS BIGINT) AS mask_chars
FROM y GROUP BY conv_id, speaker, part
"""
