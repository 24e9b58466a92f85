"""Chat formatting [operator 3]: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and everybody else as a named user; the mask trains on
the speaker's own words and end marks only. System turns are shown in each
rendering and are no perspective. Dialogues are rendered in blocks of
BLOCK_TURNS turn numbers, so that one endless conversation is many rows of
bounded size; short ones are one block.

Nulls: a null role is the speaker "unknown", null text is empty, null turns
form the first block's start, and a row with a null conv_id belongs to no other
row: it is a conversation of one turn in block 0. Ties of a turn number are ordered by role, then text; repeated
rows are repeated turns. Conversations with system turns only, and the empty
table, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

BLOCK_TURNS = 256
SYSTEM = "system"
END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) to a row per conversation, speaker and block.

    `text` is the rendering, `mask` its run lengths "length:train" in code
    points, alternating between what is shown and what is trained on.
    """
    role = F.coalesce("role", F.lit("unknown"))
    turns = turns.select("conv_id", "turn", "role", "text")
    known = turns.where("conv_id IS NOT NULL")
    turn = F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lone = turns.where("conv_id IS NULL").select("conv_id", F.lit(0).cast("long").alias("block"), F.array(turn).alias("turns"), role.alias("speaker")).where(F.col("speaker") != SYSTEM)
    said = known.select("conv_id", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(0)).cast("long").alias("block"), turn.alias("said"))
    blocks = said.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    speakers = known.select("conv_id", role.alias("speaker")).where(F.col("speaker") != SYSTEM).distinct()
    each = blocks.join(speakers, "conv_id").unionAll(lone)

    def head(t):
        return F.when(t.role == F.col("speaker"), F.lit("<|assistant|>\n")).when(t.role == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), t.role, F.lit("|>\n")))

    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t.text, F.lit(END))), "")
    body = lambda t: F.length(t.text) + len(END)
    mask = F.array_join(F.transform("turns", lambda t: F.concat(F.length(head(t)).cast("string"), F.lit(":0,"), body(t).cast("string"), F.when(t.role == F.col("speaker"), ":1").otherwise(":0"))), ",")
    own = F.filter("turns", lambda t: t.role == F.col("speaker"))
    trained = F.aggregate(own, F.lit(0).cast("long"), lambda a, t: a + body(t))
    return each.select("conv_id", "speaker", "block", F.size("turns").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_own"), trained.alias("n_trained"), mask.alias("mask"), text.alias("text"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  CASE WHEN conv_id IS NULL THEN 0 ELSE coalesce(CAST(floor(turn / {BLOCK_TURNS}.0) AS BIGINT), 0) END AS block,
                  CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM (SELECT * FROM conversations)),
p AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
r AS (SELECT t.*, p.speaker, CASE WHEN t.role = p.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = '{SYSTEM}' THEN '<|system|>' || chr(10)
             ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head, t.text || '<|end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.alone IS NOT DISTINCT FROM p.alone)
SELECT conv_id, speaker, block, count(*) AS n_turns, count(*) FILTER (WHERE role = speaker) AS n_own,
       CAST(coalesce(sum(length(body)) FILTER (WHERE role = speaker), 0) AS BIGINT) AS n_trained,
       string_agg(length(head) || ':0,' || length(body) || CASE WHEN role = speaker THEN ':1' ELSE ':0' END, ',' ORDER BY turn NULLS FIRST, role, text) AS mask,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM r GROUP BY conv_id, alone, speaker, block
"""
