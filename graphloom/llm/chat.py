"""Multi-party perspective rotation of dialogues.

For every participant (role) of a conversation the dialogue is rendered with that participant as
the assistant and all others as named users. Rendering is by turn, with running character
offsets, so that a dialogue's text is the concatenation of its segments and no task has to hold
a whole dialogue; `mask_start` and `mask_end` bound the characters a model is to learn.

No text or name can forge a marker: in what is rendered, `<|` of a text becomes `<||`, which no marker
starts with and which can be undone; in a name `|` becomes a broken bar and a line end a space.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null or blank role is the
participant `unknown`; a null text is empty; a null conv_id is a conversation; repeated rows are
turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position (from 0), speaker, segment, char_start, char_end, mask_start, mask_end.

    The mask is the text and end mark of the perspective's own turns, null for others' turns. One
    shuffle, on conv_id: the later windows and the join of participants reuse its partitioning.
    """
    role = F.coalesce(F.when(F.trim("role") != "", F.col("role")), F.lit("unknown"))
    base = turns.select("conv_id", "turn", role.alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||")).alias("said"))
    conv = Window.partitionBy("conv_id")
    order = (F.col("turn").asc_nulls_first(), "speaker", "said")
    base = base.withColumn("position", (F.row_number().over(conv.orderBy(*order)) - 1).cast("long"))
    base = base.withColumn("participants", F.sort_array(F.collect_set("speaker").over(conv)))
    each = base.select("conv_id", "position", "speaker", "said", F.explode("participants").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit("<|user name="), F.translate("speaker", "|\r\n", "\u00a6  "), F.lit("|>\n")))
    each = each.withColumn("segment", F.concat(head, "said", F.lit(END))).withColumn("own", own)
    so_far = Window.partitionBy("conv_id", "perspective").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("char_end", F.sum(F.length("segment").cast("long")).over(so_far))
    each = each.withColumn("char_start", F.col("char_end") - F.length("segment"))
    return each.select(
        "conv_id", "perspective", "position", "speaker", "segment", "char_start", "char_end",
        F.when(F.col("own"), F.col("char_start") + len(ASSISTANT)).alias("mask_start"), F.when(F.col("own"), F.col("char_end")).alias("mask_end"),
    )


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(CASE WHEN trim(role, ' ') <> '' THEN role END, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<||') AS said FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, said) - 1 AS position FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
e AS (SELECT b.conv_id, b.position, b.speaker, p.perspective, b.speaker = p.perspective AS own,
        CASE WHEN b.speaker = p.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || translate(b.speaker, '|' || chr(13) || chr(10), '\u00a6  ') || '|>' || chr(10) END || said || '<|end|>' || chr(10) AS segment
      FROM b JOIN p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM e)
SELECT conv_id, perspective, position, speaker, segment, char_end - length(segment) AS char_start, char_end,
  CASE WHEN own THEN char_end - length(segment) + 14 END AS mask_start, CASE WHEN own THEN char_end END AS mask_end FROM c
"""


def op2_perspectives(spark, sf_dir) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
