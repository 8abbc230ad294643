"""Chat formatting: cumulative snapshots collapse into their longest, then are rendered.

A log may hold a conversation several times, each a prefix of a later snapshot. Each
turn gets a hash of its position, role and text; the exclusive-or of the hashes up to a turn
identifies the prefix that ends there. A conversation whose whole hash is a proper
prefix of another is dropped by an anti-join; of equal conversations the one with the
smallest conv_id stays. Those that remain are rendered turn by turn.

DataFrame functions only. Turns are dealt by conversation and range of turns, so a
conversation with a large part of all turns is spread; prefixes are made
distinct before the join, so a common first turn is one row.

Edge cases: turns are ordered by number, role and text, nulls first; turns that repeat
each count. A null role is rendered as ``unknown``, a null text as empty, and
they differ from empty ones in comparisons. Rows with a null conv_id form one conversation. A
conversation of more than ``PART_TURNS`` turns is rendered in parts, one row each.
Marks of the template inside a text are broken by a space. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import materialize, with_offsets

PART_TURNS = 1024
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))
    return F.concat(F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(END + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its position, the number of turns, and two hashes of the prefix that it ends."""
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_c", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col("turn") / PART_TURNS).cast("long"), F.lit(-(1 << 62))))
    rows = with_offsets(rows, ["_c"], "_b", [F.asc_nulls_first(x) for x in ("turn", "role", "text")], None, "pos")
    parts = ["pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumn("_x", F.xxhash64(F.lit(1), *parts)).withColumn("_y", F.xxhash64(F.lit(2), *parts))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_c", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("_c", "_b").agg(F.bit_xor("_x").alias("_bx"), F.bit_xor("_y").alias("_by"))
    sums = sums.select("_c", "_b", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("_bx", "_by")])
    rows = rows.withColumn("_x", F.bit_xor("_x").over(inside)).withColumn("_y", F.bit_xor("_y").over(inside)).join(sums, ["_c", "_b"])
    return rows.select("_c", "conv_id", "role", "text", "pos", F.col("pos_all").alias("n_turns"), F.col("_x").bitwiseXOR(F.col("_bx")).alias("h1"), F.col("_y").bitwiseXOR(F.col("_by")).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """Keys of the conversations that are no proper prefix and no copy of another."""
    whole = rows.where("pos + 1 = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("null"), "conv_id", "_c")).alias("k"))
    inner = rows.where("pos + 1 < n_turns").select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select(F.col("k._c").alias("_c"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part, text of the maximal conversations.

    Prefixes are written once; finding the maximal ones reads no texts.
    """
    rows = materialize(prefixes(turns), "turns")
    kept = rows.join(maximal(rows), "_c", "left_semi")
    line = F.struct("pos", rendered(F.col("role"), F.col("text")).alias("line"))
    out = kept.withColumn("part", F.floor(F.col("pos") / PART_TURNS)).groupBy("_c", "conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return out.select("conv_id", "n_turns", "part", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns FROM t GROUP BY conv_id
), inner_prefix AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)
), kept AS (
  SELECT min(conv_id) AS conv_id FROM c WHERE turns NOT IN (SELECT turns FROM inner_prefix) GROUP BY turns
)
SELECT t.conv_id, CAST(c.n_turns AS BIGINT) AS n_turns, CAST(t.pos // 1024 AS BIGINT) AS part,
       string_agg('<|im_start|>' || coalesce(t.role, 'unknown') || chr(10)
         || replace(replace(coalesce(t.text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
         || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS text
FROM t JOIN kept USING (conv_id) JOIN c USING (conv_id)
GROUP BY t.conv_id, c.n_turns, t.pos // 1024
"""
