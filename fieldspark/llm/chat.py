"""Chat formatting: collapse cumulative snapshots, then render the conversations that remain.

Loggers often store a conversation again after every turn. Each conversation gets a
rolling hash per turn prefix; one whose whole hash is a proper prefix hash of another is
a snapshot and goes by an anti join, equal ones collapse to the smallest id. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, turns, prefixes): turns in order and a 128-bit rolling hash after each.

    Rows repeated as a whole count once. Turns sort by number (null numbers first), then
    role, then text; null roles and texts are empty; rows without a conversation id are
    not part of any conversation.
    """
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("conv_id IS NOT NULL").distinct()
    # a conversation is one rendered record, so it fits in a row
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rolled = F.aggregate(
        "turns", F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(F.md5(F.concat(
            F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.md5(t["role"].cast("binary")),
            F.md5(t["text"].cast("binary"))).cast("binary")))))
    return held.withColumn("prefixes", rolled)


def collapse(convs: DataFrame) -> DataFrame:
    """Maximal conversations of ``conversations``: (conv_id, turns, n_copies), copies merged into the smallest id."""
    whole = convs.withColumn("whole", F.element_at("prefixes", -1))
    classes = whole.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = whole.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    kept = classes.join(shorter, "whole", "left_anti").select("conv_id", "n_copies")
    return convs.select("conv_id", "turns").join(kept, "conv_id")


def render(maximal: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text; markers inside a text are broken up."""
    body = F.array_join(F.transform("turns", lambda t: F.concat(
        F.lit(START), _escaped(t["role"]), F.lit("\n"), _escaped(t["text"]), F.lit(END), F.lit("\n"))), "")
    return maximal.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", body.alias("text"))


def format_chats(df: DataFrame, **columns: str) -> DataFrame:
    """Collapse and render a table of turns. An empty table gives no rows."""
    return render(collapse(conversations(df, **columns)))


SQL = f"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM rows),
prefix AS (
  SELECT conv_id, k, n,
         string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
         string_agg('{START}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS body
  FROM numbered),
classes AS (SELECT p, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefix WHERE k = n GROUP BY p)
SELECT c.conv_id, x.n AS n_turns, c.n_copies, x.body AS text
FROM classes c JOIN prefix x ON x.conv_id = c.conv_id AND x.k = x.n
WHERE c.p NOT IN (SELECT p FROM prefix WHERE k < n)
"""
