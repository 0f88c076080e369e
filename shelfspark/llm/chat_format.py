"""Chat formatting in budgeted, turn-aligned windows, by DataFrame functions only.

Prefix sums of the turns' tokens choose the windows: half of the free budget is one slice, a new
window begins where a turn starts in another slice than the turn before it, or beside a turn that is
longer than a slice. So a window never exceeds the budget unless one turn alone does. Every window
keeps the system turn and repeats the last turns of the window before it as far as the history
budget goes; repeated turns carry no loss, so each assistant text is a target exactly once.

A turn is written ``### role: text </turn>`` and a line feed, a repeated one ``###= role: ...``.
Control strings inside a text are escaped: backslash as two, ``###`` as ``\\h``, ``</turn>`` as
``\\t``, and in a role the colon as ``\\c``.

The rows of one conversation meet in one task, as its digest over all turns in order demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.registry import query, table

BUDGET = 1024
HISTORY = 256
LEAST_SLICE = 32
OPEN, OPEN_AGAIN, CLOSE = "### ", "###= ", " </turn>\n"
PROBE = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    def one(part: Column) -> Column:
        part = F.replace(F.replace(part, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>"))
        return F.replace(part, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), one), "\\")


def turn_tokens(text: Column) -> Column:
    """Tokens a turn is charged: a quarter of its UTF-8 bytes, rounded up, and four for the marks."""
    return F.floor((F.octet_length(text) + 3) / 4) + 4


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss_spans) of conversations given as (conv_id, turn, role, text) rows.

    ``loss_spans`` are code points of ``formatted``, end exclusive. Null role and text count as empty, null
    turns come first, rows of one turn number are ordered by role and text and all kept; a null conv_id is a
    conversation of its own. The first turn is the system turn if its role is ``system``. No rows in, no rows
    out. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    in_order = conv.orderBy(F.asc_nulls_first("turn"), "role", "text")
    by_pos = conv.orderBy("pos")
    rows = rows.withColumn("pos", F.row_number().over(in_order) - 1).withColumn("tokens", turn_tokens(F.col("text")))
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    rows = rows.withColumn("system", system).withColumn("body", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("upto", F.sum("body").over(by_pos)).withColumn("kept", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(conv))
    rows = rows.withColumn("slice", F.greatest(F.floor((F.lit(budget - history) - F.col("kept")) / 2), F.lit(LEAST_SLICE)))
    rows = rows.withColumn("cell", F.floor((F.col("upto") - F.col("body")) / F.col("slice"))).withColumn("big", F.col("body") > F.col("slice"))
    before = F.lag(F.struct("cell", "big", "system")).over(by_pos)
    opens = before.isNotNull() & ~before["system"] & ((before["cell"] != F.col("cell")) | before["big"] | F.col("big"))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("window", F.sum("opens").over(by_pos).cast("int"))
    rows = rows.withColumn("last", F.max("window").over(conv)).withColumn("window_end", F.max("upto").over(Window.partitionBy("conv_id", "window")))
    again = ~F.col("system") & (F.col("window") < F.col("last")) & (F.col("window_end") - F.col("upto") + F.col("body") <= history)
    windows = F.when(F.col("system"), F.sequence(F.lit(0), F.col("last"))).when(again, F.array("window", F.col("window") + 1)).otherwise(F.array("window"))
    copies = rows.select("conv_id", "pos", "role", "text", F.col("window").alias("own"), F.explode(windows).alias("window"))
    copies = copies.withColumn("repeated", F.col("own") != F.col("window"))
    head = F.concat(F.when(F.col("repeated"), OPEN_AGAIN).otherwise(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    copies = copies.select("conv_id", "window", "pos", "repeated", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    copies = copies.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    in_window = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(in_window), F.lit(0)) + F.length("head"))
    loss = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    parts = F.sort_array(F.collect_list(F.struct("pos", "piece", loss.alias("loss"))))
    packed = copies.groupBy("conv_id", "window").agg(parts.alias("parts"))
    return packed.select(
        "conv_id",
        "window",
        F.array_join("parts.piece", "").alias("formatted"),
        F.filter("parts.loss", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Turns (those not repeated) and target texts of each window, read from its formatted text alone."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.startswith(OPEN))

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(rest, ": ", 1)
        text = F.substring(rest, F.length(role) + 3, F.length(rest))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def target(span: Column) -> Column:
        return unescape(F.substring(F.col("formatted"), (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return windows.select(
        "conv_id", "window", "formatted", F.transform(pieces, turn).alias("turns"), F.transform("loss_spans", target).alias("targets")
    )


_ESC = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t')"

SQL = rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, (strlen(text) + 3) // 4 + 4 AS tok FROM base),
s AS (SELECT *, pos = 0 AND role = 'system' AS sys FROM p),
b AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE tok END AS body,
    greatest((768 - max(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id)) // 2, 32) AS slice FROM s),
u AS (SELECT *, sum(body) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM b),
c AS (SELECT *, (upto - body) // slice AS cell, body > slice AS big FROM u),
o AS (
  SELECT *, CASE WHEN pos > 0 AND NOT lag(sys) OVER w AND (lag(cell) OVER w <> cell OR lag(big) OVER w OR big) THEN 1 ELSE 0 END AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
v AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM o),
e AS (
  SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, max(upto) OVER (PARTITION BY conv_id, win) AS wend,
    length(replace({_ESC.format("role")}, ':', '\c')) + length({_ESC.format("text")}) + 2 + 9 AS n FROM v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(n + 4 + CASE WHEN sys THEN last * (n + 5) WHEN win < last AND wend - upto + body <= 256 THEN n + 5 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op4_chat_format", SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    read = read_windows(format_windows(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = F.struct(
        "window", said.alias("said"), F.array_join("targets", "").alias("target"), F.size("turns").alias("n"), F.length("formatted").alias("chars")
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("w"))
    target = F.array_join("w.target", "")
    total = lambda name: F.aggregate(f"w.{name}", F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join("w.said", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target.cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
