"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets the dialogue rendered from their side: their turns are
the assistant's, all others are users with a name, and system turns stay system turns.  The mask holds
the stretches of characters that the assistant writes: text and end mark of each own turn.

Every participant sees the whole dialogue, system turns included.  No row has to hold an unbounded one: its rendering is
stored in pieces of ``PIECE_TURNS`` turn numbers, and of at most ``PIECE_ROWS`` rows should many share a number.
Pieces are cuts of one text: put together in the order of piece and part they are the rendering of the
whole dialogue, ``start`` says where a piece begins in it, and masks count from its beginning.

Rows: turns are ordered by number, then role, then text, nulls first; a null number is a piece of its
own.  A null role is a participant named "unknown", a null text is empty.  Rows without conv_id are one
conversation.  Repeated rows are repeated turns.  A conversation of system turns alone has no
participant and gives no row.  Control marks within texts and line ends within names are defused.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import Stored, table

PIECE_TURNS, PIECE_ROWS = 4096, 4096
_START, _END = "<|im_start|>", "<|im_end|>"


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def perspectives(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, piece, part, speaker, n_turns, start, rendered, mask ("start-end" of characters, joined by commas), n_masked.

    ``turns``: conv_id, turn, role, text.
    """
    role = F.regexp_replace(_defused(F.coalesce("role", F.lit("unknown"))), r"[\r\n]+", " ")
    rows = turns.select("conv_id", "turn", role.alias("role"), _defused(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("piece", F.floor(F.col("turn") / PIECE_TURNS).cast("long"))
    n = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text"))
    rows = rows.withColumn("n", n).withColumn("part", F.floor((F.col("n") - 1) / PIECE_ROWS).cast("long"))
    people = turns.select(F.col("conv_id").alias("__id"), role.alias("speaker")).where(F.col("speaker") != system).distinct()
    both = rows.join(people, rows["conv_id"].eqNullSafe(people["__id"])).drop("__id")
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit(f"{_START}assistant\n")).when(F.col("role") == system, F.lit(f"{_START}system\n")).otherwise(F.concat(F.lit(f"{_START}user name="), "role", F.lit("\n")))
    both = both.select("conv_id", "piece", "part", "speaker", F.struct("n", head.alias("head"), F.concat("text", F.lit(_END)).alias("body"), own.alias("own")).alias("t"))
    pieces = both.groupBy("conv_id", "piece", "part", "speaker").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # a fold over the turns: characters so far, and the stretches of the speaker's own bodies
    stretch = "struct<a:bigint,b:bigint>"
    fold = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{stretch}>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).alias("at"),
            F.when(t["own"], F.array_append(s["spans"], F.struct((s["at"] + F.length(t["head"])).alias("a"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("b")).cast(stretch))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    rendered = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    made = pieces.select("conv_id", "piece", "part", "speaker", F.size("t").cast("long").alias("n_turns"), rendered.alias("rendered"), fold.alias("fold"))
    stored = Stored(made.select("*", "fold.at", "fold.spans").drop("fold"), "pieces")
    # only dialogues of several pieces have any that begins later
    keys = ("conv_id", "piece", "part", "speaker")
    sizes = stored.df.select(*[F.col(c).alias(f"__{c}") for c in keys], "at")
    many = sizes.groupBy(F.col("__conv_id").alias("__c"), F.col("__speaker").alias("__s")).agg(F.count("*").alias("n")).where("n > 1")
    before = F.sum("at").over(Window.partitionBy("__conv_id", "__speaker").orderBy("__piece", "__part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.join(many, F.col("__conv_id").eqNullSafe(F.col("__c")) & (F.col("__speaker") == F.col("__s")), "left_semi").withColumn("__start", before).drop("at").where("__start > 0")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    out = stored.df.join(later, same, "left").select(*keys, "n_turns", "rendered", "spans", F.coalesce("__start", F.lit(0).cast("long")).alias("start"))
    mask = F.array_join(F.transform("spans", lambda x: F.concat((x["a"] + F.col("start")).cast("string"), F.lit("-"), (x["b"] + F.col("start")).cast("string"))), ",")
    own = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select("conv_id", "piece", "part", "speaker", "n_turns", "start", "rendered", mask.alias("mask"), own.alias("n_masked"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), '[\r\n]+', ' ', 'g') AS role,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS text, CAST(floor(turn / 4096) AS BIGINT) AS piece FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, piece ORDER BY turn NULLS FIRST, role, text) AS n FROM r
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'
), b AS (
  SELECT n.conv_id, n.piece, CAST((n.n - 1) // 4096 AS BIGINT) AS part, p.speaker, n.n, n.role = p.speaker AS own,
    CASE WHEN n.role = p.speaker THEN '<|im_start|>assistant' WHEN n.role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || n.role END || chr(10) AS head,
    n.text || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), x AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY piece NULLS FIRST, part, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM b
)
SELECT conv_id, piece, part, speaker, count(*) AS n_turns, CAST(min(o) AS BIGINT) AS start, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(o + length(head) AS BIGINT) || '-' || CAST(o + length(head) + length(body) AS BIGINT) END, ',' ORDER BY n), '') AS mask,
  CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_masked
FROM x GROUP BY conv_id, piece, part, speaker
"""

QUERIES = {"op6_perspectives": op6_perspectives}
ORACLES = {"op6_perspectives": ORACLE}
