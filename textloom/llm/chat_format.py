"""Chat transcripts from logged conversations, without the snapshots that longer ones contain.

Turns are ordered by turn, role and text; exact repeats of a row are one turn.  A prefix of a conversation is
known by its length and three running sums of 40-bit hashes of (position, role, text): a window function over
sorted turns, so a conversation of any length is streamed.  A conversation is dropped if it equals a shorter prefix of
another one (an anti-join with the distinct proper prefixes of all), and of equal conversations the
smallest conv_id stays.  The others are rendered, one block for each turn, in parts of PART turns: a longer conversation
gives several rows, numbered from 0, of which no task holds more than one at a time.

Null turns sort first, a null role is written `unknown`, a null text is empty (but differs from an empty one when
prefixes are compared).  A row without conv_id is a conversation of its own, of one turn: such rows, however many, are no
group.  It is dropped like any other, and of equal ones one stays, without an id.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read

_LANES = ["s1", "s2", "s3"]
#: Turns of a rendered row.
PART = 10_000
#: What tells conversations apart: the id, and for rows without one their turn.
_KEYS = ["conv", "own"]


def _turns(conversations: DataFrame) -> DataFrame:
    own = F.when(F.col("conv_id").isNull(), F.md5(F.to_json(F.struct("turn", "role", "text"))))
    rows = conversations.select(F.col("conv_id").alias("conv"), own.alias("own"), "turn", "role", "text").distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("turn", "role", "text")))


def maximal(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv, own and turns of the conversations that stay; own is null but for rows without conv_id."""
    null = F.lit("\x00null")
    rows = _turns(conversations)
    for k, lane in enumerate(_LANES):
        rows = rows.withColumn(lane, F.pmod(F.xxhash64(F.lit(k), "pos", F.coalesce("role", null), F.coalesce("text", null)), F.lit(1 << 40)))
    order = Window.partitionBy(*_KEYS).orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead("pos").over(order).isNull()
    rows = rows.select(*_KEYS, "pos", last.alias("last"), *[F.sum(x).over(running).alias(x) for x in _LANES])
    rows = Scratch(spark).write(rows, "prefixes")
    first = F.min(F.struct(F.col("conv").isNull().alias("none"), *_KEYS)).alias("first")  # one with an id goes before one without
    whole = rows.where("last").groupBy("pos", *_LANES).agg(first)
    proper = rows.where("not last").select("pos", *_LANES).distinct()
    return whole.join(proper, ["pos", *_LANES], "left_anti").select("first.conv", "first.own", F.col("pos").alias("turns"))


def render(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, part and the rendered text of each conversation that stays."""
    kept = maximal(spark, conversations).toDF("c", "o", "turns")
    block = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = _turns(conversations).join(kept, F.col("conv").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o")))
    rows = rows.select(*_KEYS, F.col("turns").cast("long").alias("n_turns"), F.floor((F.col("pos") - 1) / PART).cast("long").alias("part"), "pos", block.alias("block"))
    rows = rows.groupBy(*_KEYS, "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("blocks"))
    return rows.select(F.col("conv").alias("conv_id"), "n_turns", "part", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, read(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row(turn, role, text)::VARCHAR END AS own, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  count(*) OVER (PARTITION BY conv_id, own) AS n FROM t),
p AS (SELECT conv_id, own, pos, n,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id, own ORDER BY pos) AS prefix,
  string_agg(coalesce(role, chr(1) || 'null') || chr(2) || coalesce(text, chr(1) || 'null') || chr(3), '') OVER (PARTITION BY conv_id, own ORDER BY pos) AS k FROM r),
w AS (SELECT min(conv_id) AS conv_id, n, k, any_value(prefix) AS prefix FROM p WHERE pos = n GROUP BY n, k)
SELECT conv_id, n AS n_turns, 0::BIGINT AS part, prefix AS text FROM w WHERE (n, k) NOT IN (SELECT pos, k FROM p WHERE pos < n)
"""
