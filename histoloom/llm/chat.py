"""Cumulative-snapshot collapse of logged conversations, and chat formatting of those that remain.

A service that logs a conversation after every turn leaves snapshots that are prefixes of each other. Turns are numbered in
order, each prefix gets a rolling hash (the exclusive or of hashes salted with the turn's number), and conversations whose
full hash is a proper prefix of a longer one fall to an anti join. Of equal conversations the least conv_id stays.

All this is done on digests of the turns; texts are joined to those that remain. Digests are dealt out by ranges of
(conv_id, turn, ..), so a conversation of any length is spread over tasks: running values are built inside each range, and
what stands before comes from a table with a row for each part of the few conversations that lie in several ranges.

Defined cases: turns are ordered by (turn, role, MD5 of text), nulls first; exactly repeated rows of a conversation count
once; null role and text are hashed as nulls and rendered as empty; rows of null conv_id form one conversation; texts of any
length are rendered whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.session import stage

#: How a turn is written; fixed values of the chat format.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
_TURN = ["conv_id", "turn", "role", "digest"]
#: Conversations up to which the list of kept ones is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def _turns(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


def _segment_length() -> Column:
    return F.lit(len(OPEN + AFTER_ROLE + CLOSE)) + F.coalesce(F.length("role"), F.lit(0)) + F.col("chars")


def _before(placed: DataFrame, combine, value: str, name: str) -> DataFrame:
    """(conv_id, part, name) for every part but the first of conversations in several parts: value combined over the parts before."""
    parts = placed.groupBy("conv_id", "part").agg(combine(value).alias("here"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn(name, combine("here").over(earlier)).where(F.col(name).isNotNull())
    return found.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), name)


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with a table of _before: it has fewer rows than there are parts."""
    return rows.join(F.broadcast(table), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, number (from 1), start (characters of the rendered conversation before the turn), the prefix's hash as (one, two): 128 bits, and whether the turn is its conversation's last."""
    rows = _turns(turns).groupBy(*_TURN).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    placed = rows.repartitionByRange(*_TURN).withColumn("part", F.spark_partition_id())
    placed = stage(placed.withColumn("length", _segment_length().cast("long")).drop("chars"), "turn-digests")
    inside = Window.partitionBy("conv_id", "part").orderBy(*[F.col(c).asc_nulls_first() for c in _TURN[1:]])
    upto, zero = inside.rowsBetween(Window.unboundedPreceding, 0), F.lit(0).cast("long")
    numbered = placed.withColumns({"number": F.row_number().over(inside).cast("long"), "start": F.sum("length").over(upto) - F.col("length"), "ends": F.lead("part").over(inside).isNull()})
    for combine, value, name in ((F.sum, "one_each", "turns_before"), (F.sum, "length", "start_before"), (F.max, "part", "parts_before")):
        numbered = _joined(numbered, _before(placed.withColumn("one_each", F.lit(1)), combine, value, name))
    last = placed.groupBy("conv_id").agg(F.max("part").alias("last"), F.min("part").alias("first")).where("last > first")
    ends = F.broadcast(last.select(F.col("conv_id").alias("_conv"), F.col("last").alias("_part")).withColumn("final", F.lit(True)))
    numbered = numbered.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbered = numbered.withColumn("ends", F.col("ends") & (F.col("_part").isNull() | (F.col("_part") == F.col("part")))).drop("_conv", "_part", "final", "parts_before")
    numbered = numbered.withColumns({"number": F.col("number") + F.coalesce("turns_before", zero), "start": F.col("start") + F.coalesce("start_before", zero)}).drop("turns_before", "start_before", "length")
    hashes = {name: F.xxhash64(F.lit(salt), "number", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest") for name, salt in (("one", 1), ("two", 2))}
    numbered = stage(numbered.withColumns(hashes), "numbered-turns")
    rolling = numbered.withColumns({name: F.bit_xor(name).over(upto) for name in hashes})
    for name in hashes:
        rolling = _joined(rolling, _before(numbered, F.bit_xor, name, "earlier"))
        rolling = rolling.withColumn(name, F.col(name).bitwiseXOR(F.coalesce("earlier", zero))).drop("earlier")
    return rolling.drop("part")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, number, start, role, text and turn of the turns of conversations that are no prefix, and no later copy, of another."""
    rows = stage(prefixes(turns), "prefixes")
    full = rows.where("ends").groupBy("number", "one", "two").agg(F.min("conv_id").alias("_conv"))
    inner = rows.where("not ends").groupBy("number", "one", "two").agg(F.count("*").alias("_n")).drop("_n")
    kept = stage(full.join(inner, ["number", "one", "two"], "left_anti").select("_conv"), "kept-conversations")
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    digests = rows.join(kept, rows["conv_id"].eqNullSafe(kept["_conv"]), "left_semi").select(*_TURN, "number", "start")
    said = _turns(turns)
    texts = said.join(kept, said["conv_id"].eqNullSafe(kept["_conv"]), "left_semi").groupBy(*_TURN).agg(F.first("text").alias("text"))
    same = F.lit(True)
    for c in _TURN:
        same = same & digests[c].eqNullSafe(texts[c])
    return digests.join(texts, same).select(digests["conv_id"], "number", "start", digests["role"], "text", digests["turn"])


def render_turns(turns: DataFrame) -> DataFrame:
    """Each turn's stretch of its conversation's rendered text and where that starts (characters); `learned` marks the assistant's turns. turns: of maximal_conversations."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    segment = F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE))
    return turns.select("conv_id", "number", "start", segment.alias("segment"), (role == "assistant").alias("learned"))


def render_conversations(turns: DataFrame) -> DataFrame:
    """The whole rendered text of each conversation, for conversations that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "segment")))
    return render_turns(turns).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["segment"]), "").alias("rendered"))
