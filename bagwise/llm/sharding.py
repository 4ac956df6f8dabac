"""Sharding by jump consistent hashing (Lamping and Veach).

A stable key walks through increasing bucket numbers: from bucket b the next
is floor((b + 1) / r) with r a fresh random number in (0, 1] drawn from the
key; the key's shard is the last number below the shard count.  The walk does
not depend on the count, so one more shard takes 1/(n+1) of the rows and no
row moves between old shards.  There is no ring table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import gapless, repeat_rows, unit
from bagwise.session import materialize

SALT = 20_240_101
#: Steps that nearly every key needs no more than; the rest walk on.
USUAL_STEPS = 24


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key (null: a key of its own).

    ``b`` strictly grows, so ``shards`` steps always suffice; rows that have
    arrived after USUAL_STEPS skip the rest."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(s, i):
        u = unit(F.xxhash64(key, F.lit(SALT), i))
        moves = s["j"] < shards
        return F.struct(F.when(moves, s["j"]).otherwise(s["b"]).alias("b"),
                        F.when(moves, F.floor((s["j"] + 1) / u)).otherwise(s["j"]).alias("j"))

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    first = min(shards, USUAL_STEPS)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step)
    if shards > first:
        walked = F.transform(F.array(walked), lambda s: F.when(s["j"] >= shards, s).otherwise(
            F.aggregate(F.sequence(F.lit(first + 1), F.lit(shards)), s, step)))[0]
    return walked["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes of the text plus 1),
    text_crc32, law ``key``, shard, slot and grown_shard (with one shard more).

    The shard follows from the key and the shard count alone, so equal texts
    under different keys may part.  ``slot`` numbers a shard's rows from 0
    without gaps, in the order of a hash of the key, size and checksum, then
    of these themselves.  Rows alike in all three are counted before the
    shuffle and travel as one, so that one key, or one text under one key,
    may hold a third of all rows.  A null text has size 1 and checksum 0; a null key is a key like any other; an
    empty table gives an empty result; other columns are not read."""
    rows = docs.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"))
    alike = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")))
    spread = F.xxhash64(F.col(key), "size", "text_crc32", F.lit(SALT + 1))
    order = [spread.asc(), F.col(key).asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    placed = gapless(alike, ["shard"], order, spread, "first", weight=F.col("rows"))
    return repeat_rows(placed, "rows", "nth").withColumn("slot", F.col("first") + F.col("nth")).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
