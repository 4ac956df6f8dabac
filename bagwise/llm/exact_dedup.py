"""Exact deduplication by content-defined chunk recipes.

A text is cut where its content says so (at the first sentence or line end
after MIN_CHUNK characters, at MAX_CHUNK at the latest), so that equal
passages give equal chunks whatever stands before them.  Each chunk gets a
128-bit identifier, which is verified: no identifier may belong to chunks of
two SHA-256 digests or lengths in this corpus (else another salt is taken).
A document is then its recipe, the ordered list of identifiers; documents are
equal when their recipes are.  After the first pass only identifiers move, no
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import text_or_empty
from bagwise.session import materialize

MIN_CHUNK = 512
MAX_CHUNK = 4096
SALTS = ("", "b", "c", "d")
#: A group is hot if it holds more than one row in so many.
HOT_SHARE = 1000


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a non-null text in order; together they are the text.
    The empty text has none."""
    cut = f"(?s).{{{least},{most - 1}}}?(?:[.!?]\\s|\\n)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def identifier(chunk: Column, salt: str) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(salt), chunk).cast("binary")))


def recipes(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` columns plus ``recipe`` (array of verified identifiers),
    kept as a table in the checkpoint folder."""
    for salt in SALTS:
        named = F.transform(chunks(text_or_empty(F.col("text"))), lambda c: F.struct(
            identifier(c, salt).alias("id"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")))
        rows = materialize(docs.select(*keep, named.alias("chunks")))
        # Equal chunks meet before the shuffle, so a chunk in every document costs one row a task.
        distinct = rows.select(F.explode("chunks").alias("c")).groupBy("c.id", "c.sha").count()
        if distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return rows.withColumn("recipe", F.col("chunks.id")).drop("chunks")
    raise RuntimeError("no salt gives each chunk an identifier of its own")


def name_recipes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``same``, a 128-bit name of their recipe, in its place;
    groups: same, keep_id, group_size).  Recipes are compared whole, with
    partial counts before the shuffle; a name shared by two of them is met by
    another salt.  What follows moves names only."""
    for salt in SALTS:
        name = F.unhex(F.md5(F.concat(F.lit(salt).cast("binary"), F.array_join(
            F.transform("recipe", F.hex), "").cast("binary"))))
        named = rows.withColumn("same", name)
        groups = materialize(named.groupBy("same", "recipe").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("recipe"))
        if groups.groupBy("same").count().where("count > 1").isEmpty():
            return named.drop("recipe"), groups
    raise RuntimeError("no salt gives each recipe a name of its own")


def group_rows(rows: DataFrame, order: str) -> DataFrame:
    """(doc_id, recipe, ...) -> without recipe, plus keep_id, group_size and kept.

    Groups are joined back by their names of 16 bytes: those of more than one
    row in HOT_SHARE, of which there are fewer than HOT_SHARE, by broadcast, so
    that a third of all rows may be copies of one text; the other groups by a
    shuffle, and a text without copies is its own group.  The row of the
    largest doc_id stays; of several rows under that doc_id and recipe those
    of the least ``order`` (a long), found by partial minima.  A null doc_id is
    smaller than any other; in a group of nothing else keep_id is null."""
    named, groups = name_recipes(rows)
    groups = groups.where("group_size > 1")
    least = rows.count() // HOT_SHARE

    def spread(left: DataFrame, right: DataFrame) -> DataFrame:
        hot, cool = right.where(F.col("group_size") > least), right.where(F.col("group_size") <= least)
        first = left.join(F.broadcast(hot.withColumn("met", F.lit(True))), "same", "left")
        rest = first.where("met IS NULL").select(*left.columns).join(
            cool.withColumn("met", F.lit(True)), "same", "left")
        return first.where("met").unionByName(rest)

    last = spread(named.select("same", "doc_id", order), groups).where("met AND doc_id <=> keep_id")
    groups = materialize(last.groupBy("same", "keep_id", "group_size").agg(F.min(order).alias("keep_order")))
    out = spread(named, groups)
    alone = F.col("met").isNull()
    out = out.withColumns({
        "keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "kept": alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(order) == F.col("keep_order")))})
    return out.drop("same", "met", "keep_order")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal (empty recipe).  Rows alike in doc_id and
    text are ties, of which one stays.  An empty table gives an empty result;
    other columns, whatever their names, are not read."""
    digest = F.sha2(text_or_empty(F.col("text")).cast("binary"), 256)
    own = F.monotonically_increasing_id().alias("own")
    rows = recipes(docs, [F.col("doc_id"), digest.alias("text_sha256"), own])
    return group_rows(rows, "own").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies (the row of the largest doc_id stays),
    with its columns.  The rows that stay are found on identifiers alone and
    named by a 128-bit fingerprint of the whole row; of rows alike in every
    column one stays."""
    named = [F.col(f"`{c}`") for c in docs.columns]
    prints = [F.xxhash64(F.lit(i), *named).alias(f"__print{i}") for i in (1, 2)]
    rows = recipes(docs, [F.col("doc_id"), *prints])
    keys = ["__print1", "__print2"]
    kept = group_rows(rows, "__print1").where("kept").select(*keys).distinct()
    stays = docs.select(*named, *prints).join(kept, keys, "left_semi")
    # Rows alike in every column meet before the shuffle.
    return stays.dropDuplicates(keys).select(*named)
