"""Exact per-stratum ranks without single-task windows.

``row_number().over(partitionBy(label))`` puts a whole class into one task; a
class may hold a third of all rows.  ``stratified_rank`` splits each stratum
into buckets by a key that is monotone in the sort order (a prefix of the md5
order key, or the ranges of a range partitioning), counts rows per (stratum, bucket) -- a small
table -- turns the counts into running offsets, ranks rows inside their bucket
and adds the offset.  The result equals the plain window rank exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# rows per bucket we aim for; a bucket is sorted inside one task
TARGET_BUCKET_ROWS = 200_000
# above this many rows or bytes a derived table is not broadcast
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def prefix_len_for(max_rows: int, target: int = TARGET_BUCKET_ROWS) -> int:
    """Hex-prefix length so that the largest stratum has <= target rows per bucket."""
    if max_rows <= target:
        return 1
    return max(1, min(8, math.ceil(math.log(max_rows / target, 16))))


def md5_bucket(key, prefix_len: int) -> Column:
    k = key if isinstance(key, Column) else F.col(key)
    return F.substring(k, 1, prefix_len)


def stratified_rank(df: DataFrame, strata: Sequence[str], order: Sequence,
                    bucket: Column, rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` = 1-based row_number within ``strata`` by ``order``.

    ``bucket`` must be non-decreasing along ``order`` inside a stratum; strata
    must be non-null.  One shuffle on (strata, bucket) for the rows; the count
    table is aggregated map-side."""
    strata = list(strata)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*strata, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*strata).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_bkt",
                            F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*strata, "_bkt").orderBy(*order)
    ranked = b.withColumn("_rn", F.row_number().over(w_in))
    return (ranked.join(offsets, on=strata + ["_bkt"], how="inner")
            .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_bkt", "_off", "_rn"))


def max_stratum_rows(df: DataFrame, strata: Sequence[str]) -> int:
    row = df.groupBy(*strata).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def rank_by_key(df: DataFrame, strata: Sequence[str], key_col: str,
                tie_col: str = "id", rank_col: str = "rank",
                max_rows: int | None = None) -> DataFrame:
    """Rank by an md5 order key (then ``tie_col``) inside strata."""
    if max_rows is None:
        max_rows = max_stratum_rows(df, strata)
    p = prefix_len_for(max_rows)
    return stratified_rank(df, strata, [F.col(key_col), F.col(tie_col)],
                           md5_bucket(key_col, p), rank_col)


def rank_by_number(df: DataFrame, strata: Sequence[str], num_col: str,
                   tie_cols: Sequence[str] = (), rank_col: str = "rank",
                   target: int = TARGET_BUCKET_ROWS) -> DataFrame:
    """Rank by any orderable column (e.g. ``id``, a number or text) inside
    strata.  Buckets are the ranges of a range partitioning of the strata and
    the order columns, whose bounds Spark takes from a sample of the rows, so
    they stay near ``target`` rows however the values cluster.  The ranges
    are written once, since counts and ranks must see the same ones."""
    from bagwise.session import materialize
    keys = [num_col, *tie_cols]
    order = [F.col(c) for c in keys]
    n = df.count()
    if n <= target:
        return stratified_rank(df, strata, order, F.lit(0), rank_col)
    ranged = df.repartitionByRange(math.ceil(n / target), *strata, *keys)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    return stratified_rank(ranged, strata, order, F.col("_range"), rank_col).drop("_range")


def prefix_len_col(n: Column, target: int = TARGET_BUCKET_ROWS) -> Column:
    """Per-stratum hex-prefix length: <= target rows per bucket on average."""
    p = F.ceil(F.log(16.0, n.cast("double") / F.lit(float(target))))
    return F.when(n <= target, F.lit(1)).otherwise(F.least(F.lit(8), F.greatest(F.lit(1), p))) \
        .cast("int")


def first_k(df: DataFrame, k_table: DataFrame, strata: Sequence[str], key_col: str,
            tie_col: str = "id", flag: str = "_in",
            target: int = TARGET_BUCKET_ROWS) -> DataFrame:
    """Flag the first ``_k`` rows of every stratum in the order (key, tie).

    ``k_table`` has (strata..., n, _k).  Rows are bucketed by a key prefix
    whose length depends on the stratum size; per-bucket counts give running
    offsets.  A bucket wholly before the k-th row is in, one wholly after is
    out; only the (at most one per stratum) bucket holding the boundary is
    ranked.  The rows themselves are not shuffled when the offset table is
    small enough to broadcast (checked); only boundary buckets are sorted."""
    strata = list(strata)
    kt = checked_broadcast(k_table.select(*strata, "_k", prefix_len_col(F.col("n"), target)
                                          .alias("_p")))
    b = df.join(kt, strata).withColumn("_bkt", F.col(key_col).substr(F.lit(1), F.col("_p")))
    counts = b.groupBy(*strata, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"),
                                             F.first("_k").alias("_k"))
    w_off = Window.partitionBy(*strata).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, -1)
    off = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)))
    state = (F.when(F.col("_off") + F.col("_cnt") <= F.col("_k"), F.lit(1))
             .when(F.col("_off") >= F.col("_k"), F.lit(0)).otherwise(F.lit(2)))
    offs = checked_broadcast(off.select(*strata, "_bkt", "_off", state.alias("_st")))
    j = b.drop("_k", "_p").join(offs, strata + ["_bkt"])
    decided = j.where(F.col("_st") < 2).withColumn(flag, F.col("_st") == 1)
    edge = j.where(F.col("_st") == 2).join(kt.select(*strata, "_k"), strata)
    w_in = Window.partitionBy(*strata, "_bkt").orderBy(F.col(key_col), F.col(tie_col))
    edge = edge.withColumn(flag, F.col("_off") + F.row_number().over(w_in) <= F.col("_k")) \
        .drop("_k")
    return decided.unionByName(edge).drop("_bkt", "_off", "_st")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking its size (rows, and bytes of the
    cached table, since model tables have wide rows); otherwise leave the
    join to Spark (sort-merge / AQE).  Meant for class-, model- or
    vocab-sized tables; the table is cached because it is counted and then
    reused."""
    df = df.cache()
    n = df.count()
    if n > max_rows:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df
