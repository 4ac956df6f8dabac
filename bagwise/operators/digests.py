"""Row equality by digest: narrow rows decide, whole rows move once.

A key is named by two 64-bit hashes; a third hash and the key's length in
characters tell two keys of one name apart.  Names with more than one of
these are doubtful, and their rows, no others, are compared as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = ("_h1", "_h2")
#: What must be equal under one name.
PROOF = ("_h3", "_chars")


def _hash(seed: int, cols: Sequence[str]) -> Column:
    # A hash leaves nulls out, so which columns are null is hashed as well.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in cols])


def named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the digests of the columns ``cols``."""
    chars = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in cols]
    hashes = {h: _hash(i, cols) for i, h in enumerate((*NAME, PROOF[0]))}
    return df.withColumns(hashes | {PROOF[1]: sum(chars, F.lit(0)).cast("long")})


def doubtful() -> Column:
    """In an aggregation by name: whether it stands for more than one key."""
    return F.greatest(*[(F.min(c) != F.max(c)).cast("int") for c in PROOF]) == 1


def first_rows(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The row of the lowest ``order_col`` of every key, nulls equal.  Narrow
    rows find it; the rows themselves meet the winners in one join.  Names
    that are doubtful, or whose lowest number stands in several rows, are
    grouped by the keys themselves."""
    marked = named(df, keys)
    at = marked.groupBy(*NAME, order_col).agg(F.count(F.lit(1)).alias("_c"), *[F.min(c).alias(f"{c}l") for c in PROOF],
                                              *[F.max(c).alias(f"{c}m") for c in PROOF])
    two = F.greatest(*[(F.min(f"{c}l") != F.max(f"{c}m")).cast("int") for c in PROOF]) == 1
    # Numbers only, so that both aggregations are by hash; no struct, which would be sorted.
    first = at.groupBy(*NAME).agg(F.min(order_col).alias("_first"), F.min_by("_c", order_col).alias("_of"),
                                  two.alias("_two")).select(
        *NAME, "_first", (F.col("_two") | (F.coalesce("_of", F.lit(2)) > 1)).alias("_doubt"))
    met = marked.join(first, list(NAME)).where(F.col("_doubt") | F.col(order_col).eqNullSafe(F.col("_first")))
    sure = met.where(~F.col("_doubt")).select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    again = met.where("_doubt").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_r"))
    return sure.unionByName(again.select(*keys, "_r.*").select(*df.columns))


def rows_in_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur exactly once in ``left`` and the distinct rows of
    ``right`` together."""
    cols = left.columns
    sides = [named(left, cols), named(right.select(*cols), cols)]
    narrow = sides[0].select(*NAME, *PROOF, F.lit(1).alias("_left")).unionByName(
        sides[1].select(*NAME, *PROOF, F.lit(0).alias("_left")))
    found = narrow.groupBy(*NAME).agg(F.sum("_left").alias("_n"), F.max(1 - F.col("_left")).alias("_right"),
                                      doubtful().alias("_doubt"))
    once = found.where(F.col("_doubt") | (F.col("_n") + F.col("_right") == 1)).select(
        *NAME, "_doubt", (F.col("_right") == 1).alias("_from_right"))
    from_left = sides[0].join(once, list(NAME))
    from_right = sides[1].join(once.where(F.col("_doubt") | F.col("_from_right")), list(NAME))
    sure = from_left.where(~F.col("_doubt")).select(*cols).unionByName(
        from_right.where(~F.col("_doubt")).dropDuplicates(list(NAME)).select(*cols))
    both = from_left.where("_doubt").select(*cols).unionByName(from_right.where("_doubt").select(*cols).dropDuplicates())
    again = both.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    return sure.unionByName(again)
