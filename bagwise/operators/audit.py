"""Audits of the record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.functions.codes import TEXT_COLS


def class_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class (A1)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_size_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Mean and exact quantiles 0/.25/.5/.75/1 of the class sizes with linear
    interpolation (A2); runs on the class histogram."""
    h = class_histogram(df, label)
    q = F.percentile(F.col("n"), F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return h.agg(F.count(F.lit(1)).alias("classes"), F.avg("n").alias("mean"), q.alias("_q")) \
        .select("classes", "mean", *[F.col("_q")[i].alias(n) for i, n in
                                      enumerate(("min", "q25", "median", "q75", "max"))])


def null_patterns(df: DataFrame, cols: Sequence[str] = TEXT_COLS) -> DataFrame:
    """Count of rows per null pattern of the texts (A4, F2)."""
    flags = [F.col(c).isNull().alias(f"{c}_null") for c in cols]
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """Non-null count of every column, one row per column."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column, non_null)")


def split_counts(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows and classes per split / bag (A10)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"),
                               F.countDistinct("label").alias("classes"))
