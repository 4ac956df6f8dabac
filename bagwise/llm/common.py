"""Column builders and numbering helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of words: space and the control characters 9 to 13.
SEP = " \\t-\\r"
#: The same as plain characters, for translate().
SEP_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` words of a non-null text."""
    return F.filter(F.split(text, f"[{SEP}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body):
    """``body(value)`` with ``value`` evaluated once per row.  An expression
    named inside a lambda is otherwise evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def unit(col: Column) -> Column:
    """A hash as a number in (0, 1]."""
    return (F.shiftrightunsigned(col, 11) + F.lit(1)) / F.lit(float(1 << 53))


def bucket_count(df: DataFrame, per_bucket: int) -> int:
    """Buckets of about ``per_bucket`` rows (a count, no rows, reaches the driver)."""
    return max(1, -(-df.count() // per_bucket))


#: A group of alike rows is made in blocks of so many, which any task may take.
BLOCK = 10_000


def repeat_rows(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row ``times`` (a long column, at least 1) times, numbered from 0 in
    ``name``.  Large counts are first cut into blocks that are dealt over the
    tasks, so that no array or task holds a hot group whole."""
    few = df.where(F.col(times) <= BLOCK).withColumn("__from", F.lit(0).cast("long"))
    starts = F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(BLOCK).cast("long"))
    many = df.where(F.col(times) > BLOCK).withColumn("__from", F.explode(starts))
    many = many.repartition(F.col("__from"), *[F.col(f"`{c}`") for c in df.columns])
    last = F.least(F.col("__from") + BLOCK, F.col(times)) - 1
    return few.unionByName(many).withColumn(name, F.explode(F.sequence(F.col("__from"), last))).drop("__from")


def gapless(df: DataFrame, group: list[str], order: list[Column], spread: Column,
            name: str, per_bucket: int = 200_000, weight: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without putting a
    group into one task: rows are dealt by ``spread`` (a long hash) into
    buckets of about ``per_bucket`` rows, each bucket starts where the counts
    of the group's earlier buckets end, and rows are ranked within buckets.
    With ``weight`` a row stands for so many and gets the first number of them."""
    weight = F.lit(1) if weight is None else weight
    n = bucket_count(df, per_bucket)
    dealt = df.withColumn("__bucket", F.pmod(spread, F.lit(n)))
    keys = [*group, "__bucket"]
    counts = dealt.groupBy(*keys).agg(F.sum(weight).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(starts, keys)
            .withColumn(name, F.col("__start") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
            .drop("__bucket", "__start"))


#: Rows sent to a Python worker at a time by operators that send whole texts.
TEXT_ROWS = 500


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch size, so that a batch of long texts
    stays small (Spark 4.1 has no limit in bytes)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(name)) <= 0 or int(conf.get(name)) > TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
