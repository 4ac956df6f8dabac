"""Sinks (S3-S7): bags, label dictionary, prediction / submission / report tables.

Every writer is one distributed ``df.write``; nothing is gathered on the
driver.  Bags are written once, partitioned by ``bag_id``, in files of about
equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.operators.strata import checked_broadcast
from bagwise.sources.delimited import read_delimited  # noqa: F401  (S1 counterpart)


FILE_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, other columns 8."""
    sizes = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) + 4 if t in ("string", "binary") else F.lit(8)
             for n, t in df.dtypes]
    return sum(sizes, F.lit(0)).cast("long")


def plan_files(bags: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, int]:
    """(bags with their file number ``_file``, number of files).

    The bytes of each bag, a row per bag, give its number of files; a bag's
    rows are dealt over its files by a hash of the row, so a bag of half of
    all rows is many files and no small bag is more than one."""
    per_bag = bags.groupBy("bag_id").agg(F.sum(row_bytes(bags)).alias("_bytes"))
    files = F.greatest(F.ceil(F.col("_bytes") / F.lit(file_bytes)), F.lit(1)).cast("int")
    before = Window.orderBy("bag_id").rowsBetween(Window.unboundedPreceding, -1)     # a row per bag
    plan = checked_broadcast(per_bag.select("bag_id", files.alias("_files")).withColumn(
        "_first", F.coalesce(F.sum("_files").over(before), F.lit(0)).cast("int")))
    total = plan.agg(F.sum("_files")).first()[0] or 0
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in bags.columns]), F.col("_files")).cast("int")
    return bags.join(plan, "bag_id").withColumn("_file", F.col("_first") + deal).drop("_files", "_first"), int(total)


def write_bags(bags: DataFrame, path: str, fmt: str = "parquet", file_bytes: int = FILE_BYTES) -> None:
    """All bags in one write, a folder per bag, files of about ``file_bytes``
    before compression (S3).  ``bags`` is read twice, for sizes and rows."""
    dealt, files = plan_files(bags, file_bytes)
    if files:
        bags = dealt.repartitionById(files, F.col("_file")).select(*bags.columns)
    w = bags.write.mode("overwrite").partitionBy("bag_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_label_dim(dim: DataFrame, path: str) -> None:
    """Label dictionary as JSON lines."""
    dim.select("label", "digit").coalesce(1).write.mode("overwrite").json(path)


def read_label_dim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label int, digit string").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",") -> None:
    """Prediction (S5), submission (S6) and summary tables (S7); CSV with a
    header and UTF-8 (Spark writes no BOM)."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str, drop=("Unnamed: 0",)) -> None:
    """Submission rows without index columns."""
    write_table(df.drop(*[c for c in drop if c in df.columns]), path, "csv", "|")
