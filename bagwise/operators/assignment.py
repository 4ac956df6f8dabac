"""Estimator -> learner type, loss and display name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def learner_ranges(spark: SparkSession, types: Sequence[tuple[str, int]]) -> DataFrame:
    """(type, type_order, n, lo, hi): cumulative estimator ranges in the
    given type order (W5); types with n = 0 get an empty range."""
    if not any(n > 0 for _, n in types):
        raise ValueError("need at least one base model")
    t = spark.createDataFrame([(name, i, n) for i, (name, n) in enumerate(types)],
                              "type string, type_order int, n int")
    w = Window.orderBy("type_order").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("hi", F.sum("n").over(w).cast("int")) \
        .withColumn("lo", (F.col("hi") - F.col("n")).cast("int"))


def assign_learners(bag_ids: DataFrame, ranges: DataFrame, loss: str = "mix",
                    dist: str | None = None) -> DataFrame:
    """bag_id -> type where lo <= bag_id < hi (J10); ``ith`` = index inside
    the type; loss 'mix' -> odd ith FCE, even ICE (L8); name =
    type_loss[_dist] (P16).  The range condition becomes an equi-join: each
    type's range is exploded into its estimator ids (bounded by the number
    of estimators), so no nested-loop join is planned."""
    per_bag = (ranges.where(F.col("n") > 0)
               .select("type", "lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))
                       .alias("bag_id")))
    j = bag_ids.join(F.broadcast(per_bag), "bag_id")
    j = j.withColumn("ith", (F.col("bag_id") - F.col("lo")).cast("int"))
    if loss == "mix":
        lcol = F.when(F.col("ith") % 2 == 1, F.lit("FCE")).otherwise(F.lit("ICE"))
    else:
        lcol = F.lit(loss)
    j = j.withColumn("loss", lcol)
    parts = [F.col("type"), F.col("loss")] + ([F.lit(dist)] if dist else [])
    return j.select("bag_id", "type", "ith", "loss", F.concat_ws("_", *parts).alias("name"))


def model_name_from_path(path_col: str) -> F.Column:
    """Display name as the last path part (P16, second form)."""
    return F.element_at(F.split(F.col(path_col), "/"), -1)
