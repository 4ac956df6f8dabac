"""Losses over (prob, label).

Row losses are column expressions; the dataset loss is the mean of row
losses (= sum of batch means x batch sizes / n).  Inverse-frequency CE needs
batches: ``batch_id = (rank by id - 1) div batch_size`` with the exact
bucketed rank, and per-batch class counts -- a (batch, class) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.functions.arrays import EPS, ce_row, fce_row, prob_at, softmax
from bagwise.operators.strata import checked_broadcast, rank_by_number

LOSSES = ("CE", "FCE", "ICE")


def loss_column(name: str, prob="prob", label="label") -> Column:
    """Row loss builder by name (L7); ICE needs batches, see ``ice_rows``."""
    if name == "CE":
        return ce_row(prob, label)
    if name == "FCE":
        return fce_row(prob, label)
    raise ValueError(f"invalid loss type {name!r}")


def with_softmax(df: DataFrame, apply: bool, prob="prob") -> DataFrame:
    """Optional softmax of the input scores."""
    return df.withColumn(prob, softmax(prob)) if apply else df


def row_losses(df: DataFrame, name: str, prob="prob", label="label",
               weights: DataFrame | None = None, ignore_index: int | None = None,
               batch_size: int = 512, num_classes: int | None = None,
               by: Sequence[str] = ()) -> DataFrame:
    """Add ``loss`` per row (L1-L3, L5).  ``weights`` (label, weight) multiply
    the row loss; ``ignore_index`` zeroes that class's weight, only when
    weights are given (as in the reference)."""
    if name == "ICE":
        out = ice_rows(df, prob, label, batch_size, num_classes, by)
    else:
        out = df.withColumn("loss", loss_column(name, prob, label))
    if weights is not None:
        w = weights.select(F.col("label").alias(label), "weight")
        if ignore_index is not None:
            w = w.withColumn("weight", F.when(F.col(label) == ignore_index, 0.0)
                             .otherwise(F.col("weight")))
        out = out.join(checked_broadcast(w), label, "left") \
            .withColumn("loss", F.col("loss") * F.coalesce("weight", F.lit(0.0))).drop("weight")
    return out


def reduce_loss(rows: DataFrame, reduction: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """mean / sum / none."""
    if reduction == "none":
        return rows
    if reduction == "mean":
        return rows.groupBy(*by).agg(F.avg("loss").alias("loss"))
    if reduction == "sum":
        return rows.groupBy(*by).agg(F.sum("loss").alias("loss"))
    raise ValueError(f"unexpected reduction {reduction!r}")


def ice_rows(df: DataFrame, prob="prob", label="label", batch_size: int = 512,
             num_classes: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Inverse-frequency CE (L3, A13): in a batch, w_c = (1/(n_c+eps)) /
    sum_c'(1/(n_c'+eps)) * C; classes absent from the batch add 1/eps each to
    the sum.  Loss of a row = -w_y log(p_y + eps)."""
    if num_classes is None:
        num_classes = df.select(F.size(prob)).first()[0]
    out = ice_weights(df, label, batch_size, num_classes, by)
    return out.withColumn("loss", -(F.col("weight") * F.log(prob_at(prob, label) + F.lit(EPS)))) \
        .drop("weight")


def ice_weights(df: DataFrame, label="label", batch_size: int = 512,
                num_classes: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Add ``weight`` = the ICE class weight of the row's class in its batch
    (batches of ``batch_size`` rows in id order)."""
    by = list(by)
    ranked = rank_by_number(df, by, "id", rank_col="_rk")
    b = ranked.withColumn("batch_id", F.floor((F.col("_rk") - 1) / batch_size).cast("long")) \
        .drop("_rk")
    cnt = b.groupBy(*by, "batch_id", F.col(label).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"))
    inv = F.lit(1.0) / (F.col("_n").cast("double") + F.lit(EPS))
    per_batch = cnt.groupBy(*by, "batch_id").agg(
        F.sum(inv).alias("_s"), F.count(F.lit(1)).alias("_present"))
    # absent classes: (C - present) * 1/(0 + eps)
    denom = F.col("_s") + (F.lit(num_classes) - F.col("_present")).cast("double") / F.lit(EPS)
    w = cnt.join(per_batch, by + ["batch_id"]).select(
        *by, "batch_id", F.col("_y").alias(label),
        (inv / denom * F.lit(float(num_classes))).alias("_w"))
    # (batch, class)-sized weight table joined on the row's own class
    return b.join(w, by + ["batch_id", label], "inner").withColumnRenamed("_w", "weight")
