"""Epoch histories: running best, improvement flags, patience and early
stop, best epochs (W3, W4, A14, O6).

Runs are ordered by a dense 0-based ``epoch``.  Running aggregates are
computed per (run, epoch bucket) with a small per-bucket prefix table, so a
run with very many epochs is never one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_EPOCHS = 100_000


def running_before(df: DataFrame, by: str, order: str, value: str, fn: str, out: str,
                   inclusive: bool = False, width: int = BUCKET_EPOCHS) -> DataFrame:
    """``out`` = fn(value) over the rows of ``by`` with order < current
    (or <= with ``inclusive``); fn in {'min', 'max'}."""
    agg = {"min": F.min, "max": F.max}[fn]
    comb = {"min": F.least, "max": F.greatest}[fn]
    b = df.withColumn("_b", F.floor(F.col(order) / width).cast("long"))
    per = b.groupBy(by, "_b").agg(agg(value).alias("_v"))
    wp = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per.select(by, "_b", agg("_v").over(wp).alias("_pre"))
    end = 0 if inclusive else -1
    wi = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    inner = b.withColumn("_in", agg(value).over(wi))
    return (inner.join(prefix, [by, "_b"])
            .withColumn(out, comb(F.col("_pre"), F.col("_in")))  # least/greatest skip nulls
            .drop("_b", "_pre", "_in"))


def improvement(hist: DataFrame, mode: str = "<=", run: str = "run", epoch: str = "epoch",
                loss: str = "loss") -> DataFrame:
    """Running best validation loss before each epoch and the ``improved``
    flag (W3): '<=' as in bagging, '<' as in single-model training."""
    if mode not in ("<=", "<"):
        raise ValueError(f"unknown mode {mode!r}")
    h = running_before(hist, run, epoch, loss, "min", "best_before")
    better = (F.col(loss) <= F.col("best_before")) if mode == "<=" else \
        (F.col(loss) < F.col("best_before"))
    return h.withColumn("improved", F.col("best_before").isNull() | better)


def early_stop(hist: DataFrame, patience: int, mode: str = "<=", run: str = "run",
               epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Per run: stop_epoch (first epoch whose counter reaches ``patience``,
    null if none), epochs_run, best_epoch (last improvement up to the stop)
    and its loss (W4).  counter = epoch - last improved epoch."""
    h = improvement(hist, mode, run, epoch, loss)
    h = h.withColumn("_imp_epoch", F.when(F.col("improved"), F.col(epoch)))
    h = running_before(h, run, epoch, "_imp_epoch", "max", "_last_imp", inclusive=True)
    h = h.withColumn("counter", F.col(epoch) - F.col("_last_imp"))
    stop = h.where(F.col("counter") >= patience).groupBy(run).agg(
        F.min(epoch).alias("stop_epoch"))
    kept = h.join(stop, run, "left").where(
        F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(
        F.first("stop_epoch", ignorenulls=True).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
        F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
        F.max_by(F.col(loss), F.when(F.col("improved"), F.col(epoch))).alias("best_loss"))


def best_epochs(hist: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss",
                acc: str = "acc") -> DataFrame:
    """Epoch of the lowest loss and of the highest accuracy, first
    occurrence on ties (A14, O6); map-side combinable min_by."""
    return hist.groupBy(run).agg(
        F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch))).alias("best_loss_epoch"),
        F.min(loss).alias("best_loss"),
        F.min_by(F.col(epoch), F.struct(-F.col(acc), F.col(epoch))).alias("best_acc_epoch"),
        F.max(acc).alias("best_acc"))
