"""Report tables.

All are small aggregates of the evaluation fact tables; wide layouts are
pivots over a known value list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.operators import metrics
from bagwise.operators.normalise import decode_labels

METRIC_COLS = ("loss", "accuracy", "precision", "recall", "f1score")


def epoch_summary(evals: DataFrame, classes: DataFrame, run: str = "run",
                  epoch: str = "epoch", split: str = "split",
                  splits: Sequence[str] = ("train", "valid")) -> DataFrame:
    """(run, epoch, train_loss, train_accuracy, ..., valid_f1score) from
    per-row evaluation facts (run, epoch, split, label, pred, loss) (O1)."""
    m = metrics.macro(evals, classes, by=[run, epoch, split], loss_col="loss")
    wide = m.groupBy(run, epoch).pivot(split, list(splits)).agg(
        *[F.first(c).alias(c) for c in METRIC_COLS])
    return wide


def class_epoch_pivot(evals: DataFrame, classes: DataFrame, metric: str = "f1score",
                      epochs: Sequence[int] = (), run: str = "run", epoch: str = "epoch",
                      split: str = "split", on_split: str = "valid",
                      counts_from_epoch: int = 0) -> DataFrame:
    """(run, label, digit, n_train, n_valid, epoch_0, epoch_1, ...) for one
    per-class metric on the validation rows (O2); counts come from one epoch's
    rows joined to the class dimension, missing classes -> 0 (J4)."""
    pc = metrics.per_class(evals.where(F.col(split) == on_split), classes, by=[run, epoch])
    wide = pc.groupBy(run, "label").pivot(epoch, list(epochs)).agg(F.first(metric))
    for e in epochs:
        wide = wide.withColumnRenamed(str(e), f"epoch_{e}")
    cnt = (evals.where(F.col(epoch) == counts_from_epoch)
           .groupBy(run, "label").pivot(split, ["train", "valid"]).agg(F.count(F.lit(1))))
    cnt = cnt.select(run, "label", F.coalesce("train", F.lit(0)).alias("n_train"),
                     F.coalesce("valid", F.lit(0)).alias("n_valid"))
    out = wide.join(cnt, [run, "label"], "left").fillna(0, subset=["n_train", "n_valid"])
    return decode_labels(out, classes, "label", "digit")


def test_summary(ens: DataFrame, base: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows 'mean', 'vote' (no loss) and one per base model (O3).

    ``ens``: (id, label, pred_mean, pred_vote, loss_mean); ``base``: (model,
    id, label, pred, loss)."""
    mean = metrics.macro(ens.withColumn("pred", F.col("pred_mean")), classes,
                         loss_col="loss_mean").withColumn("agg_fn", F.lit("mean"))
    vote = metrics.macro(ens.withColumn("pred", F.col("pred_vote")), classes) \
        .withColumn("loss", F.lit(None).cast("double")).withColumn("agg_fn", F.lit("vote"))
    per_model = metrics.macro(base, classes, by=["model"], loss_col="loss").withColumn(
        "agg_fn", F.concat(F.lit("model"), F.col("model").cast("string"))).drop("model")
    cols = ["agg_fn", F.col("loss").alias("test_loss"), "accuracy", "precision", "recall",
            "f1score"]
    return mean.select(*cols).unionByName(vote.select(*cols)).unionByName(per_model.select(*cols))


def per_class_result(ens: DataFrame, classes: DataFrame) -> DataFrame:
    """(agg_fn, class_id, class, n_test, precision, recall, f1score) for the
    mean and the vote ensemble (O4)."""
    out = None
    for fn in ("mean", "vote"):
        pc = metrics.per_class(ens.withColumn("pred", F.col(f"pred_{fn}")), classes)
        pc = decode_labels(pc, classes, "label", "class").select(
            F.lit(fn).alias("agg_fn"), F.col("label").alias("class_id"), "class",
            F.col("n_true").alias("n_test"), "precision", "recall", "f1score")
        out = pc if out is None else out.unionByName(pc)
    return out


def prediction_table(ens: DataFrame, classes: DataFrame, doc: str = "id") -> DataFrame:
    """(doc, category, pred_mean, pred_vote) with codes."""
    t = decode_labels(ens, classes, "label", "category")
    t = decode_labels(t, classes, "pred_mean", "_pm")
    t = decode_labels(t, classes, "pred_vote", "_pv")
    return t.select(F.col(doc).alias("doc"), "category", F.col("_pm").alias("pred_mean"),
                    F.col("_pv").alias("pred_vote"))


def submission(src: DataFrame, pred: DataFrame, classes: DataFrame,
               pred_col: str = "pred") -> DataFrame:
    """Source rows with digit_1/2/3 filled from the predicted code (M10, J6,
    P7, O7); rows without a prediction keep nulls."""
    coded = decode_labels(pred.select("id", F.col(pred_col).alias("label")), classes,
                          "label", "digit")
    parts = coded.select("id", F.substring("digit", 1, 1).alias("digit_1"),
                         F.substring("digit", 2, 2).alias("digit_2"),
                         F.expr("substring(digit, 4)").alias("digit_3"))
    keep = [c for c in src.columns if c not in ("digit_1", "digit_2", "digit_3")]
    return src.select(*keep).join(parts, "id", "left")
