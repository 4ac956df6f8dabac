"""Evaluation as declarative aggregation.

Scores over a fixed class dimension: absent classes count with 0 and enter
the macro means.  Extra grouping columns (``by``, e.g. model or epoch) give
one evaluation per group in the same job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by: Sequence[str] = (), label="label", pred_col="pred",
              loss_col: str | None = None) -> DataFrame:
    """Sparse confusion matrix (by..., label, pred, n [, loss_sum]) (A5)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if loss_col:
        aggs.append(F.sum(loss_col).alias("loss_sum"))
    return pred.groupBy(*by, F.col(label).alias("label"), F.col(pred_col).alias("pred")) \
        .agg(*aggs)


def class_list(classes: DataFrame) -> list[int]:
    """Labels of the class dimension (bounded by the number of classes)."""
    return sorted(r[0] for r in classes.select("label").distinct().collect())


def class_grid(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(groups..., label) for every class: the class list is exploded per
    group row, so absent classes get a row."""
    if groups is None:
        return classes.select("label").distinct()
    labels = F.array(*[F.lit(c) for c in class_list(classes)])
    return groups.withColumn("label", F.explode(labels))


def per_class(pred: DataFrame, classes: DataFrame, by: Sequence[str] = (),
              label="label", pred_col="pred", loss_col: str | None = None) -> DataFrame:
    """(by..., label, n_true, n_pred, tp, precision, recall, f1score [,
    loss_sum]) for every class of ``classes`` (A7, J4, J5); 0 where a
    denominator is 0."""
    cm = confusion(pred, by, label, pred_col, loss_col)
    return class_scores(cm, classes, by, bool(loss_col))


def class_scores(cm: DataFrame, classes: DataFrame, by: Sequence[str] = (), with_loss: bool = False) -> DataFrame:
    """``per_class`` of a confusion table (by..., label, pred, n [, loss_sum])."""
    by = list(by)
    true_aggs = [F.sum("n").alias("n_true"),
                 F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp")]
    if with_loss:
        true_aggs.append(F.sum("loss_sum").alias("loss_sum"))
    true = cm.groupBy(*by, "label").agg(*true_aggs)
    npred = cm.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    cls = class_grid(classes, cm.select(*by).distinct() if by else None)
    out = (cls.join(true, by + ["label"], "left").join(npred, by + ["label"], "left")
           .fillna(0, subset=["n_true", "n_pred", "tp"]))
    pc = F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    rc = F.when(F.col("n_true") == 0, 0.0).otherwise(F.col("tp") / F.col("n_true"))
    out = out.withColumn("precision", pc).withColumn("recall", rc)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1score", f1)


def macro(pred: DataFrame, classes: DataFrame, by: Sequence[str] = (),
          label="label", pred_col="pred", loss_col: str | None = None) -> DataFrame:
    """(by..., n, [loss], accuracy, precision, recall, f1score): accuracy =
    trace / total; macro scores are means over all classes; the loss is the
    mean row loss (A6, A8, A9).  Everything comes from one per-class table."""
    return macro_scores(per_class(pred, classes, by, label, pred_col, loss_col), by, bool(loss_col))


def macro_scores(pc: DataFrame, by: Sequence[str] = (), with_loss: bool = False) -> DataFrame:
    """``macro`` of a per-class table."""
    n = F.sum("n_true")
    aggs = [n.alias("n"), (F.sum("tp") / n).alias("accuracy")]
    if with_loss:
        aggs.append((F.sum("loss_sum") / n).alias("loss"))
    aggs += [F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
             F.avg("f1score").alias("f1score")]
    return pc.groupBy(*by).agg(*aggs)


class EvaluationState:
    """An evaluator saved as a table and merged from updates.

    An update writes the confusion counts and loss sums of one batch of
    predictions into the batch's own folder.  A repeated update replaces its
    folder, and the state is the sum over folders, so updates may come in any
    order, from any driver, and again after a failure."""

    def __init__(self, path: str, by: Sequence[str] = ()):
        self.path, self.by = path.rstrip("/"), list(by)

    def update(self, batch: str, pred: DataFrame, label="label", pred_col="pred", loss_col="loss") -> None:
        """Take in a batch of (by..., label, pred, loss) rows under its name."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"bad batch name {batch!r}")
        counted = confusion(pred, self.by, label, pred_col, loss_col)
        counted.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def merged(self, spark: SparkSession) -> DataFrame:
        """(by..., label, pred, n, loss_sum) over all batches taken in."""
        state = spark.read.parquet(self.path)
        return state.groupBy(*self.by, "label", "pred").agg(F.sum("n").alias("n"), F.sum("loss_sum").alias("loss_sum"))

    def scores(self, spark: SparkSession, classes: DataFrame) -> DataFrame:
        """As ``macro`` over all rows of all batches."""
        return macro_scores(class_scores(self.merged(spark), classes, self.by, True), self.by, True)


def rounded(df: DataFrame, cols: Sequence[str], places: int = 6) -> DataFrame:
    """Round metric columns for ranking / reports."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})
