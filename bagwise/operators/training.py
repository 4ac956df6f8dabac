"""Gradient-trained softmax head.

A linear head z = W x + b over feature arrays, trained by full-batch
gradient descent with a selectable loss (CE, FCE, ICE), gradient norm
clipped to 1, per-epoch train/valid metrics, early stopping with patience
and the best state kept by validation loss.

Per epoch: one ``mapInPandas`` job computes partial gradients of every
partition (vectorised numpy over Arrow batches); they are summed by a
map-side-combined aggregation keyed by parameter position, so only
model-sized arrays (classes x (dims+1)) reach the driver, which applies
the step.  Evaluation reuses the declarative metric operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagwise.functions.arrays import EPS
from bagwise.operators import metrics
from bagwise.operators.losses import ice_weights


@dataclass
class Head:
    W: np.ndarray            # (C, d)
    b: np.ndarray            # (C,)
    best_epoch: int
    history: DataFrame       # (run, epoch, split, loss, accuracy, precision, recall, f1score)


def _grad_fn(bc, loss: str, gamma: float, C: int, d: int, vec: str, label: str):
    def fn(batches):
        W, b = bc.value
        g = np.zeros((C, d + 1))
        n, tot = 0, 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            y = pdf[label].to_numpy().astype(np.int64)
            w = pdf["weight"].to_numpy() if "weight" in pdf else np.ones(len(y))
            z = X @ W.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            py = p[np.arange(len(y)), y]
            logp = np.log(py + EPS)
            if loss == "FCE":
                row = -((1 - py) ** gamma) * logp
                coef = gamma * py * (1 - py) ** (gamma - 1) * logp - (1 - py) ** gamma
            else:   # CE and ICE (ICE = CE weighted by the batch class weight)
                row = -logp
                coef = -np.ones(len(y))
            onehot = np.zeros_like(p)
            onehot[np.arange(len(y)), y] = 1.0
            gz = (coef * w)[:, None] * (onehot - p)          # dL/dz
            g[:, :d] += gz.T @ X
            g[:, d] += gz.sum(axis=0)
            n += len(y)
            tot += float((row * w).sum())
        if n:   # positions -1 / -2 carry the row count and the loss sum
            yield pd.DataFrame({"pos": np.arange(-2, C * (d + 1), dtype=np.int64),
                                "g": np.concatenate([[tot, n], g.ravel()])})
    return fn


def _score_fn(bc, vec: str, label: str):
    def fn(batches):
        W, b = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            z = X @ W.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            yield pdf.drop(columns=vec).assign(prob=list(p))
    return fn


def score_head(df: DataFrame, W: np.ndarray, b: np.ndarray, vec: str = "vec",
               label: str = "label") -> DataFrame:
    """(id, label, prob), and the row's weight if it has one, with the head
    broadcast once per job.  ``id`` keeps its type."""
    bc = df.sparkSession.sparkContext.broadcast((W, b))
    kinds = dict(df.dtypes)
    keep = ["id", label] + [c for c in df.columns if c == "weight"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", prob array<double>"
    return df.select(*keep, vec).mapInPandas(_score_fn(bc, vec, label), schema)


def train_head(train: DataFrame, valid: DataFrame, classes: DataFrame, num_classes: int,
               dim: int, loss: str = "CE", epochs: int = 100, lr: float = 0.5,
               patience: int = 5, mode: str = "<=", clip: float = 1.0, gamma: float = 2.0,
               batch_size: int = 512, vec: str = "vec", label: str = "label",
               run: str = "head") -> Head:
    """Train and evaluate the head; stops when ``patience`` epochs pass
    without improvement of the validation loss (mode '<=' or '<')."""
    if loss not in ("CE", "FCE", "ICE"):
        raise ValueError(f"invalid loss type {loss!r}")
    spark = train.sparkSession
    cols = ["id", vec, label]
    tr = train.select(*cols)
    if loss == "ICE":
        tr = ice_weights(tr, label, batch_size, num_classes)
        valid = ice_weights(valid.select(*cols), label, batch_size, num_classes)
    tr, valid = tr.cache(), valid.cache()
    C, d = num_classes, dim
    W, b = np.zeros((C, d)), np.zeros(C)
    best = (None, None, W.copy(), b.copy())      # (loss, epoch, W, b)
    hist_rows, since = [], 0
    schema = "pos long, g double"
    for epoch in range(epochs):
        bc = spark.sparkContext.broadcast((W, b))
        parts = tr.mapInPandas(_grad_fn(bc, loss, gamma, C, d, vec, label), schema)
        agg = parts.groupBy("pos").agg(F.sum("g").alias("g")).orderBy("pos").collect()
        bc.unpersist()
        vals = np.array([r.g for r in agg])       # model-sized
        n = vals[1] or 1.0
        G = vals[2:].reshape(C, d + 1) / n
        norm = float(np.sqrt((G ** 2).sum()))
        if norm > clip:
            G *= clip / (norm + 1e-6)
        W = W - lr * G[:, :d]
        b = b - lr * G[:, d]
        ev = None
        for split, df in (("train", tr), ("valid", valid)):
            sc = score_head(df, W, b, vec, label)
            from bagwise.functions.arrays import argmax, ce_row, fce_row
            # the criterion of the training also picks the best epoch
            row_loss = fce_row("prob", label, 1.0, gamma) if loss == "FCE" else ce_row("prob", label)
            if loss == "ICE":
                row_loss = row_loss * F.col("weight")
            sc = sc.withColumn("pred", argmax("prob")).withColumn("loss", row_loss) \
                .withColumn("split", F.lit(split))
            ev = sc if ev is None else ev.unionByName(sc)
        m = metrics.macro(ev, classes, by=["split"], label=label, loss_col="loss").collect()
        for r in m:
            hist_rows.append((run, epoch, r.split, float(r.loss), float(r.accuracy),
                              float(r.precision), float(r.recall), float(r.f1score)))
        vloss = next(float(r.loss) for r in m if r.split == "valid")
        improved = best[0] is None or (vloss <= best[0] if mode == "<=" else vloss < best[0])
        if improved:
            best, since = (vloss, epoch, W.copy(), b.copy()), 0
        else:
            since += 1
            if since >= patience:
                break
    tr.unpersist()
    valid.unpersist()
    hist = spark.createDataFrame(hist_rows, "run string, epoch int, split string, loss double, "
                                            "accuracy double, precision double, recall double, "
                                            "f1score double")
    return Head(best[2], best[3], best[1], hist)


def save_head(spark, head: Head, path: str) -> None:
    """Write the best state (M9) as a model-sized Parquet table."""
    head_table(spark, head).coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) of a saved head, for ``score_head``; a row per class."""
    rows = spark.read.parquet(path).orderBy("label").collect()
    return np.array([r["w"] for r in rows]), np.array([r["b"] for r in rows])


def head_table(spark, head: Head) -> DataFrame:
    """(label, w ARRAY<DOUBLE>, b) of a trained head (model-sized)."""
    return spark.createDataFrame([(c, [float(v) for v in head.W[c]], float(head.b[c]))
                                  for c in range(head.W.shape[0])],
                                 "label int, w array<double>, b double")
