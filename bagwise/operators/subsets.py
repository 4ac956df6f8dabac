"""Ensemble subset search.

All 2^k - 1 model subsets are scored with the mean ensemble.  Scoring is a
``mapInPandas`` over documents that hold every model's probabilities: each
task walks the subset tree depth-first (a subset's sum = its parent's sum +
one model, so only k partial sums are alive) and adds up, over its whole
partition, true, predicted and correct counts per (subset, class) -- arrays
of 2^k x classes -- which it emits once; Spark sums them.  Documents x subsets rows are
never materialised.

If these arrays outgrow TASK_BYTES, the tree is cut below its first models as
well: a task then takes a partition of documents and the subsets that agree on
these (a block of the document x subset grid), and holds that block's counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.functions.constants import TOP_K, W_ACC
from bagwise.operators.metrics import class_grid

MAX_MODELS = 20


def subset_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(mask, size, subset): names sorted, joined by '|' (C1)."""
    names = sorted(names)
    k = len(names)
    if not 0 < k <= MAX_MODELS:
        raise ValueError(f"subset search supports 1..{MAX_MODELS} models")
    arr = F.array(*[F.lit(n) for n in names])
    t = spark.range(1, 2 ** k).withColumnRenamed("id", "mask")
    chosen = F.expr(f"filter(sequence(0, {k - 1}), i -> ((mask >> i) & 1) = 1)")
    return t.select("mask", F.size(chosen).cast("long").alias("size"),
                    F.array_join(F.transform(chosen, lambda i: F.element_at(arr, i + 1)),
                                 "|").alias("subset"))


# documents whose partial sums are alive at a time
SUBSET_DOCS = 2_000


# counts that a task of the subset search may hold
TASK_BYTES = 256 << 20


def fixed_models(k: int, n_classes: int, task_bytes: int = TASK_BYTES) -> int:
    """How many models to fix so that 2 x 2^(k - fixed) x classes longs fit."""
    fixed = 0
    while fixed < k and 16 * (1 << (k - fixed)) * n_classes > task_bytes:
        fixed += 1
    return fixed


def _subset_counts(k: int, places: int, fixed: int = 0, prefix: int = 0):
    """Counts of the subsets whose first ``fixed`` models are those of the
    bits of ``prefix``."""
    chosen = [m for m in range(fixed) if prefix >> m & 1]

    def fn(batches):
        n_true = n_pred = tp = None
        for pdf in batches:
            for at in range(0, len(pdf), SUBSET_DOCS):
                part = pdf.iloc[at:at + SUBSET_DOCS]
                P = np.stack([np.stack(x) for x in part["probs"].to_numpy()])  # (B, k, C)
                y = part["label"].to_numpy().astype(np.int64)
                B, _, C = P.shape
                if tp is None:
                    n_true = np.zeros(C, dtype=np.int64)
                    n_pred, tp = (np.zeros((1 << (k - fixed), C), dtype=np.int64) for _ in range(2))
                n_true += np.bincount(y, minlength=C)

                def count(at, s, size):
                    pred = np.round(s / size, places).argmax(axis=1)   # first maximum
                    n_pred[at] += np.bincount(pred, minlength=C)
                    tp[at] += np.bincount(y[pred == y], minlength=C)

                def visit(start, at, acc, size):
                    for m in range(start, k):
                        s = acc + P[:, m, :]
                        count(at | 1 << (m - fixed), s, size + 1)
                        visit(m + 1, at | 1 << (m - fixed), s, size + 1)

                acc = np.zeros((B, C))
                for m in chosen:
                    acc = acc + P[:, m, :]
                if chosen:
                    count(0, acc, len(chosen))
                visit(fixed, 0, acc, len(chosen))
        if tp is not None:
            for first in range(0, len(tp), 1024):
                at, label = np.nonzero(n_pred[first:first + 1024])
                yield pd.DataFrame({"mask": (at + first) << fixed | prefix, "label": label.astype(np.int32),
                                    "n_true": 0, "n_pred": n_pred[at + first, label], "tp": tp[at + first, label]})
            if not prefix:      # the empty subset, mask 0, carries the true counts
                label = np.flatnonzero(n_true)
                yield pd.DataFrame({"mask": 0, "label": label.astype(np.int32), "n_true": n_true[label],
                                    "n_pred": 0, "tp": 0})
    return fn


def subset_counts(gathered: DataFrame, k: int, places: int = 9, fixed: int = 0) -> DataFrame:
    """(mask, label, n_true, n_pred, tp) over all subsets, n_true under mask 0;
    ``gathered`` has (label, probs ARRAY<ARRAY<DOUBLE>>) with models in
    sorted-name order (C2, J9).  A task holds 2 x 2^(k - ``fixed``) x classes
    counts, and ``gathered`` is read 2^``fixed`` times."""
    rows = gathered.select("label", "probs")
    blocks = [rows.mapInPandas(_subset_counts(k, places, fixed, prefix),
                               "mask long, label int, n_true long, n_pred long, tp long")
              for prefix in range(1 << fixed)]
    counts = reduce(DataFrame.unionAll, blocks)
    return counts.groupBy("mask", "label").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])


def subset_metrics(gathered: DataFrame, names: Sequence[str], classes: DataFrame,
                   places: int = 9) -> DataFrame:
    """(subset, size, accuracy, precision, recall, f1score) per subset."""
    spark = gathered.sparkSession
    k = len(names)
    from bagwise.session import materialize
    fixed = fixed_models(k, classes.count())
    counts = materialize(subset_counts(materialize(gathered) if fixed else gathered, k, places, fixed))
    found = counts.where(F.col("mask") > 0).drop("n_true")
    true = counts.where(F.col("mask") == 0).select("label", "n_true")
    tot = found.groupBy("mask").agg((F.sum("tp") / F.sum("n_pred")).alias("accuracy"))
    subs = subset_table(spark, names)
    grid = class_grid(classes, subs.select("mask"))
    pc = (grid.join(found, ["mask", "label"], "left").join(true, "label", "left")
          .fillna(0, subset=["n_true", "tp", "n_pred"]))
    p = F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    r = F.when(F.col("n_true") == 0, 0.0).otherwise(F.col("tp") / F.col("n_true"))
    pc = pc.withColumn("p", p).withColumn("r", r).withColumn(
        "f", F.when(F.col("p") + F.col("r") == 0, 0.0)
        .otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))
    macro = pc.groupBy("mask").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"),
                                   F.avg("f").alias("f1score"))
    return (subs.join(tot, "mask").join(macro, "mask")
            .select("subset", "size", "accuracy", "precision", "recall", "f1score"))


def top_subsets(metrics: DataFrame, by: str = "accuracy", k: int = TOP_K,
                w_acc: float = W_ACC) -> DataFrame:
    """Top-k subsets by rounded score, name descending on ties (C3, T3-T5);
    by = 'accuracy', 'f1score' or 'weighted' (0.6 acc + 0.4 f1, P15)."""
    if by == "weighted":
        score = F.col("accuracy") * w_acc + F.col("f1score") * (1 - w_acc)
    else:
        score = F.col(by)
    return (metrics.select("subset", F.round(score, 6).alias("score"))
            .orderBy(F.desc("score"), F.desc("subset")).limit(k))


def per_type_pool(preds: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """Model weights of the 'n per type' pool (C4): every n-subset inside
    each type (name up to '_') adds its members to one mean, so a model of a
    type with k_t models counts C(k_t - 1, n - 1) times.  Returns (model,
    weight); types with fewer than n models add nothing."""
    from math import comb
    typed = names.withColumn("type", F.split(F.col("name"), "_")[0])
    sizes = typed.groupBy("type").agg(F.count(F.lit(1)).alias("k_t"))
    rows = [(r["type"], comb(r["k_t"] - 1, n - 1) if r["k_t"] >= n else 0)
            for r in sizes.collect()]          # one row per model type
    spark = preds.sparkSession
    w = spark.createDataFrame(rows, "type string, weight long")
    return typed.join(F.broadcast(w), "type").select("model", "weight")


def weighted_mean_ensemble(preds: DataFrame, weights: DataFrame, places: int = 9,
                           keys=("id", "label")) -> DataFrame:
    """sum_m w_m p_m / sum_m w_m per document, argmax (C4)."""
    from bagwise.functions.arrays import argmax
    p = preds.join(F.broadcast(weights), "model").where(F.col("weight") > 0)
    g = (p.groupBy(*keys).agg(F.collect_list(F.struct("weight", "prob")).alias("_wp")))
    # one pass: weighted sums and total weight in the accumulator, divided in
    # the finish step (a row-level total inside the per-class lambda would be
    # recomputed for every class)
    init = F.struct(F.array_repeat(F.lit(0.0), F.size(F.element_at("_wp", 1).prob)).alias("s"),
                    F.lit(0.0).alias("w"))
    step = lambda acc, x: F.struct(
        F.zip_with(acc["s"], x.prob, lambda a, b: a + b * x.weight).alias("s"),
        (acc["w"] + x.weight).alias("w"))
    prob = F.aggregate("_wp", init, step,
                       lambda acc: F.transform(acc["s"], lambda v: v / acc["w"]))
    return g.select(*keys, prob.alias("prob")).withColumn("pred", argmax("prob", places))
