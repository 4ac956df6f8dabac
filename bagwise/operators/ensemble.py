"""Ensembles of base-model probabilities.

Input is either the wide prediction table (keys..., scores of all models),
which needs no shuffle, or the long one (model, keys..., prob ARRAY<DOUBLE>),
whose models are gathered by one shuffle on the keys (a group is bounded by
the number of models)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.functions.arrays import argmax, class_counts, elementwise_mean


def gather_models(preds: DataFrame, keys=("id", "label")) -> DataFrame:
    """(keys..., probs ARRAY<ARRAY<DOUBLE>>) ordered by model."""
    if "scores" in preds.columns:
        return preds.select(*keys, F.col("scores.prob").alias("probs"))
    return (preds.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("model", "prob"))).alias("_mp"))
            .select(*keys, F.col("_mp.prob").alias("probs")))


def mean_ensemble(preds: DataFrame, keys=("id", "label"), places: int = 9) -> DataFrame:
    """Mean probability over models, argmax."""
    g = gather_models(preds, keys)
    return g.select(*keys, elementwise_mean("probs").alias("prob")) \
        .withColumn("pred", argmax("prob", places))


def vote_ensemble(preds: DataFrame, keys=("id", "label"), places: int = 9) -> DataFrame:
    """Majority vote of the models' argmax; ties -> lowest class."""
    g = gather_models(preds, keys)
    votes = F.transform("probs", lambda p: argmax(p, places))
    counts = class_counts(votes, F.size(F.element_at("probs", 1)))
    return g.select(*keys, counts.alias("votes")).withColumn("pred", argmax("votes", None))


def mean_and_vote(preds: DataFrame, keys=("id", "label"), places: int = 9) -> DataFrame:
    """Both ensembles from one gather: (keys..., prob_mean, pred_mean, pred_vote)."""
    g = gather_models(preds, keys)
    votes = F.transform("probs", lambda p: argmax(p, places))
    counts = class_counts(votes, F.size(F.element_at("probs", 1)))
    return g.select(*keys, elementwise_mean("probs").alias("prob_mean"),
                    counts.alias("votes")) \
        .withColumn("pred_mean", argmax("prob_mean", places)) \
        .withColumn("pred_vote", argmax("votes", None)).drop("votes")
