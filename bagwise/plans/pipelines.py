"""End-to-end data preparation.

Both return DataFrames plus the label dimension; nothing is a Python list
of frames: bags are one DataFrame keyed by ``bag_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.functions.codes import TEXT_COLS, concat_text
from bagwise.operators import normalise, resample
from bagwise.session import materialize


@dataclass
class Prepared:
    train: DataFrame      # (label, text [, bag_id, draw])
    test: DataFrame       # (label, text [, id])
    dim: DataFrame        # (label, digit)


def preprocess(records: DataFrame, num_test: int = 100_000, upsample: str = "",
               minimum: int = 500, clean_fn: Callable[[Column], Column] | None = None,
               seed: int = 42) -> Prepared:
    """clean -> fill -> dedup6 -> code -> label -> split -> upsample train ->
    text (R14)."""
    lab, dim = normalise.normalise_records(records, clean_fn, order="preprocess")
    lab = materialize(lab)          # read by the class histogram and by the rank
    sp = materialize(resample.stratified_split(lab, num_test=num_test, seed=seed))
    train = sp.where(F.col("split") == "train")
    test = sp.where(F.col("split") == "test")
    train = resample.upsample(train, upsample, minimum, seed)
    return Prepared(train.select("id", "draw", "label", concat_text().alias("text")),
                    test.select("id", "label", concat_text().alias("text")), dim)


@dataclass
class Bagged:
    bags: DataFrame       # (bag_id, part in train/valid, label, text, id, draw)
    test: DataFrame       # (id, label, text, source)
    dim: DataFrame


def bagging(records: DataFrame, num_test: int, estimators: int, num_samples: int | None,
            num_sub_valid: int, dist: str = "same", upsample: str = "",
            minimum: int = 500, min_cat_data: int = 2, seed: int = 42,
            split_seed: int = 5986, add_oob: bool = True) -> Bagged:
    """code -> dedup(code+texts) -> fill -> label -> split -> bags + OOB ->
    per-bag split (num_sub_valid / bag rows) -> per-bag upsample -> text
    (R15).  Per-bag steps use (bag_id, label) as the stratum.
    ``num_samples=None`` requests half of the training rows."""
    lab, dim = normalise.normalise_records(records, order="bagging")
    lab = materialize(lab)          # read by the class histogram and by the rank
    sp = materialize(resample.stratified_split(lab, num_test=num_test, seed=split_seed))
    cols = ["id", "label", *TEXT_COLS]
    train = sp.where(F.col("split") == "train").select(*cols)
    test = sp.where(F.col("split") == "test").select(*cols)
    if num_samples is None:
        num_samples = train.count() // 2
    if dist == "same":
        bags = resample.bag_same(train, estimators, num_samples, min_cat_data, seed)
    elif dist == "random":
        bags = resample.bag_random(train, estimators, num_samples, min_cat_data, seed)
    else:
        raise ValueError(f"unknown sample distribution {dist!r}")
    bags = materialize(bags)
    if add_oob:
        test = resample.test_plus_oob(test, resample.oob_by_id(train, bags))
    else:
        test = test.withColumn("source", F.lit("test"))
    parts = materialize(resample.stratified_split(bags, num_test=num_sub_valid, seed=seed,
                                                  strata=("bag_id", "label")))
    valid = parts.where(F.col("split") == "test").select(
        "bag_id", "label", "id", *TEXT_COLS).withColumn("draw", F.lit(0))
    sub_train = resample.upsample(parts.where(F.col("split") == "train"), upsample, minimum,
                                  seed, strata=("bag_id", "label"))
    out = (sub_train.withColumn("part", F.lit("train"))
           .unionByName(valid.withColumn("part", F.lit("valid"))))
    return Bagged(out.select("bag_id", "part", "id", "draw", "label",
                             concat_text().alias("text")),
                  test.select("id", "label", concat_text().alias("text"), "source"), dim)
