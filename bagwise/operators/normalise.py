"""Normalisation: codes, null fill, dedup, label dictionary (P1-P9, D2, D3,
W1, W6, J1, J2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagwise.functions.codes import (TEXT_COLS, clean_texts, fill_text, make_code,
                                     split_code)
from bagwise.operators.digests import first_rows
from bagwise.operators.strata import checked_broadcast

DEDUP6 = ("digit_1", "digit_2", "digit_3") + TEXT_COLS
DEDUP_CODE = ("digit",) + TEXT_COLS


def add_code(df: DataFrame) -> DataFrame:
    """digit = digit_1 + pad2(digit_2) + pad3(digit_3)."""
    return df.withColumn("digit", make_code())


def first_per_key(df: DataFrame, keys: Sequence[str], order_col: str = "id") -> DataFrame:
    """Keep the first row (lowest ``order_col``) of every key (W6, keep='first').

    Null keys compare equal, like pandas.  Narrow (digest, order) rows are
    aggregated map-side, so a hot key is reduced before the shuffle, and the
    rows meet the winners once (``digests.first_rows``)."""
    keys = list(keys)
    if [c for c in df.columns if c not in keys] == [order_col]:
        return df.groupBy(*keys).agg(F.min(order_col).alias(order_col)).select(*df.columns)
    return first_rows(df, keys, order_col)


def dedup_first6(df: DataFrame) -> DataFrame:
    """Dedup on the raw digits + texts, after null fill."""
    return first_per_key(df, DEDUP6)


def dedup_code4(df: DataFrame) -> DataFrame:
    """Dedup on code + texts, before null fill: null and '' differ (D3)."""
    return first_per_key(df, DEDUP_CODE)


def label_dim(df: DataFrame, code_col: str = "digit") -> DataFrame:
    """(label, digit): dense ids by sorted distinct code.

    The distinct codes are the class dimension (bounded by the number of
    classes); the rank runs on that small table only."""
    codes = df.select(F.col(code_col).alias("digit")).distinct()
    w = Window.orderBy("digit")
    return codes.select((F.row_number().over(w) - 1).cast("int").alias("label"), "digit")


def encode_labels(df: DataFrame, dim: DataFrame, code_col: str = "digit") -> DataFrame:
    """records join label dictionary on code."""
    d = checked_broadcast(dim.withColumnRenamed("digit", code_col))
    return df.join(d, on=code_col, how="inner")


def decode_labels(df: DataFrame, dim: DataFrame, label_col: str, out_col: str) -> DataFrame:
    """label id -> code (P9, J2); unknown ids give null."""
    d = checked_broadcast(dim.select(F.col("label").alias(label_col),
                                     F.col("digit").alias(out_col)))
    return df.join(d, on=label_col, how="left")


def code_parts(df: DataFrame, code_col: str = "digit") -> DataFrame:
    """Split a code back into digit_1/2/3 strings."""
    return df.select(*[c for c in df.columns if c not in ("digit_1", "digit_2", "digit_3")],
                     *split_code(code_col))


def normalise_records(df: DataFrame, clean_fn: Callable[[Column], Column] | None = None,
                      order: str = "preprocess") -> tuple[DataFrame, DataFrame]:
    """Records -> (labelled rows, label dim).

    order='preprocess': clean -> fill -> dedup6 -> code -> label (dataset flow).
    order='bagging':    code -> dedup(code+texts) -> fill -> label (bagging flow).
    """
    df = clean_texts(df, clean_fn)
    if order == "preprocess":
        df = add_code(dedup_first6(fill_text(df)))
    elif order == "bagging":
        df = fill_text(dedup_code4(add_code(df)))
    else:
        raise ValueError(f"unknown order {order!r}")
    dim = label_dim(df)
    return encode_labels(df, dim), dim
