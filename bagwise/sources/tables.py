"""Parquet tables (S8) and the adapter views that give them the record shape.

The adapter definitions are test inputs shared with the SQL oracle; they are
fixed, and written identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.functions.hashing import split_flag

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records_view(documents: DataFrame) -> DataFrame:
    """Labelled records from ``documents``: id, digit_1 STRING, digit_2 INT,
    digit_3 BIGINT, text_obj/mthd/deal (first line, second line and all the
    others; null if missing), so the fields hold the whole text."""
    lines = F.split(F.col("text"), "\n", 3)
    d2 = F.expr("cast(substring(source, 4) as int) % 5")
    base = documents.select(
        F.col("doc_id").alias("id"),
        F.upper(F.substring("lang", 1, 1)).alias("digit_1"),
        d2.alias("digit_2"),
        "lang", "n_chars",
        F.get(lines, 0).alias("text_obj"),
        F.get(lines, 1).alias("text_mthd"),
        F.get(lines, 2).alias("text_deal"))
    d3 = (F.when(F.col("lang") != "en", F.expr("n_chars % 100 div 10"))
          .when((F.col("digit_2") >= 3) & (F.col("n_chars") < 800), F.lit(101))
          .otherwise(F.lit(102))).cast("bigint")
    return base.select("id", "digit_1", "digit_2", d3.alias("digit_3"),
                       "text_obj", "text_mthd", "text_deal")


def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_view(read_table(spark, sf_dir, "documents"))


# Fixture parameters for the embeddings learners (fixed values, shared with the oracle)
EMB_SPLIT_SEED = 42
EMB_TRAIN_BELOW = 7          # split_flag % 10 < 7 -> train
EMB_MODELS = 4               # model m sees positions 16m .. 16m+15
EMB_SLICE = 16
EMB_SCALE = 8.0              # score = 8 * dot(v, centroid)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, label, vec ARRAY<DOUBLE>, split)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        F.when(split_flag(EMB_SPLIT_SEED, "vec_id") < EMB_TRAIN_BELOW, F.lit("train"))
        .otherwise(F.lit("test")).alias("split"))


def embedding_class_dim(rows: DataFrame) -> DataFrame:
    """(label, digit) for the embedding classes; codes sort like the labels."""
    lab = F.col("label")
    digit = F.concat(F.expr("char(65 + label)"),
                     F.lpad((lab * 3).cast("string"), 2, "0"),
                     F.lpad((lab * 17 + 100).cast("string"), 3, "0"))
    return rows.select("label").distinct().select("label", digit.alias("digit"))


def history_view(events: DataFrame) -> DataFrame:
    """Epoch-history stand-in: run = user_id, epoch = 0-based order of the
    run's events by (ts, event_id), loss = value, acc = props.k / 100.
    Ranked with the bucketed exact rank (buckets are ranges of the
    timestamp sized from the data), so a hot run is never one task."""
    from bagwise.operators.strata import rank_by_number
    if dict(events.dtypes)["ts"] == "timestamp_ntz":   # no session-zone conversion
        ts_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        ts_us = F.unix_micros(F.col("ts"))
    ev = events.select(F.col("user_id").alias("run"), ts_us.alias("ts_us"), "event_id",
                       F.col("value").alias("loss"),
                       (F.get_json_object("props", "$.k").cast("double") / 100).alias("acc"))
    ranked = rank_by_number(ev, ["run"], "ts_us", tie_cols=["event_id"], rank_col="rank")
    return ranked.select("run", (F.col("rank") - 1).alias("epoch"), "loss", "acc")
