"""Quality classifier from weak labels.

Heuristic labelers look at every document and fire, little or much, on one
kind of junk each; they overlap.  Expectation-maximisation over the counts of
equal firing patterns estimates how often each fires on good documents and on
each kind of bad ones, and so how likely each document is bad.  A linear scorer of hashed features (the
shapes of the words and the binned measures) is then trained on these
posteriors and judges every document; labels are not used.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import let, text_or_empty, words_of
from bagwise.llm.quality_rules import base_measures
from bagwise.llm.weak_labels import kinds
from bagwise.session import materialize

HASHED = 1 << 12
#: Hashed positions of the binned measures.
BINS = 1 << 9
#: The scorer is fitted on about this many documents, drawn by a hash of
#: doc_id and text, copies as one of their weight; labelers, EM and scores
#: cover all.
TRAIN_ROWS = 20_000
ITERATIONS = 30
PENALTY = 1e-4
ACCEPT = 0.5


#: Signs that prose has, beside letters, marks, digits and white space.
COMMON = ".,;:!?'\"()\\[\\]/%&\u2018\u2019\u201c\u201d\u00ab\u00bb\u00bf\u00a1\u2026\u2013\u2014-"
#: In a shaped text: a run of other signs, or a change between letters and digits.
ODD = f"[^\\p{{L}}\\p{{M}}\\p{{N}}\\s{COMMON}]+|[aA]9|9[aA]"


def shaped(text: Column) -> Column:
    """The text with runs of small letters as a, capitals as A, digits as 9."""
    for run, name in (("\\p{Ll}+", "a"), ("\\p{Lu}+", "A"), ("[0-9]+", "9")):
        text = F.regexp_replace(text, run, name)
    return text


def shapes(text: Column) -> Column:
    """The shapes of the words, and how many odd places they have."""
    mark = "\u0001"
    return let(shaped(text), lambda s: F.struct(
        words_of(s).alias("words"),
        count_of(F.regexp_replace(F.translate(s, mark, ""), ODD, mark), mark).alias("odd")))


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def chars_of(text: Column, pattern: str) -> Column:
    """Characters in matches of a pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def level(*marks: Column) -> Column:
    """How many of these, each implying the one before, hold."""
    return sum((F.when(m, 1).otherwise(0) for m in marks), F.lit(0))


def labelers() -> dict[str, Column]:
    """0 where the labeler does not fire, else 1 or, on much, 2 (evidence of
    junk).  What would be nested labelers are levels of one."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    # The bars of table cells have a labeler of their own.
    symbols = (F.col("n_symbols") - F.col("n_cells")) / n >= 0.3
    capitals = (F.col("n_upper") / letters >= 0.5) & (F.col("n_words") >= 8)
    shouts = F.col("n_shout") / n >= 0.2
    repeated = F.col("n_repeat_words") / n
    return {
        "symbols": level(symbols, symbols & (F.col("n_symbol_runs") / n >= 0.5)),
        "capitals": level(capitals | shouts, capitals & shouts),
        "cells": level(F.col("n_cells") / n >= 0.1),
        "repeats": level(repeated >= 0.3, repeated >= 0.5),
        "echoes": level(F.col("n_echo_words") / n >= 0.3),
        "dup_lines": level(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) >= 0.5),
        "odd_words": level((F.col("n_odd") / n >= 0.5) & (F.col("n_words") >= 8)),
    }


def share_bin(name: str, value: Column) -> Column:
    """A measure as a feature word: its share in tenths, 0 apart."""
    tenth = F.least(F.ceil(value * 10), F.lit(20)).cast("string")
    return F.concat(F.lit(f"#{name}:"), tenth)


def prints() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("print"), F.xxhash64(F.lit(7), "doc_id", "text").alias("print2")]


def observe(docs: DataFrame) -> DataFrame:
    """doc_id, prints, n_words, firings and hashed features of every row,
    kept in the checkpoint folder; the text is read once."""
    text = text_or_empty(F.col("text"))
    rows = docs.select(
        "doc_id", *prints(), base_measures(text, echoes=True).alias("m"), shapes(text).alias("s"),
        chars_of(text, "[#*$%&]{2,}").alias("n_symbol_runs"), chars_of(text, "\\p{Lu}+").alias("n_upper"),
        chars_of(text, "\\p{Ll}+").alias("n_lower"), count_of(text, "!!").alias("n_shout"),
        count_of(text, " | ").alias("n_cells")).select(
            "*", "m.*", F.col("s.words").alias("shapes"), F.col("s.odd").alias("n_odd")).drop("m", "s")
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    rows = rows.withColumn("bins", F.array(
        *[share_bin(k, F.col(k) / n) for k in ("n_symbols", "n_symbol_runs", "n_shout", "n_cells", "n_repeat_words",
                                               "n_echo_words", "n_odd")],
        share_bin("n_upper", F.col("n_upper") / letters), share_bin("n_dup_lines", F.col("n_dup_lines") / lines)))
    steps = [HashingTF(numFeatures=HASHED, inputCol="shapes", outputCol="tf"),
             Normalizer(inputCol="tf", outputCol="shape_share"),
             HashingTF(numFeatures=BINS, inputCol="bins", outputCol="binned"),
             VectorAssembler(inputCols=["shape_share", "binned"], outputCol="features")]
    hashed = rows
    for step in steps:
        hashed = step.transform(hashed)
    return materialize(hashed.select("doc_id", "print", "print2", "n_words", "features",
                                     *[v.alias(f"fires_{k}") for k, v in labelers().items()]))


def labelled(observed: DataFrame) -> DataFrame:
    """``observed`` with ``bad``, the labelers' posterior."""
    names = [c for c in observed.columns if c.startswith("fires_")]
    # At most as many patterns as the levels allow.
    counted = observed.where("n_words > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    posterior = kinds(sorted((tuple(r[c] for c in names), r["n"]) for r in counted))
    key = [F.lit(x) for votes, p in posterior.items() for x in ("".join(map(str, votes)), p)]
    if not key:
        return observed.withColumn("bad", F.lit(1.0))
    found = F.create_map(*key)[F.concat(*[F.col(c).cast("string") for c in names])]
    return observed.withColumn("bad", F.coalesce(found, F.lit(1.0)))


def training_rows(usable: DataFrame, rows: int) -> DataFrame:
    """(features, bad, copies) of the texts drawn by hash.  Rows of one doc_id
    and text are drawn together and stand as one with their number; where few
    texts have all rows, the draw is widened until it has one."""
    one_in = -(-rows // TRAIN_ROWS)
    while True:
        drawn = usable.where(F.pmod(F.xxhash64("print"), F.lit(one_in)) == 0)
        if one_in == 1 or not drawn.isEmpty():
            return drawn.groupBy("print", "print2").agg(F.first("features").alias("features"), F.first("bad").alias("bad"),
                                                        F.count(F.lit(1)).cast("double").alias("copies"))
        one_in //= 2


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, prints, n_words, weak_label (posterior that it is good), score
    and kept, one row per input row."""
    known = labelled(observe(docs))
    usable = known.where("n_words > 0")
    rows = usable.count()
    if not rows:
        return known.select("doc_id", "print", "print2", "n_words", F.lit(0.0).alias("weak_label"),
                            F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    train = materialize(training_rows(usable, rows).select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), ((1 - F.col("bad")) * F.col("copies")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("bad") * F.col("copies")).alias("weight")))).alias("x")).select(
            "features", "x.*"))
    model = LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, weightCol="weight").fit(train)
    judged = model.transform(known).withColumn("score", vector_to_array("probability")[1])
    score = F.when(F.col("n_words") > 0, F.col("score")).otherwise(F.lit(0.0))
    return judged.select("doc_id", "print", "print2", "n_words", (1 - F.col("bad")).alias("weak_label"),
                         score.alias("score"), (score >= ACCEPT).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, weak_label, score, kept.

    A document without words (null, empty or white space) is rejected with
    score 0.  Repeated rows get one verdict; doc_id may be null; an empty
    table gives an empty result; other columns are not read."""
    return scored(docs).select("doc_id", "n_words", "weak_label", "score", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with its columns.
    Equal (doc_id, text) get one verdict, so rows are found by their prints."""
    kept = scored(docs).where("kept").select("print", "print2").distinct().toDF("__print", "__print2")
    one, two = prints()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
                         one.alias("__print"), two.alias("__print2"))
    left = marked.join(kept, ["__print", "__print2"], "left_semi")
    return left.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
