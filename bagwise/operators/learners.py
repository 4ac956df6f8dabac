"""Base learners and scoring (M1-M6, M9).

``centroid`` is a pure DataFrame learner (class means of feature vectors,
scaled dot product, softmax); it is exactly reproducible in SQL and takes the
place of a base network in every checked query.  ``logreg``, ``naive_bayes``
and ``mlp`` are Spark ML estimators fitted per bag.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.functions.arrays import argmax, dot, let, softmax
from bagwise.operators.strata import checked_broadcast


def feature_slice(vec_col: str, model_col: str, width: int | None) -> F.Column:
    """The part of the feature vector a model sees: positions width*m .. +width-1."""
    if width is None:
        return F.col(vec_col)
    return F.slice(F.col(vec_col), F.col(model_col) * width + 1, width)


def fit_centroids(train: DataFrame, models: int | None = None, width: int | None = None,
                  model_col: str = "model", vec_col: str = "vec") -> DataFrame:
    """One centroid model per ``model`` (M3): rows (model, labels ARRAY<INT>,
    W ARRAY<ARRAY<DOUBLE>>).  ``train`` either has a ``model`` column (one
    bag per model) or, with ``models``, every row trains every model.

    Work is a map-side-combined avg per (model, label, pos); the result has
    models x classes x dims values, the size of the model, not of the data."""
    t = train
    if model_col not in t.columns:
        t = t.withColumn(model_col, F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    long = (t.select(model_col, "label",
                     F.posexplode(feature_slice(vec_col, model_col, width)).alias("pos", "v"))
            .groupBy(model_col, "label", "pos").agg(F.avg("v").alias("w")))
    per_class = (long.groupBy(model_col, "label")
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("_pw"))
                 .select(model_col, "label", F.col("_pw.w").alias("w")))
    return (per_class.groupBy(model_col)
            .agg(F.sort_array(F.collect_list(F.struct("label", "w"))).alias("_lw"))
            .select(model_col, F.col("_lw.label").alias("labels"), F.col("_lw.w").alias("W")))


def score_centroids(docs: DataFrame, model_table: DataFrame, scale: float = 1.0,
                    width: int | None = None, model_col: str = "model",
                    vec_col: str = "vec", keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """Every doc scored by every model, long form (M6, M7): (model, keep...,
    prob ARRAY<DOUBLE>) with prob[i] for class labels[i]; labels are 0..C-1."""
    return scores_long(score_wide(docs, model_table, scale, width, model_col, vec_col, keep), model_col, keep)


def scores_long(wide: DataFrame, model_col: str = "model", keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """(model, keep..., prob), a row per model, of ``score_wide`` rows."""
    return wide.select(*keep, F.explode("scores").alias("_m")).select(
        F.col(f"_m.{model_col}").alias(model_col), *keep, F.col("_m.prob").alias("prob"))


def score_wide(docs: DataFrame, model_table: DataFrame, scale: float = 1.0,
               width: int | None = None, model_col: str = "model",
               vec_col: str = "vec", keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """(keep..., scores ARRAY<STRUCT<model, prob>> in model order): all models
    of a document in its row, so ensembles need no shuffle.

    The models become one row (model-sized) that is broadcast after a size
    check; the docs side is never shuffled."""
    # The key is 0 on both sides, worked out from a column: a hash join with
    # one broadcast row, where a constant key would become a nested loop.
    table = model_table.agg(F.sort_array(F.collect_list(F.struct(model_col, "W"))).alias("_models"),
                            F.min(F.pmod(F.col(model_col).cast("long"), F.lit(1))).alias("_zero"))
    d = docs.withColumn("_zero", F.pmod(F.xxhash64("id"), F.lit(1))).join(
        checked_broadcast(table), "_zero")

    def part(m) -> F.Column:
        whole = F.col(vec_col)
        return whole if width is None else F.slice(whole, m[model_col] * width + 1, width)

    def prob(m) -> F.Column:
        return let(part(m), lambda v: let(
            F.transform(m["W"], lambda w: F.lit(scale) * dot(v, w)), softmax))

    scores = F.transform("_models", lambda m: F.struct(
        m[model_col].alias(model_col), prob(m).alias("prob")))
    return d.select(*keep, scores.alias("scores"))


def predict_mean(docs: DataFrame, model_table: DataFrame, scale: float = 1.0, places: int = 9) -> DataFrame:
    """(id, pred) of (id, vec): the class of the highest mean probability of
    all models, the lowest class of equal ones; a row without a vector gets
    none.  Equal to ``score_wide`` and ``mean_ensemble``, but a row's
    probabilities are never kept: they are many times its features.

    Only the models, which are models x classes x dims, reach the driver."""
    import numpy as np
    import pyarrow as pa

    weights = [np.array(r["W"]) for r in model_table.orderBy("model").collect()]
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("vec")
            known = b.filter(b.column(at).is_valid())
            if not known.num_rows:
                continue
            vecs = known.column(at).flatten().to_numpy(zero_copy_only=False).reshape(known.num_rows, -1)
            mean = 0.0
            for w in weights:
                s = scale * (vecs @ w.T)
                e = np.exp(s - s.max(axis=1, keepdims=True))
                mean = mean + e / e.sum(axis=1, keepdims=True) / len(weights)
            pred = np.round(mean, places).argmax(axis=1).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [known.column(known.schema.get_field_index("id")), pa.array(pred)], names=["id", "pred"])

    return docs.select("id", "vec").mapInArrow(run, f"id {kind}, pred int")


def predict(scored: DataFrame, places: int = 9) -> DataFrame:
    """Add ``pred`` = argmax of the probabilities rounded to ``places``."""
    return scored.withColumn("pred", argmax("prob", places))


# ------------------------------------------------------------ Spark ML learners

LEARNERS = ("centroid", "logreg", "naive_bayes", "mlp")


def make_learner(kind: str, num_features: int, num_classes: int, hidden: Sequence[int] = (),
                 max_iter: int = 50, seed: int = 42):
    """Learner registry (M1, M4); an unknown name raises."""
    from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                           NaiveBayes)
    if kind == "logreg":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                                  family="multinomial")
    if kind == "naive_bayes":
        return NaiveBayes(featuresCol="features", labelCol="label", modelType="multinomial")
    if kind == "mlp":
        layers = [num_features, *hidden, num_classes]
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                              layers=layers, maxIter=max_iter, seed=seed)
    raise ValueError(f"unknown learner {kind!r}")


def to_features(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.col(vec_col)))


def fit_per_bag(bags: DataFrame, assignment: Sequence[tuple[int, str]], num_features: int,
                num_classes: int, parallelism: int = 4, **kw) -> dict:
    """Fit one Spark ML learner per bag (M2); fits are independent Spark jobs
    submitted from a small thread pool.  ``assignment`` = [(bag_id, kind)]."""
    feats = to_features(bags)

    def fit(item):
        bag_id, kind = item
        est = make_learner(kind, num_features, num_classes, **kw)
        return bag_id, est.fit(feats.where(F.col("bag_id") == bag_id))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return dict(pool.map(fit, assignment))


def score_ml(models: dict, docs: DataFrame, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """Score docs with every fitted Spark ML model -> (model, keep..., prob)."""
    from pyspark.ml.functions import vector_to_array
    feats = to_features(docs)
    outs = []
    for bag_id, m in sorted(models.items()):
        outs.append(m.transform(feats).select(
            F.lit(bag_id).alias("model"), *keep,
            vector_to_array("probability").alias("prob")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
