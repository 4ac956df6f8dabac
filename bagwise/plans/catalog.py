"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each runs the library operators over the whole supplied tables (through the
adapter views of ``sources.tables``) with the fixed parameters of
``plans.params``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.functions.codes import TEXT_COLS, concat_text, default_clean, fill_text
from bagwise.functions.hashing import uniform
from bagwise.operators import audit, normalise, resample
from bagwise.plans import params as P
from bagwise.session import ensure_checkpoint_dir, materialize
from bagwise.sources.tables import read_records

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ------------------------------------------------------------ shared inputs

def labelled(spark, sf):
    lab, dim = normalise.normalise_records(read_records(spark, sf))
    return materialize(lab), dim


def split_rows(spark, sf):
    lab, dim = labelled(spark, sf)
    return materialize(resample.stratified_split(lab, num_test=P.NUM_TEST, seed=P.SPLIT_SEED)), dim


def train_rows(spark, sf):
    sp, _ = split_rows(spark, sf)
    return sp.where(F.col("split") == "train").drop("split")


def bag_total(train):
    """Rows requested per bag: half the training rows (valid at every scale)."""
    return train.count() // P.BAG_DIVISOR


def same_bags(spark, sf, formula="same", train=None):
    train = train if train is not None else train_rows(spark, sf)
    return materialize(resample.bag_same(train, P.ESTIMATORS, bag_total(train),
                                         P.MIN_CAT, P.BAG_SEED, formula))


# ------------------------------------------------------------ normalisation

@query("records_normalise")
def q_records_normalise(spark, sf):
    lab, _ = labelled(spark, sf)
    return lab.select("id", "digit", "label", concat_text().alias("text"))


@query("records_clean_hook")
def q_records_clean_hook(spark, sf):
    lab, _ = normalise.normalise_records(read_records(spark, sf), clean_fn=default_clean)
    return lab.select("id", "label", *TEXT_COLS)


@query("dedup_first6")
def q_dedup_first6(spark, sf):
    return normalise.dedup_first6(fill_text(read_records(spark, sf)))


@query("dedup_code4")
def q_dedup_code4(spark, sf):
    return normalise.dedup_code4(normalise.add_code(read_records(spark, sf))) \
        .select("id", "digit", *TEXT_COLS)


@query("label_dim")
def q_label_dim(spark, sf):
    return labelled(spark, sf)[1]


@query("label_encode")
def q_label_encode(spark, sf):
    return labelled(spark, sf)[0].select("id", "label")


@query("code_split")
def q_code_split(spark, sf):
    return normalise.code_parts(labelled(spark, sf)[1])


# ------------------------------------------------------------ audits

@query("null_patterns")
def q_null_patterns(spark, sf):
    return audit.null_patterns(read_records(spark, sf))


@query("column_profile")
def q_column_profile(spark, sf):
    return audit.column_profile(read_records(spark, sf))


@query("class_histogram")
def q_class_histogram(spark, sf):
    return audit.class_histogram(labelled(spark, sf)[0])


@query("class_size_quantiles")
def q_class_size_quantiles(spark, sf):
    return audit.class_size_summary(labelled(spark, sf)[0])


# ------------------------------------------------------------ split / bags

@query("split_stratified")
def q_split_stratified(spark, sf):
    return split_rows(spark, sf)[0].select("id", "label", "split")


@query("split_counts")
def q_split_counts(spark, sf):
    return audit.split_counts(split_rows(spark, sf)[0])


@query("bag_same")
def q_bag_same(spark, sf):
    return same_bags(spark, sf).select("bag_id", "id", "label")


@query("bag_same_nb")
def q_bag_same_nb(spark, sf):
    return same_bags(spark, sf, "nb").select("bag_id", "id", "label")


@query("bag_random")
def q_bag_random(spark, sf):
    train = train_rows(spark, sf)
    b = resample.bag_random(train, P.ESTIMATORS, bag_total(train),
                            P.MIN_CAT, P.BAG_SEED, cut_std=P.CUT_STD)
    return b.select("bag_id", "id", "label")


@query("bag_random_histogram")
def q_bag_random_histogram(spark, sf):
    train = train_rows(spark, sf)
    b = resample.bag_random(train, P.ESTIMATORS, bag_total(train),
                            P.MIN_CAT, P.BAG_SEED, cut_std=P.CUT_STD, draw="histogram")
    return b.select("bag_id", "id", "label")


@query("bag_stats")
def q_bag_stats(spark, sf):
    return resample.bag_stats(same_bags(spark, sf))


@query("oob_rows")
def q_oob_rows(spark, sf):
    full = train_rows(spark, sf)
    bags = same_bags(spark, sf, train=full).select("bag_id", "id", "label", *TEXT_COLS)
    return resample.oob_by_rows(full.select("id", "label", *TEXT_COLS), bags)


@query("oob_ids")
def q_oob_ids(spark, sf):
    full = train_rows(spark, sf)
    return resample.oob_by_id(full.select("id", "label", *TEXT_COLS),
                              same_bags(spark, sf, train=full))


@query("test_plus_oob")
def q_test_plus_oob(spark, sf):
    sp, _ = split_rows(spark, sf)
    cols = ["id", "label", *TEXT_COLS]
    test = sp.where(F.col("split") == "test").select(*cols)
    full = sp.where(F.col("split") == "train").drop("split")
    oob = resample.oob_by_id(full.select(*cols), same_bags(spark, sf, train=full))
    return resample.test_plus_oob(test, oob)


def _upsampled(spark, sf, method):
    return resample.upsample(train_rows(spark, sf), method, P.UP_MIN, P.UP_SEED)


@query("upsample_uniform")
def q_upsample_uniform(spark, sf):
    return _upsampled(spark, sf, "uniform")


@query("upsample_random")
def q_upsample_random(spark, sf):
    return _upsampled(spark, sf, "random")


@query("upsample_shuffle")
def q_upsample_shuffle(spark, sf):
    return _upsampled(spark, sf, "shuffle")


# ------------------------------------------------------------ pipelines

@query("preprocess_pipeline")
def q_preprocess_pipeline(spark, sf):
    from bagwise.plans.pipelines import preprocess
    p = preprocess(read_records(spark, sf), num_test=P.NUM_TEST, upsample="uniform",
                   minimum=P.UP_MIN, seed=P.SPLIT_SEED)
    return (p.train.select(F.lit("train").alias("split"), "id", "draw", "label", "text")
            .unionByName(p.test.select(F.lit("test").alias("split"), "id",
                                       F.lit(0).alias("draw"), "label", "text")))


@query("bagging_pipeline")
def q_bagging_pipeline(spark, sf):
    from bagwise.plans.pipelines import bagging
    b = bagging(read_records(spark, sf), P.NUM_TEST, P.ESTIMATORS, None,
                P.NUM_SUB_VALID, dist="same", upsample="random", minimum=P.UP_MIN,
                min_cat_data=P.MIN_CAT, seed=P.BAG_SEED, split_seed=P.SPLIT_SEED)
    held_out = b.test.select(F.lit(None).cast("int").alias("bag_id"), F.col("source").alias("part"),
                             "id", F.lit(0).cast("long").alias("draw"), "label", "text")
    return b.bags.unionByName(held_out)


# ------------------------------------------------------------ learners / ensembles

from bagwise.functions.arrays import argmax, ce_row, one_hot  # noqa: E402
from bagwise.operators import assignment, ensemble, learners, losses, metrics  # noqa: E402
from bagwise.operators import history, reports, subsets  # noqa: E402
from bagwise.sources import tables  # noqa: E402


def emb_rows(spark, sf):
    return tables.embedding_rows(spark, sf)


def emb_classes(spark, sf):
    return tables.embedding_class_dim(emb_rows(spark, sf))


def emb_models(spark, sf):
    rows = emb_rows(spark, sf)
    return learners.fit_centroids(rows.where(F.col("split") == "train"),
                                  models=tables.EMB_MODELS, width=tables.EMB_SLICE)


def emb_wide(spark, sf, which=("test",)):
    """(id, label, split, scores of all models) for the rows of the given splits."""
    rows = emb_rows(spark, sf).where(F.col("split").isin(*which))
    return learners.score_wide(rows, emb_models(spark, sf), scale=tables.EMB_SCALE,
                               width=tables.EMB_SLICE, keep=("id", "label", "split"))


def emb_scored(spark, sf, which=("test",), wide=None):
    """(model, id, label, split, prob) for the rows of the given splits."""
    wide = wide if wide is not None else materialize(emb_wide(spark, sf, which))
    return learners.scores_long(wide, keep=("id", "label", "split"))


def emb_base(spark, sf, sc=None):
    """Base predictions with pred and CE loss (M7, M8)."""
    sc = sc if sc is not None else emb_scored(spark, sf)
    return sc.withColumn("pred", argmax("prob")).withColumn("loss", ce_row("prob", "label"))


def emb_ensemble(spark, sf, wide=None):
    ens = ensemble.mean_and_vote(wide if wide is not None else emb_wide(spark, sf))
    return ens.withColumn("loss_mean", ce_row("prob_mean", "label"))


def emb_names(spark, sf, sc=None):
    """Learner type, loss and name of every base model found in the scored
    predictions (one model per bag)."""
    sc = sc if sc is not None else emb_scored(spark, sf)
    ranges = assignment.learner_ranges(spark, P.EMB_MODEL_TYPES)
    bag_ids = sc.select(F.col("model").cast("int").alias("bag_id")).distinct()
    return assignment.assign_learners(bag_ids, ranges, loss="mix")


def emb_gathered_by_name(spark, sf, sc=None):
    sc = sc if sc is not None else emb_scored(spark, sf)
    names = emb_names(spark, sf, sc).select(F.col("bag_id").alias("model"), "name")
    sc = sc.join(F.broadcast(names), "model")
    return (sc.groupBy("id", "label")
            .agg(F.sort_array(F.collect_list(F.struct("name", "prob"))).alias("_np"))
            .select("id", "label", F.col("_np.prob").alias("probs")))


@query("learner_assignment")
def q_learner_assignment(spark, sf):
    """Learner type of every bag built from the embedding training rows."""
    ranges = assignment.learner_ranges(spark, P.EMB_MODEL_TYPES)
    train = emb_rows(spark, sf).where(F.col("split") == "train")
    bags = resample.bag_same(train, tables.EMB_MODELS, bag_total(train), P.MIN_CAT, P.BAG_SEED)
    sizes = materialize(bags.groupBy("bag_id").agg(F.count(F.lit(1)).alias("rows")))
    return (assignment.assign_learners(sizes.select("bag_id"), ranges, loss="mix")
            .join(ranges.select("type", "lo", "hi"), "type").join(sizes, "bag_id"))


@query("model_names")
def q_model_names(spark, sf):
    sc = emb_scored(spark, sf)
    scored = sc.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    names = emb_names(spark, sf, sc).select(F.col("bag_id").alias("model"), "name")
    return names.join(scored, "model")


@query("centroid_scores")
def q_centroid_scores(spark, sf):
    sc = emb_scored(spark, sf)
    return sc.select("model", "id", F.posexplode("prob").alias("class", "prob"))


@query("score_all_models")
def q_score_all_models(spark, sf):
    return emb_base(spark, sf).select("model", "id", "label", "pred")


@query("one_hot")
def q_one_hot(spark, sf):
    rows = emb_rows(spark, sf).where(F.col("split") == "test")
    return rows.select("id", F.posexplode(one_hot("label", P.EMB_CLASSES)).alias("class", "t"))


@query("ensemble_mean")
def q_ensemble_mean(spark, sf):
    return ensemble.mean_ensemble(emb_wide(spark, sf)).select("id", "label", "pred")


@query("ensemble_vote")
def q_ensemble_vote(spark, sf):
    return ensemble.vote_ensemble(emb_wide(spark, sf)).select("id", "label", "pred")


@query("ensemble_submission")
def q_ensemble_submission(spark, sf):
    src = emb_rows(spark, sf).where(F.col("split") == "test").select(
        "id", F.lit(None).cast("string").alias("digit_1"),
        F.lit(None).cast("string").alias("digit_2"), F.lit(None).cast("string").alias("digit_3"))
    return reports.submission(src, emb_ensemble(spark, sf), emb_classes(spark, sf), "pred_mean")


def _ens_long(spark, sf):
    ens = materialize(emb_ensemble(spark, sf))
    return (ens.select(F.lit("mean").alias("agg_fn"), "id", "label",
                       F.col("pred_mean").alias("pred"))
            .unionByName(ens.select(F.lit("vote").alias("agg_fn"), "id", "label",
                                    F.col("pred_vote").alias("pred"))))


@query("confusion")
def q_confusion(spark, sf):
    return metrics.confusion(_ens_long(spark, sf), by=["agg_fn"])


@query("per_class_metrics")
def q_per_class_metrics(spark, sf):
    return reports.per_class_result(emb_ensemble(spark, sf), emb_classes(spark, sf))


@query("macro_metrics")
def q_macro_metrics(spark, sf):
    m = metrics.macro(_ens_long(spark, sf), emb_classes(spark, sf), by=["agg_fn"])
    return metrics.rounded(m, ["accuracy", "precision", "recall", "f1score"])


@query("model_metrics")
def q_model_metrics(spark, sf):
    return metrics.macro(emb_base(spark, sf), emb_classes(spark, sf), by=["model"],
                         loss_col="loss")


@query("evaluator_state")
def q_evaluator_state(spark, sf):
    """The same scores from an evaluator kept as a table: four batches of the
    predictions in any order, one of them taken in twice (A15, U2)."""
    import uuid
    base = emb_base(spark, sf)
    state = metrics.EvaluationState(f"{ensure_checkpoint_dir(spark)}/state/{uuid.uuid4().hex}", by=["model"])
    for batch in (2, 0, 3, 2, 1):
        state.update(str(batch), base.where(F.pmod("id", F.lit(4)) == batch))
    return state.scores(spark, emb_classes(spark, sf))


def _loss(spark, sf, name, **kw):
    rows = losses.row_losses(emb_scored(spark, sf), name, by=["model"],
                             batch_size=P.BATCH_SIZE, num_classes=P.EMB_CLASSES, **kw)
    return losses.reduce_loss(rows, "mean", by=["model"])


@query("loss_ce")
def q_loss_ce(spark, sf):
    return _loss(spark, sf, "CE")


@query("loss_fce")
def q_loss_fce(spark, sf):
    return _loss(spark, sf, "FCE")


@query("loss_ice")
def q_loss_ice(spark, sf):
    return _loss(spark, sf, "ICE")


@query("loss_weighted")
def q_loss_weighted(spark, sf):
    w = emb_classes(spark, sf).select(
        "label", (F.lit(1.0) / (F.col("label") + 1)).alias("weight"))
    return _loss(spark, sf, "CE", weights=w, ignore_index=0)


@query("loss_reductions")
def q_loss_reductions(spark, sf):
    sc = emb_scored(spark, sf)
    rows = losses.row_losses(sc, "CE")
    # softmax=True on log-probabilities gives back the probabilities
    logits = sc.withColumn("prob", F.transform("prob", lambda x: F.log(x)))
    rows_sm = losses.row_losses(losses.with_softmax(logits, True), "CE")
    out = None
    for red, src in (("mean", rows), ("sum", rows), ("mean_softmax", rows_sm)):
        r = losses.reduce_loss(src, red.split("_")[0], by=["model"]).withColumn(
            "reduction", F.lit(red))
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------ histories / reports

def hist_rows(spark, sf):
    return tables.history_view(tables.read_table(spark, sf, "events"))


@query("epoch_best")
def q_epoch_best(spark, sf):
    return history.best_epochs(hist_rows(spark, sf))


@query("early_stop")
def q_early_stop(spark, sf):
    h = materialize(hist_rows(spark, sf))
    a = history.early_stop(h, P.PATIENCE, "<=").withColumn("mode", F.lit("<="))
    b = history.early_stop(h, P.PATIENCE, "<").withColumn("mode", F.lit("<"))
    return a.unionByName(b)


def emb_evals(spark, sf):
    """Per-row evaluation facts: run 'centroid', epoch = base model index,
    split train / valid, label, pred, loss (stand-in for an epoch loop)."""
    sc = emb_scored(spark, sf, which=("train", "test"))
    return sc.select(F.lit("centroid").alias("run"), F.col("model").alias("epoch"),
                     F.when(F.col("split") == "train", "train").otherwise("valid").alias("split"),
                     "id", "label", argmax("prob").alias("pred"),
                     ce_row("prob", "label").alias("loss"))


@query("epoch_summary")
def q_epoch_summary(spark, sf):
    return reports.epoch_summary(emb_evals(spark, sf), emb_classes(spark, sf))


@query("class_epoch_pivot")
def q_class_epoch_pivot(spark, sf):
    return reports.class_epoch_pivot(emb_evals(spark, sf), emb_classes(spark, sf),
                                     epochs=list(range(tables.EMB_MODELS)))


@query("test_summary")
def q_test_summary(spark, sf):
    wide = materialize(emb_wide(spark, sf))
    sc = emb_scored(spark, sf, wide=wide)
    return reports.test_summary(emb_ensemble(spark, sf, wide), emb_base(spark, sf, sc),
                                emb_classes(spark, sf))


@query("predictions")
def q_predictions(spark, sf):
    return reports.prediction_table(emb_ensemble(spark, sf), emb_classes(spark, sf))


# ------------------------------------------------------------ subset search

@query("subset_metrics")
def q_subset_metrics(spark, sf):
    sc = emb_scored(spark, sf)
    names = [r[0] for r in emb_names(spark, sf, sc).select("name").collect()]  # one per model
    return subsets.subset_metrics(emb_gathered_by_name(spark, sf, sc), names,
                                  emb_classes(spark, sf))


def _top(spark, sf, by):
    return subsets.top_subsets(materialize(q_subset_metrics(spark, sf)), by, P.TOP_K)


@query("subset_top_acc")
def q_subset_top_acc(spark, sf):
    return _top(spark, sf, "accuracy")


@query("subset_top_f1")
def q_subset_top_f1(spark, sf):
    return _top(spark, sf, "f1score")


@query("subset_top_weighted")
def q_subset_top_weighted(spark, sf):
    return _top(spark, sf, "weighted")


@query("subset_per_type")
def q_subset_per_type(spark, sf):
    sc = emb_scored(spark, sf)
    names = emb_names(spark, sf, sc).select(F.col("bag_id").alias("model"), "name")
    out = None
    for n in (1, 2):
        w = subsets.per_type_pool(sc, names, n)
        ens = subsets.weighted_mean_ensemble(sc, w)
        m = metrics.macro(ens, emb_classes(spark, sf)).withColumn("n", F.lit(n).cast("long"))
        out = m if out is None else out.unionByName(m)
    return out.select("n", "accuracy", "precision", "recall", "f1score")


@query("preview")
def q_preview(spark, sf):
    lab, _ = labelled(spark, sf)
    return lab.orderBy("id").limit(P.PREVIEW_N).select("id", "digit", "label",
                                                       concat_text().alias("text"))


# ------------------------------------------------------------ text encoding

from bagwise.operators import encode as enc  # noqa: E402

VIEWS = (enc.View("word", "word"), enc.View("char3", "char", 3, token_types=False))


def doc_texts(spark, sf):
    return tables.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _vocab(spark, sf, views=VIEWS):
    return materialize(enc.vocab(doc_texts(spark, sf), views, P.VOCAB_SIZE))


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("vocab_top")
def q_vocab_top(spark, sf):
    return _vocab(spark, sf)


@query("vocab_frequent")
def q_vocab_frequent(spark, sf):
    return enc.vocab(doc_texts(spark, sf), VIEWS, P.FREQUENT, counters=P.FREQUENT_COUNTERS)


@query("encode_fixed")
def q_encode_fixed(spark, sf):
    docs = doc_texts(spark, sf)
    e = enc.encode(docs, _vocab(spark, sf, VIEWS[:1]), VIEWS[0], P.MAX_LEN, out="e")
    return e.select(
        "id", _ids_str(F.col("e.input_ids")).alias("input_ids"),
        _ids_str(F.col("e.attention_mask")).alias("attention_mask"),
        _ids_str(F.col("e.token_type_ids")).alias("token_type_ids"))


@query("encode_views")
def q_encode_views(spark, sf):
    docs = doc_texts(spark, sf)
    ev = enc.encode_views(docs, _vocab(spark, sf), VIEWS, P.MAX_LEN)
    return ev.select("id", *[_ids_str(F.col(f"{v.name}.input_ids")).alias(f"{v.name}_ids")
                             for v in VIEWS],
                     F.col("char3.token_type_ids").isNull().alias("char3_no_types"))


@query("route_views")
def q_route_views(spark, sf):
    docs = doc_texts(spark, sf)
    ev = materialize(enc.encode_views(docs, _vocab(spark, sf), VIEWS, P.MAX_LEN))
    bags = same_bags(spark, sf).select("bag_id", "id")
    asg = assignment.assign_learners(bags.select("bag_id").distinct(),
                                     assignment.learner_ranges(spark, P.EMB_MODEL_TYPES))
    r = enc.route_views(bags, ev, asg, P.VIEW_OF_TYPE, VIEWS)
    return r.select("bag_id", "id", "view", _ids_str(F.col("input_ids")).alias("input_ids"))


# ------------------------------------------------------------ text learners, end to end

def text_model(spark, sf):
    """Split rows, hashed text features of every source row by id, the model
    table of one centroid learner per bag, and the label dictionary.  Rows that
    normalising drops as copies have features too."""
    from bagwise.operators.textfeat import hashed_terms
    sp, dim = split_rows(spark, sf)
    source = fill_text(read_records(spark, sf))
    vecs = materialize(hashed_terms(source.select("id", concat_text().alias("text")), P.TEXT_DIMS))
    bags = same_bags(spark, sf, train=sp.where(F.col("split") == "train").drop("split"))
    model = learners.fit_centroids(
        bags.select(F.col("bag_id").alias("model"), "id", "label").join(vecs, "id"))
    return sp, vecs, materialize(model), dim


def text_scored(spark, sf, keys=("id", "label")):
    """(keys..., scores of all models) of the hold-out rows by one centroid
    learner per bag over hashed text features, and the label dictionary."""
    sp, vecs, model, dim = text_model(spark, sf)
    test = sp.where(F.col("split") == "test")
    scored = learners.score_wide(test.select(*keys).join(vecs, "id"), model,
                                 scale=P.TEXT_SCALE, keep=keys)
    return materialize(scored), dim


@query("text_bagging_summary")
def q_text_bagging_summary(spark, sf):
    """Records -> bags -> text features -> a learner per bag -> mean and vote
    ensembles -> scores on the hold-out texts."""
    scored, dim = text_scored(spark, sf)
    ens = ensemble.mean_and_vote(scored)
    both = [ens.select(F.lit(k).alias("agg_fn"), "id", "label", F.col(f"pred_{k}").alias("pred"))
            for k in ("mean", "vote")]
    m = metrics.macro(both[0].unionByName(both[1]), dim, by=["agg_fn"])
    return metrics.rounded(m, ["accuracy", "precision", "recall", "f1score"])


@query("inference_codes")
def q_inference_codes(spark, sf):
    """Hold-out texts without their labels -> all models -> mean -> code parts."""
    scored, dim = text_scored(spark, sf, keys=("id",))
    ens = ensemble.mean_ensemble(scored, keys=("id",))
    source = scored.select("id").distinct().select(
        "id", *[F.lit(None).cast("string").alias(f"digit_{i}") for i in (1, 2, 3)])
    return reports.submission(source, ens, dim, "pred")


@query("inference_all_codes")
def q_inference_all_codes(spark, sf):
    """Every row of documents, its label set aside -> all models -> mean ->
    code parts on the source rows.  Only the predicted class of a row is
    written, never its probabilities."""
    _, vecs, model, dim = text_model(spark, sf)
    pred = learners.predict_mean(vecs, model, scale=P.TEXT_SCALE)
    return reports.submission(read_records(spark, sf).select("id"), pred, dim, "pred")


# ------------------------------------------------------------ trained learners (rows-only)

@query("train_head")
def q_train_head(spark, sf):
    """Softmax head trained by epochs with FCE, early stopping (M5, M9, O1)."""
    from bagwise.operators import training
    rows = emb_rows(spark, sf)
    dim = len(rows.select("vec").first()[0])
    h = training.train_head(rows.where(F.col("split") == "train"),
                            rows.where(F.col("split") == "test"), emb_classes(spark, sf),
                            P.EMB_CLASSES, dim, loss="FCE", epochs=P.HEAD_EPOCHS, lr=0.5,
                            patience=P.PATIENCE)
    return h.history.withColumn("best_epoch", F.lit(h.best_epoch))


@query("ml_bag_learners")
def q_ml_bag_learners(spark, sf):
    """One Spark ML learner per bag of the embedding training rows (M1, M2, M4)."""
    rows = emb_rows(spark, sf)
    train = rows.where(F.col("split") == "train")
    bags = materialize(resample.bag_same(train, P.ESTIMATORS, bag_total(train), P.MIN_CAT,
                                         P.BAG_SEED))
    dim = len(rows.select("vec").first()[0])
    kinds = ["logreg", "mlp", "logreg"]
    models = learners.fit_per_bag(bags, list(enumerate(kinds[:P.ESTIMATORS])), dim,
                                  P.EMB_CLASSES, hidden=(16,), max_iter=30)
    scored = learners.score_ml(models, rows.where(F.col("split") == "test"))
    return scored.withColumn("pred", argmax("prob")).select("model", "id", "label", "pred")


# ------------------------------------------------------------ networks of all bags by mini-batches

def network_bags(spark, sf):
    """(model, id, label, vec): training rows drawn by hash for each network."""
    rows = emb_rows(spark, sf).where(F.col("split") == "train")
    every = rows.withColumn("model", F.explode(F.array(*map(F.lit, range(P.NETWORKS)))))
    return every.where(uniform(P.BAG_SEED, "net", "model", "id") < P.NETWORK_SHARE).select("model", "id", "label", "vec")


def network_plans(dim, *hidden):
    from bagwise.operators.networks import Net
    return {m: Net((dim, *hidden, P.EMB_CLASSES), P.NETWORK_LOSSES[m % len(P.NETWORK_LOSSES)])
            for m in range(P.NETWORKS)}


@query("batch_gradients")
def q_batch_gradients(spark, sf):
    """Loss and gradient norm of every mini-batch of every bag at fixed
    weights, CE, FCE and ICE, in one scan (M2, M5)."""
    import numpy as np
    from bagwise.operators import networks
    bags = network_bags(spark, sf)
    dim = len(emb_rows(spark, sf).select("vec").first()[0])
    nets = network_plans(dim)
    c, j = np.arange(P.EMB_CLASSES)[:, None], np.arange(dim)
    bias = (np.arange(P.EMB_CLASSES)[:, None] % 3 - 1) / 10
    start = {m: np.hstack([((7 * c + 3 * j + m) % 11 - 5) / 20, bias]).ravel() for m in nets}
    batches = networks.lay_out(bags, P.EMB_CLASSES, P.BATCH_SIZE, P.BAG_SEED)
    return networks.gradient_norms(batches, nets, start)


@query("bag_networks")
def q_bag_networks(spark, sf):
    """Networks with a hidden layer and mixed losses, all bags trained together
    by mini-batches with early stopping: the epoch history (M2, M4, M5, O1)."""
    from bagwise.operators import networks
    rows = emb_rows(spark, sf)
    dim = len(rows.select("vec").first()[0])
    train_rows = rows.where(F.col("split") == "train").count()
    # A share of the rows a step, so that an epoch has as many steps at every size.
    done = networks.train(network_bags(spark, sf), rows.where(F.col("split") == "test"), network_plans(dim, P.NETWORK_HIDDEN),
                          epochs=P.NETWORK_EPOCHS, batch_size=max(P.BATCH_SIZE, -(-train_rows // P.NETWORK_STEPS)),
                          lr=0.5, patience=P.PATIENCE, seed=P.BAG_SEED)
    return done.history_table(spark)
