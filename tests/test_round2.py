"""Whole texts, null code parts, row order by any type, clustered ranks,
sinks and the saved best state."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagwise.operators import learners, losses, normalise, resample, strata, training
from bagwise.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def test_record_fields_hold_the_whole_text(spark):
    docs = tables.read_table(spark, SF, "documents")
    rows = tables.records_view(docs).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect()
    for r in rows:
        fields = [x for x in (r.text_obj, r.text_mthd, r.text_deal) if x is not None]
        assert "\n".join(fields) == r.text


def test_rows_with_null_code_parts_stay(spark):
    rows = [("1", "A", None, 1, "x", None, None), ("2", "A", 2, 1, "y", None, None),
            ("3", None, 3, 4, "z", "", None), ("4", "A", None, 1, "x", "", None)]
    df = spark.createDataFrame(rows, "id string, digit_1 string, digit_2 int, digit_3 int, "
                                     "text_obj string, text_mthd string, text_deal string")
    for order, kept in (("preprocess", 3), ("bagging", 4)):
        out, dim = normalise.normalise_records(df, order=order)
        got = {r.id: (r.digit, r.label) for r in out.collect()}
        assert len(got) == kept
        codes = sorted(r.digit for r in dim.collect())
        assert codes == ["03004", "A00001", "A02001"]
        assert got["1"] == ("A00001", 1) and got["3"] == ("03004", 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rank_of_clustered_values_stays_in_small_buckets(spark, kind):
    values = [7] * 50 + list(range(1000, 5000)) + [10 ** 9]
    df = spark.createDataFrame([(i % 2, v, i) for i, v in enumerate(values)], "g int, v long, i long")
    df = df.withColumn("v", F.col("v").cast(kind))
    out = strata.rank_by_number(df, ["g"], "v", ["i"], target=200).collect()
    for g in (0, 1):
        want = sorted((r.v, r.i) for r in out if r.g == g)
        assert [(r.v, r.i) for r in sorted((r for r in out if r.g == g), key=lambda r: r["rank"])] == want
    sizes = df.repartitionByRange(-(-len(values) // 200), "g", "v", "i").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 3 * 200


def test_token_pool_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(resample, "POOL_BLOCK", 7)
    train = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, label int")
    seen = []
    ranked = resample.rank_by_key
    monkeypatch.setattr(resample, "rank_by_key", lambda pool, *a, **k: (
        seen.append((pool.rdd.getNumPartitions(), pool.count())), ranked(pool, *a, **k))[1])
    small = resample.random_bag_sizes(train, 2, 150, seed=1).collect()
    monkeypatch.setattr(resample, "POOL_BLOCK", 100_000)
    assert Counter(map(tuple, small)) == Counter(map(tuple, resample.random_bag_sizes(train, 2, 150, seed=1).collect()))
    assert seen and seen[0][0] > 1


def test_shuffle_draws_from_mostly_empty_classes(spark):
    rows = [(i, 0, "", "", "a" if i == 0 else "") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label int, text_obj string, text_mthd string, text_deal string")
    out = resample.upsample(df, "shuffle", 60, 3)
    assert out.count() == 60
    assert all(r.text_deal == "a" for r in out.where("draw > 0").collect())


def test_ice_with_text_ids_and_its_validation_loss(spark):
    rows = [(f"r{i:03d}", i % 3, [0.2, 0.3, 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, label int, prob array<double>")
    assert losses.row_losses(df, "ICE", batch_size=8, num_classes=3).count() == 40
    r = np.random.default_rng(1)
    data = [(f"r{i:03d}", i % 2, [float(x) for x in r.normal((i % 2) * 2.0, 1.0, 4)]) for i in range(80)]
    vec = spark.createDataFrame(data, "id string, label int, vec array<double>")
    train, valid = vec.where("id < 'r060'"), vec.where("id >= 'r060'")
    classes = spark.createDataFrame([(0, "A"), (1, "B")], "label int, digit string")
    head = training.train_head(train, valid, classes, 2, 4, loss="ICE", epochs=3, batch_size=16)
    # The recorded validation loss is the weighted one, at every epoch.
    weights = {x.id: x.weight for x in losses.ice_weights(valid, "label", 16, 2).collect()}
    best = training.score_head(valid, head.W, head.b).collect()
    loss = np.mean([-weights[x.id] * np.log(x.prob[x.label] + 1e-9) for x in best])
    got = {x.epoch: x.loss for x in head.history.where("split = 'valid'").collect()}
    assert got[head.best_epoch] == pytest.approx(loss)


def test_best_state_is_saved_and_scores_again(spark, tmp_path):
    head = training.Head(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.0, 0.5]), 0, None)
    training.save_head(spark, head, str(tmp_path / "head"))
    W, b = training.load_head(spark, str(tmp_path / "head"))
    assert (W == head.W).all() and (b == head.b).all()
    df = spark.createDataFrame([(1, 0, [2.0, 0.0]), (2, 1, [0.0, 2.0])], "id long, label int, vec array<double>")
    assert all(r.prob[r.label] > 0.5 for r in training.score_head(df, W, b).collect())


def test_tables_and_submissions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "A", "é|x"), (1, 2, "B", None)], "`Unnamed: 0` long, id long, digit_1 string, text string")
    sinks.write_submission(df, str(tmp_path / "s"))
    back = spark.read.option("header", True).option("sep", "|").csv(str(tmp_path / "s"))
    assert back.columns == ["id", "digit_1", "text"]
    assert Counter(map(tuple, back.collect())) == Counter([("1", "A", "é|x"), ("2", "B", None)])
    for fmt in ("csv", "parquet"):
        sinks.write_table(df.drop("Unnamed: 0"), str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "digit_1", "text"]


def test_naive_bayes_learner(spark):
    bags = spark.createDataFrame([(0, i, i % 2, [float(i % 2), 1.0 - i % 2]) for i in range(20)],
                                 "bag_id int, id long, label int, vec array<double>")
    models = learners.fit_per_bag(bags, [(0, "naive_bayes")], 2, 2)
    out = learners.predict(learners.score_ml(models, bags.select("id", "label", "vec"))).collect()
    assert all(r.pred == r.label for r in out)


def test_subset_counts_of_many_models(spark):
    from bagwise.operators import subsets
    r = np.random.default_rng(2)
    k, C, n = 9, 30, 60
    probs = r.dirichlet(np.ones(C), (n, k))
    rows = [(int(i % C), [[float(x) for x in m] for m in d]) for i, d in enumerate(probs)]
    df = spark.createDataFrame(rows, "label int, probs array<array<double>>").repartition(3)
    got = {(x["mask"], x.label): (x.n_pred, x.tp) for x in subsets.subset_counts(df, k).collect() if x["mask"]}
    for mask in (1, 5, 2 ** k - 1):
        mean = np.round(probs[:, [m for m in range(k) if mask >> m & 1]].mean(axis=1), 9)
        pred = mean.argmax(axis=1)
        for c in range(C):
            want = (int((pred == c).sum()), int(((pred == c) & (np.arange(n) % C == c)).sum()))
            assert got.get((mask, c), (0, 0)) == want
