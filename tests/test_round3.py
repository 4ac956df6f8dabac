"""Inference over every row of documents."""

import numpy as np

from bagwise.operators import ensemble, learners
from bagwise.plans.catalog import REGISTRY
from bagwise.sources import tables

SF = "/root/testdata/sf0.001"


def test_every_document_gets_a_code(spark):
    ids = {r.id for r in tables.read_records(spark, SF).select("id").collect()}
    out = REGISTRY["inference_all_codes"](spark, SF).collect()
    assert len(out) == len(ids) == 200 and {r.id for r in out} == ids
    assert all(r.digit_1 and r.digit_2 and r.digit_3 for r in out)


def test_mean_prediction_matches_scores_and_brute_force(spark):
    r = np.random.default_rng(4)
    W = [r.random((6, 5)) for _ in range(3)]
    W[0][3] = W[0][1]
    model = spark.createDataFrame([(m, list(range(6)), w.tolist()) for m, w in enumerate(W)],
                                  "model int, labels array<int>, W array<array<double>>")
    vecs = r.random((40, 5))
    rows = [(f"d{i}", v.tolist()) for i, v in enumerate(vecs)] + [("zero", [0.0] * 5), ("none", None)]
    docs = spark.createDataFrame(rows, "id string, vec array<double>").repartition(3)
    got = {x.id: x.pred for x in learners.predict_mean(docs, model, scale=8.0).collect()}
    want = {"zero": 0}
    for i, v in enumerate(vecs):
        each = [np.exp(8.0 * w @ v) for w in W]
        want[f"d{i}"] = int(np.round(np.mean([e / e.sum() for e in each], axis=0), 9).argmax())
    assert got == want
    wide = learners.score_wide(docs.where("vec is not null"), model, 8.0, keep=("id",))
    assert got == {x.id: x.pred for x in ensemble.mean_ensemble(wide, keys=("id",)).collect()}
