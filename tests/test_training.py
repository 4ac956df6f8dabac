"""Gradient head (M5): analytic gradients against finite differences,
learning a separable problem, early stop; sinks round trip (S3, S4)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bagwise.operators import training


class _BC:
    def __init__(self, v):
        self.value = v


def _loss(W, b, X, y, loss, gamma=2.0):
    z = X @ W.T + b
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    py = p[np.arange(len(y)), y]
    if loss == "FCE":
        return float((-((1 - py) ** gamma) * np.log(py + 1e-9)).sum())
    return float((-np.log(py + 1e-9)).sum())


@pytest.mark.parametrize("loss", ["CE", "FCE"])
def test_gradient_matches_finite_difference(loss):
    rng = np.random.default_rng(0)
    C, d = 3, 4
    W, b = rng.normal(size=(C, d)), rng.normal(size=C)
    X, y = rng.normal(size=(7, d)), rng.integers(0, C, 7)
    pdf = pd.DataFrame({"vec": list(X), "label": y})
    out = next(training._grad_fn(_BC((W, b)), loss, 2.0, C, d, "vec", "label")(iter([pdf])))
    g = out["g"].to_numpy()[2:].reshape(C, d + 1)
    eps = 1e-6
    for c in range(C):
        for j in range(d):
            Wp, Wm = W.copy(), W.copy()
            Wp[c, j] += eps
            Wm[c, j] -= eps
            num = (_loss(Wp, b, X, y, loss) - _loss(Wm, b, X, y, loss)) / (2 * eps)
            assert g[c, j] == pytest.approx(num, rel=1e-4, abs=1e-6)


def test_head_learns_separable(spark):
    rows = [(i, [1.0 if i % 2 else -1.0, 0.5], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    classes = spark.createDataFrame([(0,), (1,)], "label int")
    h = training.train_head(df, df, classes, 2, 2, loss="CE", epochs=8, lr=1.0, patience=3)
    last = h.history.where("split = 'valid'").orderBy(F.desc("epoch")).first()
    assert last.accuracy == 1.0
    assert h.best_epoch == h.history.agg(F.max("epoch")).first()[0]


def test_sinks_round_trip(spark, tmp_path):
    from bagwise.sources import sinks
    dim = spark.createDataFrame([(0, "A00100"), (1, "B03117")], "label int, digit string")
    sinks.write_label_dim(dim, str(tmp_path / "dim"))
    back = sinks.read_label_dim(spark, str(tmp_path / "dim")).orderBy("label").collect()
    assert [tuple(r) for r in back] == [(0, "A00100"), (1, "B03117")]
    bags = spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "bag_id int, id long, label int")
    sinks.write_bags(bags, str(tmp_path / "bags"))
    got = spark.read.parquet(str(tmp_path / "bags")).where("bag_id = 1").collect()
    assert [(r.id, r.label) for r in got] == [(2, 6)]
