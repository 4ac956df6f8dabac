"""Mini-batch networks of all bags (M2, M4, M5, M9) against plain numpy."""

import hashlib

import numpy as np
import pytest

from bagwise.operators import networks
from bagwise.operators.networks import Net

EPS = 1e-9


def data(models=3, rows=90, dims=4, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, dims)) * 2
    found = []
    for m in range(models):
        for i in range(rows + 7 * m):
            y = int(rng.integers(0, classes)) if i % 3 else 0
            found.append((m, 1000 * m + i, y, [float(v) for v in centres[y] + rng.normal(size=dims)]))
    return found


BAGS = "model int, id long, label int, vec array<double>"


def batches_of(rows, model, batch_size, seed):
    """The rows of one model by batch, in the documented order."""
    mine = [r for r in rows if r[0] == model]
    mine.sort(key=lambda r: (hashlib.md5(f"{seed}:batch:{model}:{r[1]}".encode()).hexdigest(), r[1]))
    return [mine[i:i + batch_size] for i in range(0, len(mine), batch_size)]


def weights_of(labels, classes):
    n = np.bincount(labels, minlength=classes)
    inverse = 1 / (n + EPS)
    return (inverse / inverse.sum() * classes)[labels]


def loss_at(net, flat, x, y, w):
    """Written out layer by layer, without the library's passes."""
    at, out = 0, x
    for i, (a, b) in enumerate(zip(net.layers, net.layers[1:])):
        m = flat[at:at + (a + 1) * b].reshape(b, a + 1)
        at += (a + 1) * b
        out = np.concatenate([out, np.ones((len(out), 1))], axis=1) @ m.T
        if i < len(net.layers) - 2:
            out = np.where(out > 0, out, 0)
    p = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
    py = p[range(len(y)), y]
    each = {"CE": -np.log(py + EPS), "FCE": -(1 - py) ** net.gamma * np.log(py + EPS), "ICE": -w * np.log(py + EPS)}
    return float(each[net.loss].sum()), p.argmax(axis=1)


@pytest.mark.parametrize("loss", ["CE", "FCE", "ICE"])
@pytest.mark.parametrize("layers", [(4, 3), (4, 6, 3), (4, 6, 5, 3)])
def test_gradients_match_finite_differences(loss, layers):
    rng = np.random.default_rng(1)
    net = Net(layers, loss)
    flat = rng.normal(size=net.size)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9)
    w = weights_of(y, 3)
    grad, value, pred = net.gradient(flat, x, y, w)
    assert value == pytest.approx(loss_at(net, flat, x, y, w)[0]) and (pred == loss_at(net, flat, x, y, w)[1]).all()
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        num = (loss_at(net, flat + step, x, y, w)[0] - loss_at(net, flat - step, x, y, w)[0]) / 2e-6
        assert grad[i] == pytest.approx(num, rel=1e-4, abs=1e-5)


def simulate(rows, valid, nets, epochs, batch_size, lr, seed):
    """One model after the other, batch by batch."""
    out = {}
    for m, net in nets.items():
        parts, flat = batches_of(rows, m, batch_size, seed), net.start(seed + m)
        steps = max(len(batches_of(rows, k, batch_size, seed)) for k in nets)
        for epoch in range(epochs):
            total = n = 0
            for step in np.random.default_rng([seed, epoch]).permutation(steps):
                if step >= len(parts):
                    continue
                x, y = np.array([r[3] for r in parts[step]]), np.array([r[2] for r in parts[step]])
                w = weights_of(y, net.classes)
                grad = net.gradient(flat, x, y, w)[0] / len(y)
                total, n = total + loss_at(net, flat, x, y, w)[0], n + len(y)
                norm = np.sqrt((grad ** 2).sum())
                flat = flat - lr * (grad / (norm + 1e-6) if norm > 1 else grad)
            out[m, epoch, "train"] = total / n
            x, y = np.array([r[2] for r in valid]), np.array([r[1] for r in valid])
            w = np.concatenate([weights_of(y[i:i + batch_size], net.classes) for i in range(0, len(y), batch_size)])
            out[m, epoch, "valid"] = loss_at(net, flat, x, y, w)[0] / len(y)
        out[m, "params"] = flat
    return out


def held_out():
    return [(i, r[2], r[3]) for i, r in enumerate(data(1, 40, seed=5))]


NETS = {0: Net((4, 3)), 1: Net((4, 5, 3), "FCE"), 2: Net((4, 6, 5, 3), "ICE")}


@pytest.fixture(scope="module")
def tables(spark):
    rows = data()
    return rows, spark.createDataFrame(rows, BAGS).repartition(5), spark.createDataFrame(
        held_out(), "id long, label int, vec array<double>")


def test_epochs_equal_a_plain_run(spark, tables, monkeypatch):
    rows, bags, valid = tables
    monkeypatch.setattr(networks, "PART_ROWS", 6)   # a batch in several files,
    monkeypatch.setattr(networks, "FAN_IN", 2)      # summed by a tree
    done = networks.train(bags, valid, NETS, epochs=2, batch_size=25, lr=0.3, seed=11)
    want = simulate(rows, held_out(), NETS, 2, 25, 0.3, 11)
    got = {(m, e, s): loss for m, e, s, loss, *_ in done.history}
    assert len(got) == 12
    for key, loss in got.items():
        assert loss == pytest.approx(want[key], rel=1e-9)
    for m in NETS:
        assert np.allclose(done.states[m].params, want[m, "params"])
    table = done.history_table(spark).collect()
    assert all(0 <= r.accuracy <= 1 and 0 <= r.f1score <= 1 for r in table)


def test_a_cut_run_goes_on(spark, tables, tmp_path):
    _, bags, valid = tables
    args = dict(batch_size=40, lr=0.3, seed=3, patience=1)
    whole = networks.train(bags, valid, NETS, epochs=3, **args)
    folder = str(tmp_path / "run")
    networks.train(bags, valid, NETS, epochs=1, state_dir=folder, **args)
    # An epoch that was not committed does not count.
    spark.createDataFrame([(1,)], "x int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{folder}/state/000001")
    again = networks.train(bags, valid, NETS, epochs=3, state_dir=folder, **args)
    one, two = sorted(again.history), sorted(whole.history)
    assert [h[:3] for h in one] == [h[:3] for h in two]
    assert np.allclose([h[3:] for h in one], [h[3:] for h in two])
    for m in NETS:
        assert np.allclose(again.states[m].params, whole.states[m].params)
        assert again.states[m].best_epoch == whole.states[m].best_epoch
    assert networks.load(spark, folder)[1] == max(h[1] for h in whole.history)


def test_twenty_bags_cost_one_scan_a_step(spark):
    rows = spark.createDataFrame(data(20, 12), BAGS)
    nets = {m: Net((4, 3), networks.LOSSES[m % 3]) for m in range(20)}
    batches = networks.lay_out(rows, 3, 8, 1)
    step = networks.sums(batches.where("step = 0"), nets, {m: n.start(0) for m, n in nets.items()}, 1)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(step" in plan
    assert set(networks.collected(step)) == set(range(20))


def test_early_stop_is_each_models_own(spark, tables):
    _, bags, valid = tables
    done = networks.train(bags, valid, {0: Net((4, 3)), 1: Net((4, 3)), 2: Net((4, 3))}, epochs=4, batch_size=60, lr=30.0,
                          patience=1, mode="<", seed=2)
    for m, state in done.states.items():
        epochs = [h[1] for h in done.history if h[0] == m and h[2] == "valid"]
        losses = [h[3] for h in done.history if h[0] == m and h[2] == "valid"]
        assert state.best_loss == min(losses) and state.best_epoch == losses.index(min(losses))
        assert state.stopped == (len(epochs) < 4 or losses[-1] >= min(losses[:-1]))


def test_networks_learn_what_a_line_cannot(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, int((x > 0) != (y > 0)), [float(x), float(y)]) for i, (x, y) in enumerate(rng.uniform(-1, 1, (400, 2)))]
    bags = spark.createDataFrame(rows, BAGS)
    valid = bags.select("id", "label", "vec")
    done = networks.train(bags, valid, {0: Net((2, 16, 2))}, epochs=12, batch_size=50, lr=1.0, seed=1, patience=20)
    assert done.history[-1][4] > 0.9
    prob = networks.predict(valid, Net((2, 16, 2)), done.states[0].best).collect()
    assert np.mean([np.argmax(r.prob) == r.label for r in prob]) > 0.9


def test_bad_plans_are_refused(spark, tables):
    with pytest.raises(ValueError):
        Net((4, 3), "MSE")
    with pytest.raises(ValueError):
        Net((4,))
    with pytest.raises(ValueError):
        networks.train(tables[1], tables[2], {0: Net((10_000, 10_000, 3))})
