"""Networks of all bags trained by mini-batches in one pass (M2, M4, M5, M9).

A network is a linear head or has hidden layers with ReLU; its loss is CE,
FCE or ICE.  The rows of every bag are put in a seeded order by an exact
bucketed rank, cut into batches, and written once, laid out by batch number.
A step reads the files of one batch number only: batch ``t`` of every bag, all
models at once, so K bags cost one read of the rows and one job a step.  Each
task adds up the gradients of its rows for each model; the sums are merged by
a tree and only arrays of the models' size reach the driver, which clips,
steps and broadcasts.  The same scan yields the training loss and confusion
counts of the epoch, as the batches were met.

After every epoch the models are scored on the validation rows, early
stopping is decided per model, and, with a folder given, the state is
committed there, from which a new driver goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.functions.constants import EPS, FOCAL_GAMMA
from bagwise.functions.hashing import order_key
from bagwise.operators.losses import ice_weights
from bagwise.operators.strata import rank_by_key
from bagwise.session import materialize

LOSSES = ("CE", "FCE", "ICE")
#: Rows of a batch in one file, and partial sums of a model that one task or the driver adds up.
PART_ROWS = 50_000
FAN_IN = 32
#: Numbers in all models together that the driver and a task may hold.
MOST_PARAMETERS = 20_000_000

PARTIAL = "model int, step long, part int, n long, loss double, grad binary, cells binary"
PARTIAL_ROW = pa.schema([("model", pa.int32()), ("step", pa.int64()), ("part", pa.int32()), ("n", pa.int64()),
                         ("loss", pa.float64()), ("grad", pa.binary()), ("cells", pa.binary())])


@dataclass(frozen=True)
class Net:
    """Sizes from the features over the hidden layers to the classes, and the loss."""

    layers: tuple[int, ...]
    loss: str = "CE"
    gamma: float = FOCAL_GAMMA

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"invalid loss type {self.loss!r}")
        if len(self.layers) < 2:
            raise ValueError("a network needs features and classes")

    @property
    def classes(self) -> int:
        return self.layers[-1]

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.layers, self.layers[1:]))

    def start(self, seed: int) -> np.ndarray:
        """Zeros for a linear head; else normal weights scaled for ReLU."""
        if len(self.layers) == 2:
            return np.zeros(self.size)
        rng = np.random.default_rng(seed)
        return np.concatenate([np.hstack([rng.normal(0, np.sqrt(2 / a), (b, a)), np.zeros((b, 1))]).ravel()
                               for a, b in zip(self.layers, self.layers[1:])])

    def matrices(self, flat: np.ndarray) -> list[np.ndarray]:
        """One (out, in + 1) matrix a layer, the bias last."""
        found, at = [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            found.append(flat[at:at + (a + 1) * b].reshape(b, a + 1))
            at += (a + 1) * b
        return found

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs of every layer, and the class probabilities."""
        inputs = [x]
        mats = self.matrices(flat)
        for i, m in enumerate(mats):
            z = inputs[-1] @ m[:, :-1].T + m[:, -1]
            if i < len(mats) - 1:
                inputs.append(np.maximum(z, 0.0))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return inputs, e / e.sum(axis=1, keepdims=True)

    def row_losses(self, p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        py = p[np.arange(len(y)), y]
        focus = (1 - py) ** self.gamma if self.loss == "FCE" else 1.0
        return -focus * np.log(py + EPS) * (weight if self.loss == "ICE" else 1.0)

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """(sum of the rows' gradients, sum of their losses, predictions)."""
        inputs, p = self.forward(flat, x)
        rows = np.arange(len(y))
        py = p[rows, y]
        slope = -1 / (py + EPS)
        if self.loss == "FCE":
            slope = slope * (1 - py) ** self.gamma + self.gamma * (1 - py) ** (self.gamma - 1) * np.log(py + EPS)
        elif self.loss == "ICE":
            slope = slope * weight
        hit = np.zeros_like(p)
        hit[rows, y] = 1.0
        back = (slope * py)[:, None] * (hit - p)
        mats, grads = self.matrices(flat), []
        for i in reversed(range(len(mats))):
            grads.append(np.hstack([back.T @ inputs[i], back.sum(axis=0)[:, None]]).ravel())
            if i:
                back = (back @ mats[i][:, :-1]) * (inputs[i] > 0)
        return np.concatenate(grads[::-1]), float(self.row_losses(p, y, weight).sum()), p.argmax(axis=1)


@dataclass
class State:
    """One model between epochs."""

    params: np.ndarray
    best: np.ndarray
    best_loss: float | None = None
    best_epoch: int = -1
    since: int = 0
    stopped: bool = False


@dataclass
class Trained:
    states: dict[int, State]
    history: list[tuple] = field(default_factory=list)

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)


HISTORY = ("model int, epoch int, split string, loss double, accuracy double, precision double, recall double, "
           "f1score double")


# ------------------------------------------------------------ batches

def lay_out(bags: DataFrame, num_classes: int, batch_size: int, seed: int) -> DataFrame:
    """(model, id, label, vec, weight, step): every model's rows in the order
    of a seeded hash, cut into batches of ``batch_size``; ``weight`` is the
    inverse-frequency weight of the row's class in its batch.  Written once,
    a folder per step, in files of at most about PART_ROWS rows."""
    keyed = bags.select("model", "id", "label", "vec", order_key(seed, "batch", "model", "id").alias("_key"))
    ranked = rank_by_key(keyed, ["model"], "_key").withColumn(
        "step", F.floor((F.col("rank") - 1) / batch_size).cast("long"))
    count = ranked.groupBy("model", "step", "label").agg(F.count(F.lit(1)).alias("_n"))
    share = 1.0 / (F.col("_n") + F.lit(EPS))
    # Classes that the batch lacks add 1 / EPS each.
    whole = count.groupBy("model", "step").agg((F.sum(share) + (num_classes - F.count(F.lit(1))) / F.lit(EPS)).alias("_all"))
    weights = count.join(whole, ["model", "step"]).select(
        "model", "step", "label", (share / F.col("_all") * num_classes).alias("weight"))
    rows = ranked.join(weights, ["model", "step", "label"]).select("model", "id", "label", "vec", "weight", "step")
    parts = max(1, -(-batch_size // PART_ROWS))
    dealt = rows.repartition("step", F.pmod(F.xxhash64("model", "id"), F.lit(parts)))
    return materialize(dealt, by=["step"])


def _summed(nets: dict[int, Net], params, learn: bool):
    """Gradient, loss and confusion sums of a task's rows by model and step;
    with ``learn`` false only losses and confusions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}

        def flush():
            rows = [(m, s, part, n, loss, None if grad is None else grad.tobytes(), cells.tobytes())
                    for (m, s), (n, loss, grad, cells) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PARTIAL_ROW)],
                                              schema=PARTIAL_ROW)
        numbers = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "label", "weight", "step")}
            x_all = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            groups, which = np.unique(np.stack([cols["model"], cols["step"]]), axis=1, return_inverse=True)
            for g, (model, step) in enumerate(groups.T.tolist()):
                at = np.flatnonzero(which.ravel() == g)
                for m in ([model] if model >= 0 else nets):
                    net, flat = nets[m], params.value[m]
                    x, y, w = x_all[at], cols["label"][at].astype(np.int64), cols["weight"][at]
                    if learn:
                        grad, loss, pred = net.gradient(flat, x, y, w)
                    else:
                        _, p = net.forward(flat, x)
                        grad, loss, pred = None, float(net.row_losses(p, y, w).sum()), p.argmax(axis=1)
                    c = net.classes
                    cells = np.bincount(y * c + pred, minlength=c * c)
                    have = held.get((m, step))
                    if have is None:
                        held[m, step] = [len(y), loss, grad, cells]
                        numbers += c * c + (len(grad) if learn else 0)
                    else:
                        have[0] += len(y)
                        have[1] += loss
                        if learn:
                            have[2] += grad
                        have[3] += cells
            if numbers > MOST_PARAMETERS:
                yield flush()
                numbers = 0
        if held:
            yield flush()
    return run


def added(rows: list[dict]) -> dict:
    """Partial sums of one model and step as one."""
    grads = [np.frombuffer(r["grad"]) for r in rows if r["grad"] is not None]
    return {"n": sum(r["n"] for r in rows), "loss": sum(r["loss"] for r in rows),
            "grad": np.sum(grads, axis=0) if grads else None,
            "cells": np.sum([np.frombuffer(r["cells"], dtype=np.int64) for r in rows], axis=0)}


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    one = added(rows)
    return pa.Table.from_pylist([{"model": rows[0]["model"], "step": rows[0]["step"], "part": rows[0]["part"] // FAN_IN,
                                  "n": one["n"], "loss": one["loss"], "cells": one["cells"].tobytes(),
                                  "grad": None if one["grad"] is None else one["grad"].tobytes()}], schema=PARTIAL_ROW)


def sums(rows: DataFrame, nets: dict[int, Net], params: dict[int, np.ndarray], parts: int, learn: bool = True) -> DataFrame:
    """Partial sums by (model, step), merged by a tree until FAN_IN or fewer
    are left of each.  ``parts``: at most so many tasks have rows of it."""
    sent = rows.sparkSession.sparkContext.broadcast(params)
    found = rows.select("model", "label", "weight", "step", "vec").mapInArrow(_summed(nets, sent, learn), PARTIAL)
    while parts > FAN_IN:
        found = found.groupBy("model", "step", F.floor(F.col("part") / FAN_IN).alias("of")).applyInArrow(_merged, PARTIAL)
        parts = -(-parts // FAN_IN)
    return found


def collected(partial: DataFrame) -> dict[int, dict]:
    """The sums of one step by model; at most FAN_IN rows a model reach the driver."""
    rows: dict[int, list] = {}
    for r in partial.collect():
        rows.setdefault(r["model"], []).append(r.asDict())
    return {m: added(sorted(v, key=lambda r: r["part"])) for m, v in sorted(rows.items())}


def clipped(grad: np.ndarray, most: float) -> np.ndarray:
    norm = float(np.sqrt((grad ** 2).sum()))
    return grad * (most / (norm + 1e-6)) if norm > most else grad


def gradient_norms(batches: DataFrame, nets: dict[int, Net], params: dict[int, np.ndarray]) -> DataFrame:
    """(model, step, n, loss, norm): mean loss and gradient norm of every
    batch at fixed parameters, all models and batches in one scan."""
    found = sums(batches, nets, params, 1)

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        all_ = added(table.to_pylist())
        grad = all_["grad"] / all_["n"]
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "step": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([all_["n"]], pa.int64()), "loss": [all_["loss"] / all_["n"]],
                         "norm": [float(np.sqrt((grad ** 2).sum()))]})
    return found.groupBy("model", "step").applyInArrow(one, "model int, step long, n long, loss double, norm double")


# ------------------------------------------------------------ training

def scores(one: dict, classes: int) -> tuple[float, ...]:
    """(loss, accuracy, precision, recall, f1score) of confusion counts; a
    class without a prediction or without rows counts 0."""
    cells = one["cells"].reshape(classes, classes).astype(float)
    hits, true, pred = np.diag(cells), cells.sum(axis=1), cells.sum(axis=0)
    precision = np.divide(hits, pred, out=np.zeros(classes), where=pred > 0)
    recall = np.divide(hits, true, out=np.zeros(classes), where=true > 0)
    both = precision + recall
    f1 = np.divide(2 * precision * recall, both, out=np.zeros(classes), where=both > 0)
    return (one["loss"] / one["n"], float(hits.sum() / one["n"]), float(precision.mean()), float(recall.mean()),
            float(f1.mean()))


def train(bags: DataFrame, valid: DataFrame, nets: dict[int, Net], epochs: int = 100, batch_size: int = 512,
          lr: float = 0.1, patience: int = 5, mode: str = "<=", clip: float = 1.0, seed: int = 42,
          state_dir: str | None = None) -> Trained:
    """Train one network per ``model`` of ``bags`` (model, id, label, vec) on
    its own rows, and stop each after ``patience`` epochs without a better
    loss on ``valid`` (id, label, vec).

    Batches are fixed by ``seed``; every epoch meets them in an order of its
    own.  A step's gradient is the mean over its batch, clipped to the norm
    ``clip``.  With ``state_dir``, a folder that all executors share, each
    epoch is committed there, and a later call with the same arguments goes on
    after the last one committed."""
    if sum(n.size for n in nets.values()) > MOST_PARAMETERS:
        raise ValueError(f"the models have more than {MOST_PARAMETERS} parameters")
    spark = bags.sparkSession
    classes = next(iter(nets.values())).classes
    batches = lay_out(bags, classes, batch_size, seed)
    steps = (batches.agg(F.max("step")).first()[0] or 0) + 1
    held_out = materialize(ice_weights(valid.select("id", "vec", "label"), "label", batch_size, classes).select(
        F.lit(-1).alias("model"), "label", "weight", F.lit(-1).cast("long").alias("step"), "vec"))
    parts = max(1, -(-batch_size // PART_ROWS)) * len(nets)
    done, last = load(spark, state_dir) if state_dir else (None, -1)
    if done is None:
        start = {m: net.start(seed + m) for m, net in nets.items()}
        done = Trained({m: State(p, p) for m, p in start.items()})
    for epoch in range(last + 1, epochs):
        live = {m: nets[m] for m, s in done.states.items() if not s.stopped}
        if not live:
            break
        params = {m: done.states[m].params for m in live}
        met: dict[int, list] = {m: [] for m in live}
        for step in np.random.default_rng([seed, epoch]).permutation(steps).tolist():
            rows = batches.where((F.col("step") == step) & F.col("model").isin(list(live)))
            for m, one in collected(sums(rows, live, params, parts)).items():
                params[m] = params[m] - lr * clipped(one["grad"] / one["n"], clip)
                met[m].append(one | {"grad": None})
        checked = collected(sums(held_out, live, params, held_out_parts(held_out), learn=False))
        for m, net in live.items():
            state = done.states[m]
            state.params = params[m]
            trained = {"n": sum(o["n"] for o in met[m]), "loss": sum(o["loss"] for o in met[m]),
                       "cells": np.sum([o["cells"] for o in met[m]], axis=0)}
            done.history.append((m, epoch, "train", *scores(trained, net.classes)))
            done.history.append((m, epoch, "valid", *scores(checked[m], net.classes)))
            loss = checked[m]["loss"] / checked[m]["n"]
            better = state.best_loss is None or (loss <= state.best_loss if mode == "<=" else loss < state.best_loss)
            if better:
                state.best, state.best_loss, state.best_epoch, state.since = params[m], loss, epoch, 0
            else:
                state.since += 1
                state.stopped = state.since >= patience
        if state_dir:
            save(spark, state_dir, epoch, done)
    return done


def held_out_parts(held_out: DataFrame) -> int:
    """Files of a written table: no more tasks than that have rows of a model."""
    return max(1, len(held_out.inputFiles()))


def predict(rows: DataFrame, net: Net, flat: np.ndarray) -> DataFrame:
    """(id, label, prob) of one network."""
    sent = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            _, p = net.forward(sent.value, x) if b.num_rows else (None, np.zeros((0, net.classes)))
            at = pa.array(np.arange(len(p) + 1) * net.classes, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.ListArray.from_arrays(
                at, pa.array(p.ravel()))], names=["id", "label", "prob"])
    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "vec").mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, prob array<double>")


# ------------------------------------------------------------ committed epochs (M9)

STATE = ("model int, params binary, best binary, best_loss double, best_epoch int, since int, stopped boolean")


def save(spark: SparkSession, folder: str, epoch: int, done: Trained) -> None:
    """Commit an epoch: its history first, then the states, whose success file
    makes it count."""
    now = [h for h in done.history if h[1] == epoch]
    spark.createDataFrame(now, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/history/{epoch:06d}")
    rows = [(m, s.params.tobytes(), s.best.tobytes(), s.best_loss, s.best_epoch, s.since, s.stopped)
            for m, s in done.states.items()]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/{epoch:06d}")


def load(spark: SparkSession, folder: str) -> tuple[Trained | None, int]:
    """The last committed epoch, or (None, -1)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(f"{folder}/state")):
        return None, -1
    known = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{folder}/state"))
                   if fs.exists(path(f"{s.getPath().toString()}/_SUCCESS")))
    if not known:
        return None, -1
    states = {r["model"]: State(np.frombuffer(r["params"]), np.frombuffer(r["best"]), r["best_loss"], r["best_epoch"],
                                r["since"], r["stopped"])
              for r in spark.read.parquet(f"{folder}/state/{known[-1]}").collect()}
    history = [tuple(r) for k in known for r in spark.read.parquet(f"{folder}/history/{k}").orderBy("model", "split").collect()]
    return Trained(dict(sorted(states.items())), history), int(known[-1])
