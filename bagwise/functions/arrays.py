"""Probability-vector expressions on ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bagwise.functions.constants import ARGMAX_PLACES, EPS, FOCAL_ALPHA, FOCAL_GAMMA  # noqa: E402,F401


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: the optimizer puts an
    expression named in a lambda in its place, once per element."""
    return F.transform(F.array(value), body)[0]


def softmax(scores) -> Column:
    """exp(s - max) / sum (P11), in one pass: the accumulator keeps the
    running max and the sum rescaled to it; the finish step builds the
    output from the bound accumulator.  (A row-level max or sum referenced
    inside a per-element lambda would be re-evaluated for every element.)"""
    s = _c(scores)

    def step(acc, x):
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"),
                        (acc["z"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("z"))

    init = F.struct(F.element_at(s, 1).alias("m"), F.lit(0.0).alias("z"))
    return F.aggregate(s, init, step,
                       lambda acc: F.transform(s, lambda x: F.exp(x - acc["m"]) / acc["z"]))


def round_array(p, places: int = 9) -> Column:
    return F.transform(_c(p), lambda x: F.round(x, places))


def argmax(p, places: int | None = 9) -> Column:
    """0-based index of the first maximum (lowest class wins ties)."""
    a = round_array(p, places) if places is not None else _c(p)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def prob_at(p, label) -> Column:
    """p[label] with a 0-based label (P10 used as a lookup)."""
    return F.element_at(_c(p), _c(label) + 1)


def one_hot(label, num_classes: int) -> Column:
    """Target vector with 1.0 at ``label`` (P10)."""
    lab = _c(label)
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                       lambda c: F.when(c == lab, 1.0).otherwise(0.0))


def vote_one_hot(p, num_classes: int) -> Column:
    """1 at the argmax, 0 elsewhere."""
    return one_hot(argmax(p), num_classes)


def class_counts(values, num_classes) -> Column:
    """Counts of each class 0..n-1 in an int array, in one pass (votes)."""
    n = num_classes if isinstance(num_classes, Column) else F.lit(num_classes)
    init = F.array_repeat(F.lit(0.0), n)
    return F.aggregate(_c(values), init,
                       lambda acc, v: F.transform(acc, lambda x, i: x + F.when(i == v, 1.0)
                                                  .otherwise(0.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def elementwise_mean(arrays) -> Column:
    """Mean of an ARRAY<ARRAY<DOUBLE>> position by position."""
    arr = _c(arrays)
    first = F.element_at(arr, 1)
    n = F.size(arr).cast("double")
    return F.transform(
        first,
        lambda _, i: F.aggregate(arr, F.lit(0.0),
                                 lambda acc, v: acc + F.element_at(v, i + 1)) / n)


def ce_row(p, label) -> Column:
    """-log(p_y + 1e-9) (L1)."""
    return -F.log(prob_at(p, label) + F.lit(EPS))


def fce_row(p, label, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    """-alpha (1-p_y)^gamma log(p_y + 1e-9) (L2)."""
    py = prob_at(p, label)
    return -(F.pow(F.lit(1.0) - py, F.lit(gamma)) * F.lit(alpha) * F.log(py + F.lit(EPS)))
