"""Text features counted row by row, without a shuffle of tokens."""

import hashlib
from collections import Counter

import pytest

from bagwise.operators.textfeat import hashed_terms

ROWS = [None, "", "a", "ab", "abc", " \x0bA b\t\tc\n\n", "\u0130stanbul \u03a3\u0391\u03a3 \xe9 \u6f22\u5b57\U0001f600x\x00\x00\x00\x00",
        "\U0001f600", "a b", "   ", "b", "$1 \\d (x)"] * 3


def shares(words, dims):
    n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in words)
    return tuple(n[p] / len(words) if words else 0.0 for p in range(dims))


def words(text):
    return [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]


@pytest.mark.parametrize("rows", [
    [(i, t) for i, t in enumerate(ROWS)],
    [(1, "a B c"), (1, "x y a a"), (2, None), (2, "q"), (3, ""), (4, "z z y"), (5, ""), (5, "  ")],
])
def test_features_of_single_and_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    own = {}
    for i, t in rows:
        own.setdefault(i, []).extend(words(t))
    got = Counter((r.id, tuple(r.vec)) for r in hashed_terms(df, 8).collect())
    assert got == Counter((i, shares(own[i], 8)) for i, _ in rows)


def test_rows_without_an_id_have_no_features(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "a")], "id string, text string")
    got = sorted((r.id or "", sum(r.vec)) for r in hashed_terms(df, 8).collect())
    assert got == [("", 0.0), ("", 0.0), ("1", 1.0)]


def test_single_ids_shuffle_no_features(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(9)], "id long, text string")
    assert "Exchange" not in hashed_terms(df, 8)._jdf.queryExecution().executedPlan().toString()
