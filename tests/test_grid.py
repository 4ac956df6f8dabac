"""Blocks of the subset grid, vocabularies beyond a broadcast, sized bag files."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagwise.operators import encode as enc
from bagwise.operators import subsets
from bagwise.sources import sinks


def test_subset_blocks_equal_the_whole_tree(spark):
    r = np.random.default_rng(5)
    k, C, n = 6, 7, 80
    rows = [(int(i % C), r.dirichlet(np.ones(C), k).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "label int, probs array<array<double>>").repartition(3)
    whole = Counter(tuple(x) for x in subsets.subset_counts(df, k).collect())
    for fixed in (1, 3, 6):
        assert Counter(tuple(x) for x in subsets.subset_counts(df, k, fixed=fixed).collect()) == whole
    assert {x[0] for x in whole} == set(range(2 ** k))


def test_twenty_models_of_225_classes_fit_a_task():
    fixed = subsets.fixed_models(20, 225)
    assert 16 * 2 ** (20 - fixed) * 225 <= subsets.TASK_BYTES and fixed <= 4
    assert subsets.fixed_models(14, 225) == 0


def test_metrics_by_blocks_equal_metrics_of_the_whole_tree(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(int(i % 3), r.dirichlet(np.ones(3), 4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, probs array<array<double>>")
    classes = spark.range(3).select(F.col("id").cast("int").alias("label"))
    names = ["a", "b", "c", "d"]
    want = Counter(tuple(x) for x in subsets.subset_metrics(df, names, classes).collect())
    monkeypatch.setattr(subsets, "fixed_models", lambda k, c: 2)
    assert Counter(tuple(x) for x in subsets.subset_metrics(df, names, classes).collect()) == want and len(want) == 15


@pytest.mark.parametrize("head", [0, 1, 5, 40])
def test_encoding_with_a_vocabulary_beyond_the_broadcast(spark, head):
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.4, 30) if x < 60) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], "", None, "unseen w1 w1"])],
                                 "id long, text string").repartition(3)
    view = enc.View("words")
    vocab = enc.vocab(docs.where("text <> 'unseen w1 w1'"), [view], 40).cache()
    want = {x.id: x.words for x in enc.encode(docs, vocab, view, 12).collect()}
    got = enc.encode(docs, vocab, view, 12, broadcast_vocab=head)
    assert got.columns == ["id", "text", "words"]
    assert {x.id: x.words for x in got.collect()} == want and len(want) == 54


def test_bag_files_have_about_equal_sizes(spark, tmp_path):
    # 20 bags, one of which has half of all rows
    rows = [(b, i, "x" * 50) for b in range(20) for i in range(1900 if b == 7 else 100)]
    bags = spark.createDataFrame(rows, "bag_id int, id long, data string").repartition(5)
    per_row = 50 + 4 + 8 + 8
    path = str(tmp_path / "bags")
    sinks.write_bags(bags, path, file_bytes=200 * per_row)
    files = {b: [f for f in os.listdir(f"{path}/bag_id={b}") if f.endswith(".parquet")] for b in range(20)}
    assert {b: len(f) for b, f in files.items()} == {b: 10 if b == 7 else 1 for b in range(20)}
    hot = [spark.read.parquet(f"{path}/bag_id=7/{f}").count() for f in files[7]]
    assert sum(hot) == 1900 and max(hot) < 1.4 * min(hot)
    back = spark.read.parquet(path).select("bag_id", "id", "data")
    assert Counter(tuple(r) for r in back.collect()) == Counter(rows)
    sinks.write_bags(bags.limit(0), str(tmp_path / "none"))
