"""Vocabularies from mergeable frequent-token summaries."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagwise.operators import encode as enc

WORD = enc.View("word", "word")


def texts(seed, docs=240):
    r = random.Random(seed)
    return [" ".join([f"w{min(int(r.paretovariate(0.7)), 10 ** 6)}" for _ in range(r.randint(0, 60))]
                     + [f"rare{i}x{j}" for j in range(20)]) for i in range(docs)]


def table(spark, rows, parts):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(parts)


@pytest.mark.parametrize("counters", [1, 30, 100, 400, 100_000])
@pytest.mark.parametrize("size", [1, 20, 7000])
def test_equal_to_counting_every_token(spark, size, counters):
    rows = texts(1) + [None, "", "  "]
    plain = enc.vocab(table(spark, rows, 3), [WORD], size).collect()
    assert Counter(map(tuple, plain)) == Counter(map(tuple, enc.vocab(table(spark, rows, 3), [WORD], size,
                                                                     counters=counters).collect()))


def test_summaries_bound_every_count(spark):
    rows = texts(2)
    true = Counter(w for t in rows for w in t.split())
    tokens = table(spark, rows, 4).select(F.explode(F.split("text", " ")).alias("token"))
    found = enc.token_summaries(tokens, 60).collect()
    taken = sum(r.n for r in found if r.token is None)
    low = Counter()
    for r in found:
        if r.token is not None:
            low[r.token] += r.n
    assert taken > 0 and sum(r.token is None for r in found) == 4 and len(found) <= 4 * 61
    assert all(low[w] <= n <= low[w] + taken for w, n in true.items())
    assert taken <= 4 + sum(true.values()) // 60      # each unit taken off costs 61 occurrences


def test_only_tokens_that_can_be_frequent_are_counted(spark):
    rows = ["a a a a b b b c c " + " ".join(f"r{i}x{j}" for j in range(30)) for i in range(300)]
    tokens = table(spark, rows, 2).select(F.explode(F.split("text", " ")).alias("token"))
    got = {r.token: r.n for r in enc.frequent_tokens(tokens, 3, 50).collect()}
    assert {w: got[w] for w in "abc"} == {"a": 1200, "b": 900, "c": 600} and len(got) < 200


def test_ties_at_the_end_and_empty_tables(spark):
    tied = table(spark, ["b a", "a b c c", "d e f"], 2)
    for counters in (1, 2, 50):
        got = enc.vocab(tied, [WORD], 2, counters=counters).orderBy("token_id").collect()
        assert [(r.token, r.n) for r in got] == [("a", 2), ("b", 2)]
    assert enc.vocab(table(spark, [], 1), [WORD], 5, counters=4).count() == 0


@pytest.mark.parametrize("limit", [None, 1, 4, 50])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_char_windows_are_of_code_points(spark, n, limit):
    rows = ["", "a", "ab", "\U0001f600\U0001f601x\U0001f602", "été\n\r\nñ 日本語", "Áb" * 7, "$1 \\d (x)", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r.id: r.t for r in enc.with_tokens(df, "text", enc.View("c", "char", n), "t", limit).collect()}
    for i, text in enumerate(rows):
        low = (text or "").lower()
        assert got[i] == [low[j:j + n] for j in range(len(low) - n + 1)][:limit]
