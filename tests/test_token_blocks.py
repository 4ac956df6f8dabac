"""Tokens counted by blocks of texts, without a row per token."""

from collections import Counter

import pytest

from bagwise.operators import encode as enc

ROWS = [None, "", "a", "ab", "abc", " \x0bA b\t\tc\n\n", "\u0130stanbul \u03a3\u0391\u03a3 \xe9 \u6f22\u5b57\U0001f600x\x00\x00\x00\x00",
        "\U0001f600", "a b", "   ", "b", "$1 \\d (x)"] * 3


def tables(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "id long, text string").repartition(3)


@pytest.mark.parametrize("view", [enc.View("w"), *[enc.View("c", "char", n) for n in (1, 2, 3, 4, 7)]])
def test_counts_equal_every_token(spark, view):
    df = tables(spark)
    want = Counter(t for r in enc.with_tokens(df, "text", view, "t").collect() for t in r.t)
    got = Counter()
    for r in enc.token_counts(df, view).collect():
        got[r.token] += r.n
    assert got == want


@pytest.mark.parametrize("name,value", [("BLOCK_BYTES", 12), ("HELD_TOKENS", 4)])
@pytest.mark.parametrize("view", [enc.View("w"), enc.View("c", "char", 3), enc.View("c", "char", 5)])
def test_small_blocks_and_little_memory(spark, monkeypatch, name, value, view):
    df = tables(spark)
    want = Counter(t for r in enc.with_tokens(df, "text", view, "t").collect() for t in r.t)
    monkeypatch.setattr(enc, name, value)
    rows = enc.token_counts(df, view).collect()
    got = Counter()
    for r in rows:
        got[r.token] += r.n
    assert got == want


def test_words_do_not_run_on_into_the_next_text():
    import pyarrow as pa
    (data, at), = enc.text_blocks(pa.array(["xx", "ab c", None, "d", " ", "e"])[1:])
    words, per_text = enc.split_words(data, at)
    assert words.to_pylist() == ["ab", "c", "d", "e"] and per_text.tolist() == [2, 0, 1, 0, 1]


def test_counting_makes_no_row_per_token(spark):
    """A task hands on a count per different token, not a row per token."""
    df = spark.createDataFrame([("a b " * 5000,)] * 20, "text string").coalesce(2)
    for view, least in ((enc.View("w"), 2), (enc.View("c", "char", 3), 4)):
        assert enc.token_counts(df, view).count() <= 2 * least
    plan = enc.vocab(df, [enc.View("w")], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
