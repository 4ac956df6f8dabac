"""Signs of junk that the quality labelers must see."""

import itertools
from collections import Counter

import numpy as np
import pytest

from bagwise.llm import quality_model
from bagwise.llm.weak_labels import kinds
from tests.llm.rows import frame, prose


def fired(spark, texts):
    out = quality_model.observe(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    return {r.doc_id: {c[6:] for c in out.columns if c.startswith("fires_") and r[c]} for r in out.collect()}


def test_runs_of_equal_words_fire(spark):
    runs = [" ".join(f"{w} " * k for w in prose(k, 40).split()) for k in range(2, 9)]
    plain = [prose(50, 60), "it was very very good and " + prose(51, 30), "", "word"]
    found = fired(spark, runs + plain)
    assert all("echoes" in found[i] for i in range(len(runs)))
    assert not any(found[len(runs) + i] for i in range(len(plain)))


def test_odd_words_fire(spark):
    odd = ["~~~ @@@ " + " ".join(w + "^^^" for w in prose(60, 40).split()), " ".join(f"{w}4{w}7" for w in prose(61, 40).split()),
           " ".join(f"{w} === {{}}" for w in prose(62, 30).split())]
    plain = ["It's 20% off (or so), he said: \"yes\" — see pages 3-4/5; café, ¿qué? " + prose(63, 30).capitalize() + "."]
    found = fired(spark, odd + plain)
    assert all("odd_words" in found[i] for i in range(3)) and not found[3]


LABELERS = 7


@pytest.mark.parametrize("part", [0.01, 0.1, 0.4])
@pytest.mark.parametrize("only", [None, *range(LABELERS)])
def test_every_mix_of_junk_is_bad(part, only):
    """Each kind alone, or all together, at any share; firings by accident stay few."""
    rng = np.random.default_rng(only or 0)
    rows = 4000
    bad = np.arange(rows) < part * rows
    votes = (rng.random((rows, LABELERS)) < 0.02 * part).astype(int)
    kind = rng.integers(0, LABELERS, rows) if only is None else np.full(rows, only)
    votes[bad, kind[bad]] = rng.integers(1, 3, bad.sum())
    # Labelers 3 to 5 overlap: repeats, echoes and lines fire together more often than not.
    together = bad & (kind >= 3) & (kind <= 5)
    for j in (3, 4, 5):
        votes[together & (rng.random(rows) < 0.6), j] |= 1
    counts = Counter(map(tuple, votes.tolist()))
    posterior = kinds(sorted(counts.items()))
    judged = np.array([posterior[tuple(v)] for v in votes.tolist()])
    assert (judged[bad] > 0.5).all()
    assert (judged[~bad & (votes == 0).all(axis=1)] < 0.1).all()


def test_more_firing_never_makes_a_row_better():
    rng = np.random.default_rng(9)
    for _ in range(20):
        every = list(itertools.product((0, 1, 2), (0, 1), (0, 1, 2), (0, 1)))
        posterior = kinds([(v, int(n)) for v, n in zip(every, rng.integers(1, 1000, len(every)))])
        for v, w in itertools.product(every, every):
            if all(x <= y for x, y in zip(v, w)):
                assert posterior[v] <= posterior[w] + 1e-9
