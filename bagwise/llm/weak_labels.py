"""Expectation-maximisation over the votes of overlapping labelers."""

from __future__ import annotations

import math

import numpy as np

ROUNDS = 30
#: Votes' worth of the starting rates; keeps the classes from trading places.
PRIOR_VOTES = 4.0


def estimate(counts: list[tuple[str, tuple, int]], start_yes: float = 0.8, start_no: float = 0.2,
             rounds: int = ROUNDS, never: set[tuple] = frozenset()) -> dict[tuple, float]:
    """Two-class model of Dawid and Skene on (group, votes, n), n rows with
    equal votes: (group, votes) -> posterior of the positive class.

    A vote is 1, 0 or None (abstains, says nothing).  Each group has its own
    share of positives.  The rates of a labeler, which start at ``start_yes``
    (vote 1 on a positive) and ``start_no`` (on a negative), hold for all
    groups.  (group, votes) in ``never`` are known negatives; if there are any,
    the groups that have them teach the rates, and the others, whose rows could
    only confirm each other, learn their share by these rates.  ``counts`` has a row per vote pattern, at most 3^labelers in a group,
    whatever the corpus."""
    groups = sorted({g for g, _, _ in counts})
    labelers = range(len(counts[0][1])) if counts else ()
    share = dict.fromkeys(groups, 0.5)
    teaching = {g for g, _ in never} or set(groups)
    starts = (start_no, start_yes)
    rate = {(j, c): starts[c] for j in labelers for c in (0, 1)}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for group, votes, _ in counts:
            if (group, votes) in never:
                posterior[group, votes] = 0.0
                continue
            odds = math.log(share[group] / (1 - share[group]))
            for j, vote in enumerate(votes):
                if vote is not None:
                    yes, no = rate[j, 1], rate[j, 0]
                    odds += math.log(yes / no) if vote else math.log((1 - yes) / (1 - no))
            posterior[group, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for g in groups:
            mine = [(n, posterior[g, votes]) for own, votes, n in counts if own == g and (g, votes) not in never]
            share[g] = (sum(n * p for n, p in mine) + 1) / (sum(n for n, _ in mine) + 2)
        for j in labelers:
            for c in (0, 1):
                cast = [(votes[j], n * (posterior[g, votes] if c else 1 - posterior[g, votes]))
                        for g, votes, n in counts if votes[j] is not None and g in teaching]
                yes = sum(w for vote, w in cast if vote) + PRIOR_VOTES * starts[c]
                rate[j, c] = yes / (sum(w for _, w in cast) + PRIOR_VOTES)
    return posterior


#: How sure a firing labeler makes the start of ``kinds``.
START = 0.95


def kinds(counts: list[tuple[tuple, int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Latent classes of (levels, n), n rows with equal levels of the labelers
    (0: does not fire, more: fires more): levels -> posterior of being bad.

    There is one good class and one kind of bad for every labeler.  Kinds of
    junk shut each other out, so one bad class would take a labeler that does
    not fire for evidence of good; a kind learns which labelers overlap in it.
    The start takes rows with any firing for bad, of the kinds that fire.
    After each step a level's odds between a kind and good are made to rise
    with the level, so more firing never makes a row better: a labeler can be
    found worthless, but not turned round.  ``counts`` has a row per pattern,
    at most the product of the labelers' levels, whatever the corpus."""
    if not counts:
        return {}
    votes = np.array([v for v, _ in counts])
    n = np.array([c for _, c in counts], dtype=float)
    labelers = votes.shape[1]
    fired = votes > 0
    share = fired / np.maximum(fired.sum(axis=1, keepdims=True), 1)
    found = np.hstack([np.where(fired.any(axis=1), 1 - START, 1.0)[:, None], START * share])
    for _ in range(rounds):
        weight = n[:, None] * found
        log_share = np.log((weight.sum(axis=0) + 1) / (n.sum() + labelers + 1))
        log_odds = np.tile(log_share, (len(n), 1))
        for j in range(labelers):
            top = max(1, int(votes[:, j].max()))
            here = votes[:, j][:, None] == np.arange(top + 1)
            rate = np.empty((labelers + 1, top + 1))
            for c in range(labelers + 1):
                fires = 0.8 if c == j + 1 else 0.02
                prior = PRIOR_VOTES * np.append(1 - fires, np.full(top, fires / top))
                rate[c] = (weight[:, c] @ here + prior) / (weight[:, c].sum() + PRIOR_VOTES)
            for c in range(1, labelers + 1):
                rate[c] = rising(rate[c], rate[0])
            log_odds += np.log(rate).T[votes[:, j]]
        odds = np.exp(log_odds - log_odds.max(axis=1, keepdims=True))
        found = odds / odds.sum(axis=1, keepdims=True)
    return {v: float(1 - f[0]) for (v, _), f in zip(counts, found)}


def rising(rate: np.ndarray, good: np.ndarray) -> np.ndarray:
    """``rate`` with the ratio to ``good`` pooled over neighbouring levels
    until it rises with the level; the sum stays."""
    blocks: list[list[float]] = []     # [rate, good, levels]
    for r, g in zip(rate, good):
        blocks.append([r, g, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    ratio = np.concatenate([np.full(k, r / g) for r, g, k in blocks])
    return ratio * good
