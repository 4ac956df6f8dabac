"""Stratified split, bagging, out-of-bag sets, upsampling (R1-R13, D1, D4,
D5, J3, F4, A3).

Every draw is a seeded md5 hash, so the same rows are chosen on any cluster
layout.  Sizes are decided on the class histogram (one row per stratum);
rows are chosen by the exact bucketed rank of ``strata.stratified_rank``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagwise.functions import constants as K
from bagwise.functions.codes import TEXT_COLS, any_text
from bagwise.functions.hashing import draw_index, order_key, uniform, uniform_from_key
from bagwise.operators.digests import rows_in_one
from bagwise.operators.strata import checked_broadcast, first_k, rank_by_key

# ---------------------------------------------------------------- sizes


def test_size(n: Column, ratio: Column) -> Column:
    """Test rows of a class of size n (R1): <3 -> 0, <=5 -> 1, <=10 -> 2,
    <100 -> int(8/90 n + 10/9), else int(n * ratio); DOUBLE arithmetic."""
    nd = n.cast("double")
    slope = F.lit(K.SPLIT_SLOPE[0]) / F.lit(K.SPLIT_SLOPE[1])
    icept = F.lit(K.SPLIT_INTERCEPT[0]) / F.lit(K.SPLIT_INTERCEPT[1])
    return (F.when(n < K.SPLIT_NONE_BELOW, F.lit(0))
            .when(n <= K.SPLIT_ONE_UP_TO, F.lit(1))
            .when(n <= K.SPLIT_TWO_UP_TO, F.lit(2))
            .when(n < K.SPLIT_LINEAR_BELOW, F.floor(slope * nd + icept))
            .otherwise(F.floor(nd * ratio))).cast("long")


def class_hist(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per stratum (A1 generalised)."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def _outer(strata: Sequence[str], label: str = "label") -> list[str]:
    return [s for s in strata if s != label]


def _take_first_k(df: DataFrame, hist_k: DataFrame, strata: Sequence[str],
                  key: Column, flag: str) -> DataFrame:
    """Flag the first k rows (by ``key`` then id) of every stratum."""
    return first_k(df.withColumn("_key", key), hist_k, strata, "_key", "id", flag) \
        .drop("_key")


# ---------------------------------------------------------------- split


def stratified_split(df: DataFrame, num_test: int | None = None,
                     test_ratio: float | None = None, seed: int = 42,
                     strata: Sequence[str] = ("label",)) -> DataFrame:
    """Add ``split`` in {'train','test'}.

    With ``num_test`` the ratio is num_test / rows, per outer stratum (per
    bag when strata = (bag_id, label)).  Test = first k rows of the class in
    the order md5('seed:split[:bag]:id'), then id."""
    strata = list(strata)
    outer = _outer(strata)
    hist = class_hist(df, strata)
    if num_test is not None:
        total = F.sum("n").over(Window.partitionBy(*outer)) if outer else \
            F.sum("n").over(Window.partitionBy())
        ratio = F.lit(float(num_test)) / total.cast("double")
    elif test_ratio is not None:
        ratio = F.lit(float(test_ratio))
    else:
        raise ValueError("give num_test or test_ratio")
    hist_k = hist.withColumn("_k", test_size(F.col("n"), ratio))
    key = order_key(seed, "split", *outer, "id")
    out = _take_first_k(df, hist_k, strata, key, "_is_test")
    return out.withColumn("split", F.when(F.col("_is_test"), "test").otherwise("train")) \
        .drop("_is_test")


# ---------------------------------------------------------------- bags


def same_size_expr(n: Column, e: float, m: int, formula: str = "same") -> Column:
    """Per-class bag size: n <= m -> n, else int(a n + b)."""
    if formula == "same":
        a, b = e, m - m * e
    elif formula == "nb":
        a, b = (100 * e - m) / (100 - m), 100 * m * (1 - e) / (100 - m)
    else:
        raise ValueError(f"unknown formula {formula!r}")
    return F.when(n <= m, n).otherwise(
        F.floor(F.lit(a) * n.cast("double") + F.lit(b))).cast("long")


def _bag_pairs(df: DataFrame, k_table: DataFrame, estimators: int, seed: int,
               prune: bool) -> DataFrame:
    """(row, bag) pairs with their order key, pruned to a prefix of the order.

    A row of class c enters the rank of bag b only if u(key) < q_c, with q_c
    far above k_c/n_c; since u is monotone in the key, the kept rows are a
    prefix of the order and their ranks are exact as long as at least k_c are
    kept -- checked, and classes that miss are redone unpruned."""
    pairs = df.withColumn("bag_id", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
    pairs = pairs.withColumn("_key", order_key(seed, "bag", "bag_id", "id"))
    if not prune:
        return pairs
    q = F.least(F.lit(1.0), (F.col("_k") + 8 * F.sqrt(F.col("_k").cast("double")) + 16)
                / F.col("n").cast("double"))
    qt = checked_broadcast(k_table.select("label", q.alias("_q")))
    return (pairs.join(qt, "label").where(uniform_from_key(F.col("_key")) < F.col("_q"))
            .drop("_q"))


def bag_same(train: DataFrame, estimators: int, num_samples: int,
             min_cat_data: int = K.MIN_CAT_DATA,
             seed: int = 42, formula: str = "same", prune: bool = True) -> DataFrame:
    """K bags in one DataFrame keyed by ``bag_id`` (R3, R4, R6): per class
    the first k rows in the bag's own hash order, so no row twice in a bag."""
    hist = class_hist(train, ["label"]).cache()
    total = hist.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        raise ValueError("empty input")
    e = num_samples / total
    if e > 1:
        raise ValueError(f"num_samples {num_samples} exceeds the {total} rows")
    k_table = hist.withColumn("_k", same_size_expr(F.col("n"), e, min_cat_data, formula)).cache()
    # 'same' sizes are >= min_cat_data; the notebook formula can go negative
    if formula != "same" and k_table.where(F.col("_k") < 0).limit(1).count():
        raise ValueError("negative bag size for some class; raise num_samples")
    return _bags_from_sizes(train, k_table, estimators, seed, prune)


def _bags_from_sizes(train: DataFrame, k_table: DataFrame, estimators: int, seed: int,
                     prune: bool, per_bag: bool = False) -> DataFrame:
    """Rows for given sizes; ``k_table`` has (label, n, _k) or, with
    ``per_bag``, (bag_id, label, n, _k)."""
    strata = ["bag_id", "label"]
    if per_bag:
        pairs = train.withColumn("bag_id", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
        pairs = pairs.withColumn("_key", order_key(seed, "bag", "bag_id", "id"))
        hk = k_table
    else:
        pairs = _bag_pairs(train, k_table, estimators, seed, prune)
        hk = k_table.withColumn("bag_id", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
        if prune:
            kept = pairs.groupBy(*strata).agg(F.count(F.lit(1)).alias("_kept"))
            short = (hk.join(kept, strata, "left")
                     .where(F.coalesce("_kept", F.lit(0)) < F.col("_k"))
                     .select("label").distinct().collect())
            if short:
                redo = [r[0] for r in short]
                full = _bag_pairs(train.where(F.col("label").isin(redo)), k_table,
                                  estimators, seed, prune=False)
                pairs = pairs.where(~F.col("label").isin(redo)).unionByName(full)
    hk = hk.withColumn("bag_id", F.col("bag_id").cast("int"))
    pairs = pairs.withColumn("bag_id", F.col("bag_id").cast("int"))
    # stratum size for the bucket width: rows of the class (an upper bound
    # of the pairs kept after pruning)
    return (first_k(pairs.drop("_q", "n") if "n" in pairs.columns else pairs,
                    hk.select(*strata, "n", "_k"), strata, "_key", "id", "_in")
            .where(F.col("_in")).drop("_key", "_in"))


def bag_random(train: DataFrame, estimators: int, num_samples: int,
               min_cat_data: int = K.MIN_CAT_DATA, seed: int = 42, cut_std: int = K.CUT_STD, max_attempts: int = 10_000,
               draw: str = "pool") -> DataFrame:
    """Bags with random class sizes (R5, F4); rows as in ``bag_same``."""
    sizes = random_bag_sizes(train, estimators, num_samples, min_cat_data, seed,
                             cut_std, max_attempts, draw)
    return _bags_from_sizes(train, sizes, estimators, seed, prune=False, per_bag=True)


def random_bag_sizes(train: DataFrame, estimators: int, total: int,
                     min_cat_data: int = K.MIN_CAT_DATA, seed: int = 42,
                     cut_std: int = K.CUT_STD,
                     max_attempts: int = 10_000, draw: str = "pool") -> DataFrame:
    """Class sizes per bag for the 'random' bag distribution.

    Attempt i draws s_c uniform in [min(m, n_c), n_c].  Redraw while the sum
    is below ``total``.  When above: if the classes with s_c < cut_std sum
    to <= total they keep their sizes and the rest (total - that sum) is
    shared among the large classes by drawing without replacement from a
    pool holding each large label s_c times; else cut_std -= 100 and redraw.
    ``draw``: "pool" ranks a row per token of that pool, "histogram" draws the
    counts of its law from the class sizes (other draws, the same law).
    All work is on the (bag, label) histogram; the driver sees per-bag sums."""
    if draw not in DRAWS:
        raise ValueError(f"unknown draw {draw!r}")
    spark = train.sparkSession
    hist = class_hist(train, ["label"]).cache()
    if (hist.agg(F.sum("n")).first()[0] or 0) < total:
        raise ValueError("total exceeds the rows available; the draw cannot reach it")
    state = {b: (0, cut_std) for b in range(estimators)}   # bag -> (attempt, cut)
    done: dict[int, tuple[int, int, str]] = {}
    grid = (hist.withColumn("bag_id", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
            .withColumn("bag_id", F.col("bag_id").cast("int")).cache())
    for _ in range(max_attempts):
        todo = [b for b in state if b not in done]
        if not todo:
            break
        att = spark.createDataFrame([(b, a + i, c) for b, (a, c) in state.items() if b in todo
                                     for i in range(ATTEMPT_BLOCK)],
                                    "bag_id int, attempt int, cut int")
        drawn = _draw_sizes(grid.join(F.broadcast(att), "bag_id"), seed, min_cat_data)
        sums = {(r["bag_id"], r["attempt"]): (r["s"], r["small"])
                for r in drawn.groupBy("bag_id", "attempt").agg(
            F.sum("s").alias("s"),
            F.sum(F.when(F.col("s") < F.col("cut"), F.col("s")).otherwise(0)).alias("small"))
            .collect()}
        for b in todo:
            a, c = state[b]
            for i in range(a, a + ATTEMPT_BLOCK):
                s, small = sums[b, i]
                state[b] = (i + 1, c)
                if s == total or (s > total and small <= total):
                    done[b] = (i, c, "exact" if s == total else "cut")
                    break
                if s > total:
                    # the cut keeps falling; at <= min size no class is small.
                    # Later draws of this block were summed under the old cut.
                    state[b] = (i + 1, c - K.CUT_STEP)
                    break
    else:
        raise ValueError("no size draw reached the total within max_attempts")
    final = spark.createDataFrame([(b, a, c, m) for b, (a, c, m) in done.items()],
                                  "bag_id int, attempt int, cut int, mode string")
    drawn = _draw_sizes(grid.join(F.broadcast(final), "bag_id"), seed, min_cat_data)
    return DRAWS[draw](drawn, total, seed)


# tokens made in one go, partitions of the token pool, size draws tried in one job
POOL_BLOCK = 100_000
MAX_POOL_PARTITIONS = 2_000
ATTEMPT_BLOCK = 32


def _draw_sizes(grid: DataFrame, seed: int, m: int) -> DataFrame:
    lo = F.least(F.lit(m), F.col("n"))
    u = uniform(seed, "size", "bag_id", "attempt", "label")
    return grid.withColumn("s", (lo + F.floor(u * (F.col("n") - lo + 1).cast("double"))).cast("long"))


def _share_large(drawn: DataFrame, total: int, seed: int) -> DataFrame:
    """Bags in 'cut' mode: small classes keep s; the large ones get the
    counts of a draw without replacement of (total - small) tokens from the
    pool of their labels (each label s times); a label drawn 0 times gets 0."""
    small_sum = F.sum(F.when(F.col("s") < F.col("cut"), F.col("s")).otherwise(0)) \
        .over(Window.partitionBy("bag_id"))
    d = drawn.withColumn("_save", F.lit(total) - small_sum)
    is_large = (F.col("mode") == "cut") & (F.col("s") >= F.col("cut"))
    # Tokens are made block by block, the blocks dealt over the cluster: no
    # task and no array holds a whole class.
    last = F.floor((F.col("s") - 1) / POOL_BLOCK)
    blocks = d.where(is_large).withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    n_blocks = blocks.count()
    pool = (blocks.repartition(min(MAX_POOL_PARTITIONS, max(2, n_blocks)), "bag_id", "label", "_blk")
            .withColumn("tok", F.explode(F.sequence(
                F.col("_blk") * POOL_BLOCK + 1,
                F.least(F.col("s"), (F.col("_blk") + 1) * POOL_BLOCK))))
            .drop("_blk")
            .withColumn("_key", order_key(seed, "pool", "bag_id", "label", "tok"))
            .withColumn("id", F.col("tok")))
    max_pool = pool.groupBy("bag_id").count().agg(F.max("count")).first()[0] or 0
    ranked = rank_by_key(pool, ["bag_id"], "_key", "label", rank_col="_r",
                         max_rows=int(max_pool))
    got = (ranked.where(F.col("_r") <= F.col("_save"))
           .groupBy("bag_id", "label").agg(F.count(F.lit(1)).alias("_got")))
    out = d.join(got, ["bag_id", "label"], "left").withColumn(
        "_k", F.when(is_large, F.coalesce("_got", F.lit(0))).otherwise(F.col("s")).cast("long"))
    return out.select("bag_id", "label", "n", "_k")


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The number of good tokens among ``draws`` of good + bad, drawn without
    replacement: how many of the cumulative probabilities are at most ``u``.

    Probabilities follow from each other by their ratios.  Those more than
    5 sqrt(n) + 1 from the mean, n the least of the four margins, sum up to
    less than 1e-21 (Hoeffding), far below the steps of ``u``, and are left
    out, so the cost is that of sqrt(n) and not of the tokens."""
    least, most = max(0, draws - bad), min(draws, good)
    if least == most:
        return least
    reach = 5 * math.sqrt(min(good, bad, draws, good + bad - draws)) + 1
    mean = draws * (good / (good + bad))
    lo, hi = max(least, math.floor(mean - reach)), min(most, math.ceil(mean + reach))
    k = np.arange(lo, hi, dtype=float)
    step = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + min(int(np.searchsorted(upto, u * upto[-1], side="right")), hi - lo)


def _draw_large(drawn: DataFrame, total: int, seed: int) -> DataFrame:
    """As ``_share_large``, on the histogram: the counts of the large classes
    are multivariate hypergeometric, drawn class by class in label order, each
    from what the classes before it left.  One group per bag of a row per
    class; no tokens are made."""
    d = drawn.withColumn("_u", uniform(seed, "share", "bag_id", "label"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label")
        large = ((rows["mode"] == "cut") & (rows["s"] >= rows["cut"])).to_numpy()
        sizes = [int(x) for x in rows["s"]]
        pool = sum(s for s, big in zip(sizes, large) if big)
        left = total - sum(s for s, big in zip(sizes, large) if not big)
        got = []
        for s, big, u in zip(sizes, large, rows["_u"]):
            if big:
                pool -= s
                s = hypergeometric(s, pool, left, u)
                left -= s
            got.append(s)
        return rows[["bag_id", "label", "n"]].assign(_k=got)

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.groupBy("bag_id").applyInPandas(
        draw, ", ".join(f"{c} {kinds[c]}" for c in ("bag_id", "label", "n")) + ", _k long")


DRAWS = {"pool": _share_large, "histogram": _draw_large}


# ---------------------------------------------------------------- out of bag


def sampled_rows(bags: DataFrame) -> DataFrame:
    """Distinct union of all bags."""
    return bags.drop("bag_id").dropDuplicates()


def oob_by_rows(data: DataFrame, bags: DataFrame) -> DataFrame:
    """Rows appearing exactly once in data ++ distinct(bags) (R7, D5); a
    full-row duplicate inside ``data`` disappears too.  Decided on digests:
    the bags' texts are not shuffled, the data's once."""
    return rows_in_one(data, bags.drop("bag_id"))


def oob_by_id(train: DataFrame, bags: DataFrame) -> DataFrame:
    """Train rows whose id is in no bag."""
    return train.join(bags.select("id").distinct(), "id", "left_anti")


def test_plus_oob(test: DataFrame, oob: DataFrame) -> DataFrame:
    """Append the out-of-bag rows to the test set with a ``source`` flag."""
    return (test.withColumn("source", F.lit("test"))
            .unionByName(oob.withColumn("source", F.lit("oob")).select(
                *test.columns, "source")))


def bag_stats(bags: DataFrame) -> DataFrame:
    """Rows and distinct classes per bag (A3)."""
    return bags.groupBy("bag_id").agg(F.count(F.lit(1)).alias("rows"),
                                      F.countDistinct("label").alias("classes"))


# ---------------------------------------------------------------- upsampling

UPSAMPLE_METHODS = ("uniform", "random", "shuffle")


def upsample(df: DataFrame, method: str, minimum: int = K.UPSAMPLE_MINIMUM, seed: int = 42,
             strata: Sequence[str] = ("label",), text_cols: Sequence[str] = TEXT_COLS
             ) -> DataFrame:
    """Bring every stratum below ``minimum`` rows up to ``minimum``.

    Output columns: strata, id, texts, ``draw`` (0 = original row, 1.. =
    generated).  Strata at or above ``minimum`` are untouched."""
    strata = list(strata)
    base = df.select(*strata, "id", *text_cols).withColumn("draw", F.lit(0))
    if method == "":
        return base.withColumn("draw", F.col("draw").cast("long"))
    if method not in UPSAMPLE_METHODS:
        raise ValueError(f"unknown upsample method {method!r}")
    hist = (df.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(any_text(text_cols).cast("int")).alias("n_ok"))
        .where(F.col("n") < minimum)).cache()
    if hist.where((F.col("n_ok") == 0)).limit(1).count():
        if method != "uniform" or hist.where(
                (F.col("n_ok") == 0) & (F.lit(minimum) % F.col("n") > 0)).limit(1).count():
            raise ValueError("a class to upsample has only empty texts")
    small = checked_broadcast(hist)
    rows = df.select(*strata, "id", *text_cols).join(small, strata, "inner")
    if method == "uniform":
        gen = _upsample_uniform(rows, minimum, seed, strata, text_cols)
    elif method == "random":
        gen = _upsample_random(rows, minimum, seed, strata, text_cols)
    else:
        gen = _upsample_shuffle(rows, hist, minimum, seed, strata, text_cols)
    return base.unionByName(gen.select(*strata, "id", *text_cols, "draw")) \
        .withColumn("draw", F.col("draw").cast("long"))


def _class_rank(rows: DataFrame, strata, order: Column, name: str) -> DataFrame:
    # strata here are classes below ``minimum``: each window holds < minimum rows
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*strata).orderBy(order)))


def _upsample_uniform(rows, minimum, seed, strata, text_cols):
    """minimum // n copies of every row, plus minimum % n rows without
    replacement among rows with some text, cycled if too few (R12)."""
    outer = _outer(strata)
    key = order_key(seed, "uniform", *outer, "label", "id")
    reps = F.floor(F.lit(minimum) / F.col("n")).cast("int")
    rem = (F.lit(minimum) % F.col("n")).cast("int")
    copies = (rows.withColumn("_c", F.explode(F.sequence(F.lit(2), F.greatest(reps, F.lit(2)))))
              .where(F.col("_c") <= reps)
              .withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("id", "_c"))))
    copies = copies.withColumn("draw", F.col("_r"))
    ok = _class_rank(rows.where(any_text(text_cols)), strata, key, "_rk")
    # remainder draw j takes the ok-row of rank ((j-1) mod n_ok) + 1
    extra = (ok.withColumn("_j", F.explode(F.sequence(F.col("_rk"), F.greatest(rem, F.col("_rk")),
                                                     F.col("n_ok"))))
             .where(F.col("_j") <= rem)
             .withColumn("draw", (reps - 1) * F.col("n") + F.col("_j")))
    return copies.unionByName(extra, allowMissingColumns=True)


def _upsample_random(rows, minimum, seed, strata, text_cols):
    """minimum - n draws with replacement among rows with some text."""
    outer = _outer(strata)
    ok = _class_rank(rows.where(any_text(text_cols)), strata, F.col("id"), "_rk")
    hist = rows.select(*strata, "n", "n_ok").dropDuplicates(list(strata))
    draws = (hist.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(minimum) - F.col("n"))))
             .withColumn("_rk", draw_index(uniform(seed, "random", *outer, "label", "draw"),
                                           F.col("n_ok"))))
    return draws.join(ok.drop("n", "n_ok"), strata + ["_rk"], "inner")


SHUFFLE_BLOCK = 4


def shuffle_block(d: Column) -> Column:
    """Candidates per class of the first round: 4 per missing row, plus 16."""
    return d * SHUFFLE_BLOCK + 16


def _upsample_shuffle(rows, hist, minimum, seed, strata, text_cols):
    """Each text column drawn independently with replacement from the class;
    candidates j = 1, 2, ... are tried in order and the first minimum - n
    with some text are kept -- the law of the reference's redraw loop
    (R10, J8).  Each round tries as many candidates of every class still
    short as all before, so a class of mostly empty draws needs a logarithmic
    number of rounds; the result does not depend on the block size."""
    outer = _outer(strata)
    id_type = dict(rows.dtypes)["id"]
    ranked = _class_rank(rows, strata, F.col("id"), "_rk")
    texts = {c: ranked.select(*strata, F.col("_rk").alias(f"_i_{c}"), F.col(c)) for c in text_cols}
    need = hist.select(*strata, "n", (F.lit(minimum) - F.col("n")).alias("_d"))
    accepted = None
    todo = need
    tried = 0                 # in blocks of the first round
    while True:
        size, upto = shuffle_block(F.col("_d")), max(1, 2 * tried)
        cand = todo.withColumn("_j", F.explode(F.sequence(F.lit(tried) * size + 1,
                                                          F.lit(upto) * size)))
        tried = upto
        for c in text_cols:
            cand = cand.withColumn(f"_i_{c}", draw_index(
                uniform(seed, f"shuffle:{c}", *outer, "label", "_j"), F.col("n")))
            cand = cand.join(texts[c], strata + [f"_i_{c}"], "inner")
        cand = cand.where(any_text(text_cols)).select(*strata, "_j", *text_cols).checkpoint()
        accepted = cand if accepted is None else accepted.unionByName(cand)
        got = accepted.groupBy(*strata).agg(F.count(F.lit(1)).alias("_g"))
        todo = (need.join(got, strata, "left")
                .where(F.coalesce("_g", F.lit(0)) < F.col("_d")).drop("_g")).cache()
        if todo.isEmpty():
            break
    w = Window.partitionBy(*strata).orderBy("_j")
    out = accepted.withColumn("draw", F.row_number().over(w)).join(
        need.select(*strata, "_d"), strata).where(F.col("draw") <= F.col("_d"))
    return out.withColumn("id", F.lit(None).cast(id_type))
