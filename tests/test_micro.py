"""Hand-made micro tables (FIXTURES.md section 5) and invariants."""

import pytest
from pyspark.sql import functions as F

from bagwise.functions.arrays import argmax, softmax
from bagwise.functions.codes import any_text, concat_text, fill_text, make_code, num2code
from bagwise.operators import audit, ensemble, history, metrics, normalise, resample
from bagwise.operators.strata import md5_bucket, stratified_rank
from bagwise.functions.hashing import order_key, uniform


def test_codes(spark):
    df = spark.createDataFrame([("S", 95, 952), ("G", 7, 47), ("A", 123, 1234)],
                               "digit_1 string, digit_2 int, digit_3 int")
    got = [r[0] for r in df.select(make_code()).collect()]
    assert got == ["S95952", "G07047", "A1231234"]
    assert spark.range(1).select(num2code(F.lit("1234"), 3)).first()[0] == "1234"


def test_split_sizes(spark):
    sizes = [1, 2, 3, 5, 6, 10, 11, 55, 99, 100, 250]
    rows, i = [], 0
    for lab, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, lab))
            i += 1
    df = spark.createDataFrame(rows, "id long, label int")
    sp = resample.stratified_split(df, test_ratio=0.1, seed=1)
    got = dict(sp.where("split = 'test'").groupBy("label").count().collect())
    want = [0, 0, 1, 1, 2, 2, 2, 6, 9, 10, 25]
    assert [got.get(l, 0) for l in range(len(sizes))] == want
    # a partition of the input
    assert sp.count() == len(rows) and sp.select("id").distinct().count() == len(rows)


def test_rank_equals_window(spark):
    from pyspark.sql import Window
    rows = [(i, 0 if i % 3 else i % 7) for i in range(3000)]   # label 0 is hot
    df = spark.createDataFrame(rows, "id long, label int").withColumn(
        "k", order_key(7, "t", "id"))
    ours = stratified_rank(df, ["label"], [F.col("k"), F.col("id")], md5_bucket("k", 2), "r")
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("label").orderBy("k", "id")))
    j = ours.join(ref, ["id"]).where(F.col("r") != F.col("r2"))
    assert j.count() == 0


def test_uniform_monotone(spark):
    df = spark.range(500).select(order_key(3, "x", "id").alias("k"),
                                 uniform(3, "x", "id").alias("u"))
    rows = sorted(df.collect(), key=lambda r: r.k)
    us = [r.u for r in rows]
    assert us == sorted(us) and 0 <= us[0] and us[-1] < 1


def test_nulls_fill_and_join(spark):
    pats = []
    for i in range(8):
        pats.append((i, *[None if (i >> b) & 1 else f"t{b}" for b in range(3)]))
    pats.append((8, "", "a", ""))
    df = spark.createDataFrame(pats, "id long, text_obj string, text_mthd string, text_deal string")
    np = audit.null_patterns(df)
    assert np.count() == 8 and np.agg(F.sum("n")).first()[0] == 9
    txt = dict(fill_text(df).select("id", concat_text().alias("t")).collect())
    assert txt[8] == " a " and txt[7] == "  "


def test_dups_first_wins_and_order(spark):
    rows = [(5, "A", 1, 1, "x", None, "z"), (3, "A", 1, 1, "x", "", "z"),
            (9, "A", 1, 1, "x", None, "z")]
    df = spark.createDataFrame(rows, "id long, digit_1 string, digit_2 int, digit_3 int, "
                                     "text_obj string, text_mthd string, text_deal string")
    d2 = normalise.dedup_first6(fill_text(df))               # fill first: all equal
    assert [r.id for r in d2.collect()] == [3]
    d3 = normalise.dedup_code4(normalise.add_code(df))       # null vs '' differ
    assert sorted(r.id for r in d3.collect()) == [3, 5]


def test_once_vs_anti(spark):
    data = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "id long, t string")
    bags = spark.createDataFrame([(0, 2, "b")], "bag_id int, id long, t string")
    once = sorted(r.id for r in resample.oob_by_rows(data, bags).collect())
    anti = sorted(r.id for r in resample.oob_by_id(data, bags).collect())
    assert once == [3] and anti == [1, 1, 3]


def test_ties_lowest_class(spark):
    p = spark.createDataFrame([(0, 0, [0.4, 0.4, 0.2]), (1, 0, [0.1, 0.5, 0.4]),
                               (0, 1, [0.3, 0.3, 0.4]), (1, 1, [0.1, 0.1, 0.8]),
                               (0, 2, [0.5, 0.5, 0.0]), (1, 2, [0.5, 0.5, 0.0])],
                              "model int, id long, prob array<double>").withColumn("label", F.lit(0))
    assert spark.range(1).select(argmax(F.array(F.lit(0.5), F.lit(0.5)))).first()[0] == 0
    v = {r.id: r.pred for r in ensemble.vote_ensemble(p).collect()}
    assert v == {0: 0, 1: 2, 2: 0}     # id 0: 1:1 votes -> lowest class
    m = {r.id: r.pred for r in ensemble.mean_ensemble(p).collect()}
    assert m == {0: 1, 1: 2, 2: 0}     # id 2: equal means -> lowest class


def test_absent_classes(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    m = metrics.macro(pred, classes).first()
    # class 0: p=1 r=.5 f=2/3; class 1: p=.5 r=1 f=2/3; class 2 absent: 0
    assert m.accuracy == pytest.approx(2 / 3)
    assert m.f1score == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert m.precision == pytest.approx(0.5)


def test_history_patience(spark):
    losses = [1.0, 0.8, 0.8, 0.9, 0.95, 0.7]
    h = spark.createDataFrame([(1, e, l) for e, l in enumerate(losses)],
                              "run int, epoch int, loss double")
    imp = sorted(r.epoch for r in history.improvement(h, "<=")
                 .where("improved and epoch <= 4").collect())
    assert imp == [0, 1, 2]
    assert history.early_stop(h, 2, "<=").first().stop_epoch == 4
    imp2 = sorted(r.epoch for r in history.improvement(h, "<")
                  .where("improved and epoch <= 3").collect())
    assert imp2 == [0, 1]
    assert history.early_stop(h, 2, "<").first().stop_epoch == 3


def test_all_empty_raises(spark):
    df = spark.createDataFrame([(1, 0, "", "", ""), (2, 0, "", "", ""), (3, 1, "a", "", "")],
                               "id long, label int, text_obj string, text_mthd string, "
                               "text_deal string")
    for m in ("random", "shuffle"):
        with pytest.raises(ValueError):
            resample.upsample(df, m, minimum=5).count()
    with pytest.raises(ValueError):
        resample.upsample(df, "reproduce", minimum=5)


def test_upsample_invariants(spark):
    rows = [(i, i % 4, f"a{i}" if i % 3 else "", "", f"d{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, text_obj string, text_mthd string, "
                                     "text_deal string").where("label != 3 or id < 8")
    for m in ("uniform", "random", "shuffle"):
        out = resample.upsample(df, m, minimum=12, seed=5)
        sizes = dict(out.groupBy("label").count().collect())
        assert sizes == {0: 12, 1: 12, 2: 12, 3: 12}, m
        gen = out.where("draw > 0")
        assert gen.where(~any_text()).count() == 0


def test_bag_properties(spark):
    rows = [(i, i % 7 if i % 5 else 0) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, label int").withColumn("text_obj", F.lit("x")) \
        .withColumn("text_mthd", F.lit("")).withColumn("text_deal", F.lit(""))
    bags = resample.bag_same(df, 4, 300, seed=3).cache()
    assert bags.groupBy("bag_id", "id").count().where("count > 1").count() == 0
    assert bags.groupBy("bag_id").agg(F.countDistinct("label").alias("c")) \
        .where("c < 7").count() == 0
    assert bags.join(df, "id", "left_anti").count() == 0
    oob = resample.oob_by_id(df, bags)
    assert oob.join(bags, "id").count() == 0
    unpruned = resample.bag_same(df, 4, 300, seed=3, prune=False)
    assert bags.select("bag_id", "id").subtract(unpruned.select("bag_id", "id")).count() == 0
    assert bags.count() == unpruned.count()


def test_random_bag_sizes_reach_total(spark):
    rows = [(i, i % 9) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, label int")
    sizes = resample.random_bag_sizes(df, 3, 250, seed=2, cut_std=60)
    tot = dict(sizes.groupBy("bag_id").agg(F.sum("_k")).collect())
    assert tot == {0: 250, 1: 250, 2: 250}
    with pytest.raises(ValueError):
        resample.random_bag_sizes(df, 1, 5000)


def test_softmax_sums_to_one(spark):
    v = spark.range(1).select(softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p")) \
        .first().p
    assert sum(v) == pytest.approx(1.0) and v[2] > v[1] > v[0]


def test_charset_detection(spark, tmp_path):
    from bagwise.sources.delimited import detect_charset, read_delimited
    head = "id|digit_1|digit_2|digit_3|text_obj|text_mthd|text_deal\n"
    body = "1|S|95|952|가나다|라마|바사\n2|G|7|47|아자|차카|타파\n3|A|1|1|하|가|나\n"
    p1, p2 = tmp_path / "cp949.txt", tmp_path / "utf8sig.txt"
    p1.write_bytes((head + body).encode("cp949"))
    p2.write_bytes((head + body).encode("utf-8-sig"))
    assert detect_charset(spark, str(p1)) == "cp949"
    assert detect_charset(spark, str(p2)) == "UTF-8"
    a = read_delimited(spark, str(p1)).orderBy("id").collect()
    b = read_delimited(spark, str(p2)).orderBy("id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert a[0].text_obj == "가나다" and a[1].digit_2 == 7


def test_first_k_equals_window(spark):
    from pyspark.sql import Window
    from bagwise.operators.strata import first_k
    rows = [(i, 0 if i % 3 else i % 7) for i in range(3000)]   # label 0 is hot
    df = spark.createDataFrame(rows, "id long, label int").withColumn(
        "key", order_key(11, "t", "id"))
    hist = df.groupBy("label").agg(F.count("*").alias("n")) \
        .withColumn("_k", (F.col("n") * 0.37).cast("long"))
    got = first_k(df, hist, ["label"], "key", "id", "_in", target=5)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("key", "id"))) \
        .join(hist, "label").withColumn("_ref", F.col("r") <= F.col("_k"))
    bad = got.join(ref.select("id", "_ref"), "id").where(F.col("_in") != F.col("_ref"))
    assert got.count() == 3000 and bad.count() == 0


def test_registries_raise_and_names(spark):
    from bagwise.operators import assignment, learners, losses
    with pytest.raises(ValueError):
        losses.loss_column("XYZ")
    with pytest.raises(ValueError):
        learners.make_learner("transformer", 4, 2)
    df = spark.createDataFrame([("runs/exp3/bert_FCE_same",)], "path string")
    assert df.select(assignment.model_name_from_path("path")).first()[0] == "bert_FCE_same"
    r = assignment.learner_ranges(spark, [("bert", 2), ("gpt", 0), ("albert", 3)])
    a = assignment.assign_learners(spark.range(5).selectExpr("cast(id as int) as bag_id"), r,
                                   loss="mix", dist="same")
    got = {x.bag_id: (x.type, x.ith, x.name) for x in a.collect()}
    assert got == {0: ("bert", 0, "bert_ICE_same"), 1: ("bert", 1, "bert_FCE_same"),
                   2: ("albert", 0, "albert_ICE_same"), 3: ("albert", 1, "albert_FCE_same"),
                   4: ("albert", 2, "albert_ICE_same")}
    with pytest.raises(ValueError):
        assignment.learner_ranges(spark, [("bert", 0)])


def test_hot_class_is_spread(spark):
    """A class with a third of the rows is split into many small buckets:
    the largest bucket (what one window task sorts) stays near the target."""
    from bagwise.operators.strata import prefix_len_col
    n_rows, target = 9000, 100
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 50) for i in range(n_rows)]
    df = spark.createDataFrame(rows, "id long, label int").withColumn(
        "key", order_key(5, "t", "id"))
    hist = df.groupBy("label").agg(F.count("*").alias("n"))
    b = df.join(hist.select("label", prefix_len_col(F.col("n"), target).alias("p")), "label") \
        .withColumn("bkt", F.col("key").substr(F.lit(1), F.col("p")))
    sizes = b.groupBy("label", "bkt").count()
    hot = sizes.where("label = 0")
    assert hot.count() > 100                       # 3000 rows over > 100 buckets
    assert hot.agg(F.max("count")).first()[0] <= 4 * target // 3
