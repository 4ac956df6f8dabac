"""Every registered query against its DuckDB statement (row count, column
names, rounded values) at sf0.001, plus FIXTURES golden checksums."""

import pytest
from pyspark.sql import functions as F

from bagwise.plans.catalog import REGISTRY
from bagwise.plans.oracle import ORACLE
from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    df = REGISTRY[name](spark, SF)
    plan = plan_of(df)
    assert not any(op in plan for op in FORBIDDEN), f"{name}: pair-producing join in plan"
    ok, msg = compare(spark, name, lambda s, sf: df, ORACLE[name], SF)
    assert ok, msg


def test_every_query_has_oracle_or_reason():
    assert set(ORACLE) <= set(REGISTRY)
    assert set(REGISTRY) - set(ORACLE) == {"train_head", "ml_bag_learners"}


@pytest.mark.parametrize("sf,split,rows,classes,sid,chk", [
    ("0.001", "test", 18, 8, 1800, 60032),
    ("0.001", "train", 180, 65, 17860, 579289),
    ("0.01", "test", 172, 75, 85211, 6176912),
    ("0.01", "train", 812, 148, 402978, 30190755),
])
def test_golden_split(spark, sf, split, rows, classes, sid, chk):
    df = REGISTRY["split_stratified"](spark, f"/root/testdata/sf{sf}")
    r = df.where(F.col("split") == split).agg(
        F.count("*"), F.countDistinct("label"), F.sum("id"),
        F.sum(F.col("id") * F.col("label"))).first()
    assert tuple(r) == (rows, classes, sid, chk)


def test_golden_ensemble(spark):
    df = REGISTRY["test_summary"](spark, "/root/testdata/sf0.01")
    acc = {r.agg_fn: round(r.accuracy * 143) for r in df.collect()}
    assert acc["mean"] == 16 and acc["vote"] == 18


def test_bag_random_rows(spark):
    df = REGISTRY["bag_random"](spark, SF)
    per_bag = dict(df.groupBy("bag_id").count().collect())
    from bagwise.plans import params as P
    from bagwise.plans.catalog import bag_total, train_rows
    want = bag_total(train_rows(spark, SF))
    assert per_bag == {b: want for b in range(P.ESTIMATORS)}
    assert df.groupBy("bag_id", "id").count().where("count > 1").count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "agg_fn" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["test_summary", "centroid_scores", "subset_top_acc",
                                  "class_size_quantiles", "early_stop"])
def test_entry_wrappers_match(spark, name):
    """queries() / oracle_sql() as the driver sees them (rounded doubles)."""
    import __spark_entry__ as e
    ok, msg = compare(spark, name, e.queries()[name], e.oracle_sql()[name], SF)
    assert ok, msg


def test_float_cols_up_to_date(spark):
    from bagwise.plans.float_cols import FLOAT_COLS
    for name in ["test_summary", "epoch_summary", "loss_ice", "subset_metrics", "one_hot"]:
        df = REGISTRY[name](spark, SF)
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        assert FLOAT_COLS.get(name, []) == cols, name
