"""Write PLANS.md: physical-plan summaries of the main operators at a scale
factor (exchanges of the big side, broadcasts, sorts, pair-producing joins)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from bagwise.operators import encode, ensemble, resample  # noqa: E402
from bagwise.plans import catalog as C  # noqa: E402
from bagwise.session import get_session  # noqa: E402


def walk(node, depth=0):
    """(depth, node) over the physical plan via children(): the plans behind
    cached tables (InMemoryTableScan) are not children, they ran once when
    the class-sized tables were built."""
    yield depth, node
    if node.nodeName() == "AdaptiveSparkPlan":
        yield from walk(node.executedPlan(), depth + 1)
        return
    it = node.children().iterator()
    while it.hasNext():
        yield from walk(it.next(), depth + 1)


def summary(name: str, df) -> list[str]:
    nodes = list(walk(df._jdf.queryExecution().executedPlan()))
    names = [n.nodeName() for _, n in nodes]
    hx = sum(1 for _, n in nodes if n.nodeName() in ("Exchange", "ShuffleExchange")
             and "hashpartitioning" in n.simpleString(5))
    out = [f"### {name}", "",
           f"hash exchanges: {hx}, broadcast exchanges: {names.count('BroadcastExchange')}, "
           f"sort-merge joins: {names.count('SortMergeJoin')}, "
           f"nested-loop / cartesian: "
           f"{names.count('BroadcastNestedLoopJoin') + names.count('CartesianProduct')}",
           "", "```"]
    for depth, n in nodes:
        line = re.sub(r"Location: [^,]*, |PartitionFilters: \[\], |\[plan_id=\d+\]", "",
                      n.simpleString(8))
        out.append(("  " * depth + line)[:170])
    out += ["```", ""]
    return out


def main(sf: str = "/root/testdata/sf0.1") -> None:
    spark = get_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    lab, _ = C.labelled(spark, sf)
    train = C.train_rows(spark, sf)
    sc = C.emb_scored(spark, sf)
    docs = C.doc_texts(spark, sf)
    vocab = C._vocab(spark, sf, C.VIEWS[:1])
    items = [
        ("stratified split (first_k: rows meet broadcast count/offset tables)",
         resample.stratified_split(lab, num_test=200, seed=5986)),
        ("bags 'same' (pruned pairs + first_k)",
         resample.bag_same(train, 3, train.count() // 2)),
        ("mean + vote ensemble (one shuffle by document)", ensemble.mean_and_vote(sc)),
        ("vocabulary (map-side counts + partial top-k)",
         encode.vocab(docs, C.VIEWS[:1], 500)),
        ("fixed-length encoding (broadcast vocabulary, no shuffle)",
         encode.encode(docs, vocab, C.VIEWS[0], 16, out="e").select("id", F.col("e.input_ids"))),
    ]
    lines = ["# Physical plans of the main operators", "",
             f"Generated by `tools/plan_report.py` at `{sf}` (local[8], AQE on). "
             "Nodes are walked through children(): the plans behind cached class-sized "
             "tables (InMemoryTableScan) ran once when those tables were built and are "
             "not repeated here; lines are trimmed.", ""]
    for name, df in items:
        lines += summary(name, df)
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main(*sys.argv[1:])
