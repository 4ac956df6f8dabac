"""Mixing sources to target weights by hash-random order and prefix sums.

Each document gets a hash-random key.  Within a source the keys are cut into
equal ranges (buckets), range-sorted and summed in two levels, so that every
document knows how many words stand before it in its source's random order.
The source's budget is then cut exactly: whole epochs first, then the words
from the front of the order, the last document in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.common import repeat_rows, text_or_empty, unit, word_count, words_of
from bagwise.session import materialize

SALT = 60_061
#: Fixed by the job: weights by source in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: A bucket's rows: a task's share of the table, but within these.
BUCKET_ROWS = (1_000, 200_000)


def source_targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS,
                   share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size) -> plus weight and target.

    ``share`` of all words is dealt by weight; a source stops at
    ``max_epochs`` times its size and the excess is dealt again by weight.
    The fixed point is found in one pass: with the sources sorted by cap per
    weight, those whose cap is below the level of the rest are capped.  The
    table has one row per source, so its windows run over the sources only."""
    if share > max_epochs:
        raise ValueError("share must not exceed max_epochs")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    which = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (which + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_weight)
    t = t.withColumn("capped", F.col("level") >= F.col("cap") / F.col("weight"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    t = t.withColumn("final", final.over(whole)["level"])
    return t.select("source", "n", "source_size", "weight",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mix(rows: DataFrame, per_bucket: int | None = None) -> DataFrame:
    """(doc_id, source, size, key) -> doc_id, source, size, key, source_size,
    target, taken: the words that the mix takes of the row, repeats counted.

    ``key`` is a long hash; equal keys are ordered by doc_id and size, rows
    alike in all of these share their words in any order.  Such rows are
    counted before the shuffle and placed as one.  A row of size 0 takes
    nothing.  Each source takes floor(target) words exactly, whatever the
    number of buckets."""
    if per_bucket is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        per_bucket = min(max(rows.count() // (4 * tasks), BUCKET_ROWS[0]), BUCKET_ROWS[1])
    per_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = source_targets(per_source).withColumn("buckets", F.ceil(F.col("n") / F.lit(per_bucket)))
    alike = rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    same = alike["source"].eqNullSafe(targets["source"])
    dealt = alike.join(targets, same).drop(targets["source"]).withColumn(
        "bucket", F.least(F.floor(unit(F.col("key")) * F.col("buckets")), F.col("buckets") - 1))
    sums = dealt.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                         F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    placed = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = (Window.partitionBy("source", "bucket").orderBy(unit(F.col("key")), "key", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    placed = repeat_rows(placed.withColumn("ahead", ahead), "rows", "nth")
    ahead = F.col("ahead") + F.col("nth") * F.col("size")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead))
    return placed.select("doc_id", "source", "size", "key", "source_size", "target",
                         (epochs * F.col("size") + part).cast("long").alias("taken"))


def sizes(docs: DataFrame) -> DataFrame:
    """Narrow rows for :func:`mix`; a null text has size 0, a null source is
    a source of its own (last by name)."""
    return docs.select("doc_id", "source", word_count(text_or_empty(F.col("text"))).alias("size"),
                       F.xxhash64("doc_id", "text", F.lit(SALT)).alias("key"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of a documents table: doc_id, size, source_size, target, taken.

    Texts are read once; the narrow rows are kept in the checkpoint folder
    for the three passes.  An empty table gives an empty result."""
    return mix(materialize(sizes(docs))).select("doc_id", "size", "source_size", "target", "taken")


def emit(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: each document
    once per whole time it is taken; the document at a source's cut also with
    its first words, joined by single spaces (n_chars follows, if present).
    Documents without words are not part of a mix by words and go."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    # The key also covers the text, so that rows under one doc_id are told apart.
    packed = packed.select(
        "doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"),
        word_count(text_or_empty(F.col("doc.text"))).alias("size"),
        F.xxhash64("doc.doc_id", "doc.text", F.lit(SALT)).alias("key"))
    takes = mix(materialize(packed.select("doc_id", "source", "size", "key")))
    # Rows alike in all four columns are interchangeable; rank them on both sides.
    alike = ["doc_id", "source", "size", "key"]
    nth = Window.partitionBy(*alike)
    left = packed.withColumn("nth", F.row_number().over(nth.orderBy(F.xxhash64("doc"))))
    right = takes.withColumn("nth", F.row_number().over(nth.orderBy(F.col("taken").desc())))
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in [*alike, "nth"]], "taken")
    on = F.lit(True)
    for c in [*alike, "nth"]:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    taken = left.join(right, on).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") - copies * F.col("size")
    whole = F.when(copies > 0, F.array_repeat(F.lit(0).cast("long"), copies)).otherwise(F.array().cast("array<long>"))
    wanted = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = taken.select("doc", F.explode(wanted).alias("first"))
    front = F.array_join(F.slice(words_of(text_or_empty(F.col("doc.text"))), 1, F.col("first").cast("int")), " ")

    def column(name: str, kind: str) -> Column:
        own = F.col("doc").getField(name)
        if name == "text":
            own = F.when(F.col("first") > 0, front).otherwise(own)
        elif name == "n_chars":
            own = F.when(F.col("first") > 0, F.length(front).cast(kind)).otherwise(own)
        return own.alias(name)

    return out.select(*[column(n, k) for n, k in docs.dtypes])
