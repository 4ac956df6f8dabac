"""Finding pattern matches with their places, by DataFrame functions only.

A text split by a pattern gives what lies between its matches, and extracting
the pattern gives the matches; the running lengths of both are the places.
Lengths and places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.common import text_or_empty
from bagwise.session import materialize

#: Characters kept from before a match, for rules about its context.
CONTEXT = 48

FOUND = "array<struct<kind:string,k:int,before:int,len:int,token:string,part:string,context:string>>"


def matches(text: Column, kind: str, pattern: str, part: int = 0, context: bool = False,
            maybe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches
    nothing: kind, number k, length of the text between it and the match
    before, own length, the match, group ``part`` and, if asked for, the end
    of the text before it.  ``maybe``: a cheap condition without which there
    is no match."""
    def group(n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(group(0))), group(0),
                       lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    parts = group(part) if part else F.transform(group(0), lambda m: F.lit(None).cast("string"))
    both = F.zip_with(pairs, parts, lambda x, p: F.struct(x["b"].alias("b"), x["m"].alias("m"), p.alias("p")))
    each = F.transform(both, lambda x, k: F.struct(
        F.lit(kind).alias("kind"), k.alias("k"), F.length(x["b"]).alias("before"), F.length(x["m"]).alias("len"),
        x["m"].alias("token"), x["p"].alias("part"),
        (F.substring(x["b"], -CONTEXT, CONTEXT) if context else F.lit(None).cast("string")).alias("context")))
    found = text.rlike(pattern)
    return F.when(found if maybe is None else maybe & found, each).otherwise(F.array()).cast(FOUND)


def scan(docs: DataFrame, find) -> DataFrame:
    """row (a number of the row's own), doc_id, found: the matches of all
    kinds.  Kept in the checkpoint folder, so each text is read once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.concat(*find(text_or_empty(F.col("text")))).alias("found"))
    return materialize(rows)


def place(scanned: DataFrame) -> DataFrame:
    """One row per match, with start and end (exclusive) in its text."""
    each = scanned.select("row", F.explode("found").alias("m")).select("row", "m.*")
    upto = (Window.partitionBy("row", "kind").orderBy("k")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("before") + F.col("len")).over(upto)
    return each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("len"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of span structs."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, spans: DataFrame, base: list[str]) -> DataFrame:
    """One row per document: doc_id, n_<kind> for the base kinds,
    base_sha256 and spans.  ``spans``: row, kind, start, end; ordered by
    start, then base kinds as listed, then the others by name."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(base)], F.lit(len(base)))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", rank.alias("rank"), "kind", "end"))).alias("all"))
    out = scanned.select(F.col("row").alias("own"), "doc_id").join(listed, F.col("own") == F.col("row"), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    out = out.withColumn("all", F.coalesce(F.col("all"), none))
    out = out.withColumn("base", F.filter("all", lambda s: s["rank"] < len(base)))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(base)]
    digest = F.sha2(written(F.col("base")).cast("binary"), 256)
    return out.select("doc_id", *counts, digest.alias("base_sha256"), written(F.col("all")).alias("spans"))


def apart(spans: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of ``spans`` that overlap no row of ``base`` of the same text.
    Both are ordered by place within a text; the furthest end before a span
    and the next start after it decide, so no pairs are formed."""
    marked = base.select("row", "start", "end", F.lit(0).alias("added")).unionByName(
        spans.select("row", "start", "end", F.lit(1).alias("added")))
    order = Window.partitionBy("row").orderBy("start", "added", "end")
    ahead = F.max(F.when(F.col("added") == 0, F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("added") == 0, F.col("start"))).over(
        order.rowsBetween(1, Window.unboundedFollowing))
    marked = marked.withColumn("ahead", ahead).withColumn("after", after)
    free = marked.where((F.col("added") == 1) & (F.coalesce(F.col("ahead"), F.lit(0)) <= F.col("start"))
                        & (F.col("after").isNull() | (F.col("after") >= F.col("end"))))
    return spans.join(free.select("row", "start", "end").distinct(), ["row", "start", "end"], "left_semi")
