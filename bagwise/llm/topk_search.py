"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are quantised to integers and held as postings: for every term (a
position) the rows of a block that have a weight there, with the weights.  A
tile of query rows walks its terms one after the other and scatters weight
times weight into a dense array of scores, a row per query and a place per
candidate of the block; every candidate is scored, nothing is skipped.  The
k best of each block are selected by partition, and the blocks' best are
merged by a shuffle on the query.

Candidates and queries are dealt by a hash of a row number into blocks of
bounded size, so copies of one vector, or one vec_id, never meet in one task
because they are alike.  A group of the grouping
on both block numbers has the rows of one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.session import materialize

STEPS = 256
K = 5
#: Rows of a candidate block and of a query block.
CANDIDATES = 8_192
QUERIES = 4_096
#: Query rows that walk their terms together.
TILE = 16
#: A term that more than this share of a block's rows have is held for all of them.
FULL = 0.5

HIT = "query long, query_id long, candidate long, vec_id long, score long"


def quantised(vector: Column, steps: int = STEPS) -> Column:
    """floor(steps * x) of every component, x as double; raises beyond a long."""
    def one(x: Column) -> Column:
        wide = x.cast("double") * F.lit(float(steps))
        return F.when(F.abs(wide) < F.lit(2.0 ** 63), F.floor(wide)).otherwise(
            F.raise_error(F.lit("a vector's component does not fit a long")).cast("long"))
    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Not null, and every component there and finite."""
    def finite(x: Column) -> Column:
        wide = x.cast("double")
        return wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def matrix(values: pa.Array) -> np.ndarray:
    """A list array as rows of equal length; a shorter vector has no weight at
    the places that it lacks."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def postings(block: np.ndarray) -> list[tuple]:
    """(rows, weights) of each term; rows is a slice where most have it."""
    found = []
    for column in block.T:
        rows = np.flatnonzero(column)
        full = len(rows) > FULL * len(column)
        found.append((slice(None), np.ascontiguousarray(column)) if full else (rows, column[rows]))
    return found


def score_type(queries: np.ndarray, block: np.ndarray):
    """The narrowest integers that no partial sum can leave; Python's own
    where 64 bits might not do."""
    def largest(x: np.ndarray) -> int:
        return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = largest(queries) * largest(block) * max(1, min(queries.shape[1], block.shape[1]))
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def accumulate(tile: np.ndarray, terms: list[tuple], rows: int) -> np.ndarray:
    """Scores of a tile of query rows against a block's postings."""
    scores = np.zeros((len(tile), rows), dtype=tile.dtype)
    for weights, (at, held) in zip(tile.T, terms):
        if len(held) and weights.any():
            scores[:, at] += weights[:, None] * held
    return scores


def best(scores: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The places of each row's k highest scores, all places if fewer; of
    equal ones the lowest places."""
    rows, width = scores.shape
    if width <= k:
        yield from (np.arange(width) for _ in range(rows))
        return
    if scores.dtype == object:
        cut = np.sort(scores, axis=1)[:, width - k]
    else:
        cut = np.partition(scores, width - k, axis=1)[:, width - k]
    for row, least in zip(scores, cut):
        above = np.flatnonzero(row > least)
        yield np.concatenate([above, np.flatnonzero(row == least)[:k - len(above)]])


def _searched(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("candidate", pa.int64()),
                        ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        left, right = table.filter(pc.invert(asks)), table.filter(asks)
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # Places in order of vec_id (null last), so that ties fall to the lowest place.
        left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        block, asked = (matrix(t.column("v").combine_chunks()) for t in (left, right))
        kind = score_type(asked, block)
        terms = postings(block.astype(kind))
        asked = asked.astype(kind)
        own, out = left.column("row").to_numpy(), []
        for at in range(0, len(asked), TILE):
            scores = accumulate(asked[at:at + TILE], terms, len(block))
            # One more than k, as the query itself may be among them.
            for i, places in enumerate(best(scores, k + 1)):
                query = right.column("row")[at + i].as_py()
                places = places[own[places] != query]
                order = np.lexsort((places, -scores[i, places]))[:k] if kind != object else sorted(
                    range(len(places)), key=lambda j: (-scores[i, places[j]], places[j]))[:k]
                places = places[np.asarray(order, dtype=np.int64)]
                out.append((at + i, places, scores[i, places]))
        ask = pa.array(np.concatenate([np.full(len(p), i) for i, p, _ in out]), pa.int64())
        found = pa.array(np.concatenate([p for _, p, _ in out]), pa.int64())
        if kind == object:  # raises where a score is no long
            score = pa.array([int(x) for _, _, s in out for x in s], pa.int64())
        else:
            score = pa.array(np.concatenate([s for _, _, s in out]).astype(np.int64))
        return pa.Table.from_arrays([right.column("row").take(ask), right.column("vec_id").take(ask),
                                     left.column("row").take(found), left.column("vec_id").take(found), score],
                                    schema=schema)
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, per_block: int = CANDIDATES,
          per_query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``candidates`` of
    the highest integer inner product with each row of ``queries``, all if
    fewer, ties to the smaller vec_id, a null one last.

    Both have (row, vec_id, v): a unique row number, an id that may repeat or
    be null, and an ARRAY<LONG> without nulls.  A candidate of the query's own
    row number does not count.  Vectors may differ in length; the product is
    taken over the places that both have.  A score beyond a long raises."""
    # Counts, no rows, reach the driver.
    blocks = max(1, -(-candidates.count() // per_block))
    query_blocks = max(1, -(-queries.count() // per_query_block))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = candidates.select("row", "vec_id", "v", F.lit(False).alias("asks"), block(blocks).alias("c")).withColumn(
        "q", every(query_blocks))
    right = queries.select("row", "vec_id", "v", F.lit(True).alias("asks"), block(query_blocks).alias("q")).withColumn(
        "c", every(blocks))
    hits = left.unionByName(right).groupBy("c", "q").applyInArrow(_searched(k), HIT)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "candidate")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = K, every: int = 50, steps: int = STEPS) -> DataFrame:
    """``top_k`` of the rows of (vec_id, embedding) whose vec_id is divisible
    by ``every`` against all rows.

    Vectors that are null or hold a null, NaN or infinite component take no
    part; a vec_id may repeat (each row is a candidate and, if divisible, a
    query of its own) or be null (a candidate only).  An empty vector has the
    score 0 with all.  An empty table gives an empty result; other columns are
    not read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(
        usable(F.col("e")))
    held = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id",
                                   quantised(F.col("e"), steps).alias("v")))
    return top_k(held, held.where(F.col("vec_id") % every == 0), k)
