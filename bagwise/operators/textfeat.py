"""Text features of the base learners (M2): hashed term shares.

A text becomes a vector of fixed length: every token (lower-cased, split at
white space) counts in the position given by its hash, and counts are divided
by the number of tokens.  The hash is md5, so any engine gives the same
vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.operators.encode import split_words, text_blocks
from bagwise.session import materialize


def _spots(tokens: pa.Array, dims: int) -> np.ndarray:
    """The first 32 bits of each token's md5, modulo ``dims``."""
    _, at, data = tokens.buffers()
    data = data.to_pybytes() if data else b""
    at = np.frombuffer(at, np.int64)[tokens.offset:tokens.offset + len(tokens) + 1].tolist()
    start = hashlib.md5()                  # copied, which is cheaper than a new one each

    def digest(lo: int, hi: int) -> bytes:
        h = start.copy()
        h.update(data[lo:hi])
        return h.digest()

    return np.frombuffer(b"".join(map(digest, at, at[1:])), ">u4")[::4].astype(np.int64) % dims


def term_counts(docs: DataFrame, dims: int, text: str = "text") -> DataFrame:
    """(id, _n ARRAY<LONG> of ``dims``): tokens of each row by position,
    counted where the row lies; each different token of a block is hashed once."""
    kind = docs.schema["id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            done = 0
            for data, at in text_blocks(batch.column(1)):
                words, per_text = split_words(data, at)
                found = words.dictionary_encode()
                at = _spots(found.dictionary, dims)
                row = np.repeat(np.arange(len(per_text)), per_text)
                n = np.bincount(row * dims + at[found.indices.to_numpy()], minlength=len(per_text) * dims)
                ends = np.arange(len(per_text) + 1, dtype=np.int32) * dims
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(per_text)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n, pa.int64()))], names=["id", "_n"])
                done += len(per_text)

    # a row without an id has no tokens of its own
    low = F.when(F.col("id").isNotNull(), F.lower(F.col(text)))
    return docs.select("id", low.alias("text")).mapInArrow(count, f"id {kind}, _n array<bigint>")


def _shares(n: Column) -> Column:
    """Counts divided by their sum; zeros if there are none."""
    n_all = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    return F.transform(F.arrays_zip(n.alias("n"), F.array_repeat(n_all, F.size(n)).alias("all")),
                       lambda x: F.when(x["all"] > 0, x["n"].cast("double") / x["all"]).otherwise(F.lit(0.0)))


def hashed_terms(docs: DataFrame, dims: int, text: str = "text", out: str = "vec") -> DataFrame:
    """(id, ``out`` ARRAY<DOUBLE> of ``dims``); a text without tokens gives
    zeros, rows of the same id share the tokens of all of them.  Nothing is
    shuffled but the ids, to find those that repeat; only the counts of rows
    with such an id are added up, per (id, position)."""
    rows = term_counts(docs, dims, text)
    repeated = (docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_rows"))
                .where(F.col("_rows") > 1).select("id"))
    if repeated.isEmpty():
        return rows.select("id", _shares(F.col("_n")).alias(out))
    rows = materialize(rows)
    each = rows.join(repeated, "id", "left_semi").select("id", F.posexplode("_n").alias("pos", "n"))
    sums = each.where(F.col("n") > 0).groupBy("id", "pos").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("_sums"))
    n = F.transform(F.col("_n"), lambda x, p: F.coalesce(F.try_element_at("_sums", p), x))
    return rows.join(sums, "id", "left").select("id", n.alias("_n")).select("id", _shares(F.col("_n")).alias(out))
