"""Text encoding (E1-E6): corpus vocabularies, fixed-length ids, views.

A view is (name, kind, n, with_token_types): kind 'word' splits the
lower-cased text on white space; kind 'char' takes every n code-point window
of the lower-cased text.  Ids: 0 pad, 1 unk, 2 cls, 3 sep, then the
vocabulary by (count desc, token)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.operators.strata import checked_broadcast
from bagwise.session import materialize

# Reserved token ids
PAD, UNK, CLS, SEP = 0, 1, 2, 3
N_RESERVED = 4
WS = r"[ \t\n\r]+"
MAX_VOCAB = 1_000_000        # upper bound of the entries that ``vocab`` ranks
BROADCAST_VOCAB = 200_000    # most frequent entries that ``encode`` broadcasts


@dataclass(frozen=True)
class View:
    name: str
    kind: str = "word"         # 'word' | 'char'
    n: int = 3                 # window of a 'char' view
    token_types: bool = True   # False: no token_type_ids (single-segment models without them)


def with_tokens(df: DataFrame, text: str, view: View, out: str,
                limit: int | None = None) -> DataFrame:
    """Add the token array of ``text`` as ``out``; ``limit`` keeps the first
    tokens only (the encoder needs max_len - 2 of them, the vocabulary all).
    Char views take their windows in one pass of a pattern (a substring by
    position rescans the string)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if view.kind == "word":
        # a leading empty part, ``limit`` tokens and the rest, left unsplit
        parts = F.split(low, WS, limit + 2) if limit else F.split(low, WS)
        toks = F.filter(parts, lambda t: F.length(t) > 0)
        return df.withColumn(out, F.slice(toks, 1, limit) if limit else toks)
    if view.kind == "char":
        # '.' in a Java regex matches a whole code point: each match takes one
        # and looks at the window that it starts
        low = F.substring(low, 1, limit + view.n - 1) if limit else low
        return df.withColumn(out, F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{view.n}}}))."), F.lit(1)))
    raise ValueError(f"unknown view kind {view.kind!r}")


SPACE = np.isin(np.arange(256), [9, 10, 13, 32])   # the bytes of WS
BLOCK_BYTES = 4 << 20        # text that a task cuts into tokens at once, or one longer text
HELD_TOKENS = 1_000_000      # different tokens that a task counts before it passes them on
KEY_CHARS = 3                # code points (21 bits each) in one 64-bit key of a window


def text_blocks(texts: pa.Array):
    """``texts`` (null: empty) in runs of about BLOCK_BYTES, each as the bytes
    of its texts and where they start and end in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    cuts = np.flatnonzero(np.diff((at[:-1] - at[0]) // BLOCK_BYTES)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(texts)]):
        yield data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a block of texts in their order, and how many each text has."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = inside[begin]           # a word does not run on into the next text
    first = np.flatnonzero(first)
    sizes = np.add.reduceat(inside.view(np.uint8), first, dtype=np.int64) if len(first) else first
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return words, np.diff(np.searchsorted(first, at))


def _window_keys(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """All ``n`` code-point windows of a block of texts, each as one number per
    KEY_CHARS of its code points."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    count = len(chars) - n + 1
    if count <= 0:
        return [np.zeros(0, np.uint64) for _ in range(0, n, KEY_CHARS)]
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at[1:]]
    whole = np.ones(count, bool)
    over = (ends[:, None] - np.arange(1, n)).ravel()      # windows that run past their text
    whole[over[(over >= 0) & (over < count)]] = False
    keys = []
    for k in range(0, n, KEY_CHARS):
        key = np.zeros(count, np.uint64)
        for i in range(k, min(n, k + KEY_CHARS)):
            key |= chars[i:i + count] << np.uint64(21 * (i - k))
        keys.append(key[whole])
    return keys


def _window_texts(keys: list[np.ndarray], n: int) -> pa.Array:
    """The windows that ``_window_keys`` made numbers of."""
    chars = np.empty((len(keys[0]), n), "<u4")
    for i in range(n):
        chars[:, i] = (keys[i // KEY_CHARS] >> np.uint64(21 * (i % KEY_CHARS))) & np.uint64(0x1FFFFF)
    size = 1 + sum((chars >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int64)
    text = chars.tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(chars), pa.py_buffer(ends), pa.py_buffer(text))


def token_counts(docs: DataFrame, view: View, text: str = "text") -> DataFrame:
    """(token, n): how often a task met a token of ``text``, to be added up by
    token.  A task counts a block of texts at once and passes its counts on
    when they hold more than HELD_TOKENS different tokens, so no row is made
    per token and its memory is bounded.  Tokens as in ``with_tokens``."""
    if view.kind not in ("word", "char"):
        raise ValueError(f"unknown view kind {view.kind!r}")
    width = -(-view.n // KEY_CHARS) if view.kind == "char" else 1
    names = [f"k{i}" for i in range(width)]

    def added(tables):
        sums = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns({"n_sum": "n"}).select([*names, "n"])

    def out(t):
        if view.kind == "word":
            tokens = t["k0"].combine_chunks()
        else:
            tokens = _window_texts([t[k].to_numpy() for k in names], view.n)
        rows = pa.table({"token": tokens.cast(pa.string()), "n": t["n"]})
        return rows.combine_chunks().to_batches(max_chunksize=100_000)

    def count(batches):
        waiting, size = [], 0
        for batch in batches:
            for data, at in text_blocks(batch.column(0)):
                keys = [split_words(data, at)[0]] if view.kind == "word" else _window_keys(data, at, view.n)
                if width == 1:
                    found = pc.value_counts(pa.array(keys[0]) if view.kind == "char" else keys[0])
                    found = pa.table({"k0": found.field("values"), "n": found.field("counts")})
                else:
                    found = added([pa.table([*map(pa.array, keys), np.ones(len(keys[0]), np.int64)],
                                            names=[*names, "n"])])
                waiting.append(found)
                size += found.num_rows
                if size > HELD_TOKENS:
                    waiting = [added(waiting)]
                    size = waiting[0].num_rows
                    if size > HELD_TOKENS // 2:
                        yield from out(waiting[0])
                        waiting, size = [], 0
        if waiting:
            yield from out(added(waiting))

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(low.alias("text")).mapInArrow(count, "token string, n long")


def vocab(docs: DataFrame, views: Sequence[View], size: int, text: str = "text",
          counters: int | None = None) -> DataFrame:
    """(view, token, n, token_id) with the top-``size`` tokens of each view
    over the whole texts (E1).  Counts are added up in the tasks
    (``token_counts``), then by token;
    the top-k per view is Spark's partial take-ordered, never one task over
    all distinct tokens.  With ``counters``, only tokens that can be among the
    top are shuffled and counted (``frequent_tokens``); the result is equal."""
    if size > MAX_VOCAB:
        raise ValueError(f"vocabulary size above {MAX_VOCAB}")
    out = None
    for v in views:
        tokens = token_counts(docs, v, text)
        if counters:
            counts = frequent_tokens(tokens, size, counters)
        else:
            counts = tokens.groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
        top = top.select(F.lit(v.name).alias("view"), "token", "n")
        out = top if out is None else out.unionByName(top)
    from pyspark.sql import Window
    w = Window.partitionBy("view").orderBy(F.desc("n"), F.asc("token"))   # <= size rows per view
    return out.withColumn("token_id", (F.row_number().over(w) - 1 + N_RESERVED).cast("int"))


MORE_COUNTERS = 4            # times as many counters if the bound proves too little


def token_summaries(tokens: DataFrame, counters: int) -> DataFrame:
    """(token, n) of at most ``counters`` frequent tokens per task, of rows
    (token) or, met n times, (token, n); and one row (null, e) per task: a token occurs there at most e times more often
    than its row says, or at most e times if it has none.  Summaries merge by
    adding up (n by token, e over all).

    A task adds up token counts; when they outgrow twice the counters, the
    count of the largest one that has no counter left is taken off all, and
    what falls to 0 is let go."""
    def summarise(batches):
        held, taken = pa.table({"token": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        waiting, size = [held], 0

        def fold():
            nonlocal held, taken, waiting, size
            held = pa.concat_tables(waiting).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
            if held.num_rows > counters:
                n = held["n"].to_numpy()
                over = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                taken += over
                held = held.set_column(1, "n", pc.subtract(held["n"], over)).filter(pa.array(n > over))
            waiting, size = [held], 0

        for batch in batches:
            waiting.append(pa.table({"token": batch.column(0), "n": batch.column(1)}))
            size += batch.num_rows
            if size > 2 * counters:
                fold()
        fold()
        yield from held.to_batches()
        yield pa.record_batch({"token": pa.array([None], pa.string()), "n": pa.array([taken], pa.int64())})

    return _numbered(tokens).mapInArrow(summarise, "token string, n long")


def _numbered(tokens: DataFrame) -> DataFrame:
    """(token, n) of rows (token), each met once, or (token, n)."""
    return tokens.select("token", F.col("n") if "n" in tokens.columns else F.lit(1).cast("long").alias("n"))


def frequent_tokens(tokens: DataFrame, size: int, counters: int) -> DataFrame:
    """(token, n) with exact counts of some tokens, the ``size`` most frequent
    ones among them, all ties of the last one included.

    Let e be what all tasks took off together and t the size-th largest
    summed-up count.  At least ``size`` tokens occur t times or more, and a
    token without a counter occurs at most e times, so e < t proves that the
    tokens whose count is t - e or more hold the result; these are counted in
    a second pass.  Without that proof the first pass is repeated with
    MORE_COUNTERS times the counters, in the end one for every token, when
    nothing is taken off and the sums are the counts."""
    while True:
        found = materialize(token_summaries(tokens, counters))
        merged = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
        taken = found.where("token IS NULL").agg(F.sum("n")).first()[0] or 0
        if not taken:
            return merged
        last = (merged.select("n").orderBy(F.desc("n")).limit(size)
                .agg(F.min("n").alias("t"), F.count(F.lit(1)).alias("c")).first())
        if last["c"] == size and taken < last["t"]:
            able = merged.where(F.col("n") >= last["t"] - taken).select("token")
            return (_numbered(tokens).join(checked_broadcast(able), "token", "left_semi")
                    .groupBy("token").agg(F.sum("n").alias("n")))
        counters *= MORE_COUNTERS


def _lookup_udf(table: tuple[pa.Array, pa.Array]):
    bc = None

    def build(spark):
        nonlocal bc
        bc = spark.sparkContext.broadcast(table)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lookup(toks: pa.Array) -> pa.Array:
        # one lookup over the tokens of the whole batch
        tokens, ids = bc.value
        flat = toks.flatten()
        found = pc.fill_null(ids.take(pc.index_in(flat, value_set=tokens.cast(flat.type))), UNK)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(toks).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)
    return build, lookup


def _look_up_rest(d: DataFrame, rest: DataFrame) -> DataFrame:
    """Fill in the ids of tokens that are still unknown in ``_ids`` by a join
    with ``rest`` (token, token_id), partitioned by token.  A document's
    found positions, less than its length, come back as one map."""
    d = materialize(d.withColumn("_row", F.monotonically_increasing_id()))   # written, so the numbers stay
    each = d.select("_row", F.posexplode(F.arrays_zip("_tok", "_ids")).alias("pos", "_t"))
    found = (each.where(F.col("_t._ids") == UNK).select("_row", "pos", F.col("_t._tok").alias("token"))
             .join(rest, "token").groupBy("_row")
             .agg(F.map_from_entries(F.collect_list(F.struct("pos", "token_id"))).alias("_found")))
    ids = F.transform("_ids", lambda x, i: F.coalesce(F.try_element_at("_found", i), x))
    return d.join(found, "_row", "left").withColumn("_ids", ids).drop("_row", "_found")


def encode(docs: DataFrame, vocab_df: DataFrame, view: View, max_len: int, text: str = "text",
           out: str | None = None, broadcast_vocab: int = BROADCAST_VOCAB) -> DataFrame:
    """Struct (input_ids, attention_mask, token_type_ids) of exactly
    ``max_len`` entries: [CLS] first max_len-2 tokens [SEP], padded with 0;
    mask 1 on real positions; token types all 0, or null for views without
    them (E2-E4).

    The ``broadcast_vocab`` most frequent entries (ids run by frequency) are
    looked up in a broadcast table, so no frequent token is a join key; the
    entries of a larger vocabulary, however many, by a join on the token."""
    mine = vocab_df.where(F.col("view") == view.name).select("token", "token_id")
    beyond = N_RESERVED + broadcast_vocab
    rows = mine.where(F.col("token_id") <= beyond).collect()     # one more than is broadcast
    larger = len(rows) > broadcast_vocab
    rows = [r for r in rows if r[1] < beyond]
    build, lookup = _lookup_udf((pa.array([r[0] for r in rows], pa.string()),
                                 pa.array([r[1] for r in rows], pa.int32())))
    build(docs.sparkSession)
    out = out or view.name
    d = with_tokens(docs, text, view, "_tok", max_len - 2)
    d = d.withColumn("_ids", lookup(F.col("_tok")))
    if larger:
        d = _look_up_rest(d, mine.where(F.col("token_id") >= beyond))
    seq = F.concat(F.array(F.lit(CLS)), F.col("_ids"), F.array(F.lit(SEP)))
    n = F.size(F.col("_ids")) + 2      # cheap inside the mask lambda
    input_ids = F.concat(seq, F.array_repeat(F.lit(PAD), F.lit(max_len) - n))
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)),
                       lambda i: F.when(i <= n, 1).otherwise(0))
    ttype = F.array_repeat(F.lit(0), max_len) if view.token_types else \
        F.lit(None).cast("array<int>")
    return d.withColumn(out, F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"),
                                      ttype.alias("token_type_ids"))).drop("_tok", "_ids")


def encode_views(docs: DataFrame, vocab_df: DataFrame, views: Sequence[View], max_len: int,
                 keep: Sequence[str] = ("id",), text: str = "text") -> DataFrame:
    """One row per document with one struct column per view (E5)."""
    d = docs
    for v in views:
        d = encode(d, vocab_df, v, max_len, text)
    return d.select(*keep, *[v.name for v in views])


def route_views(rows: DataFrame, encoded: DataFrame, assignment: DataFrame,
                view_of_type: dict[str, str], views: Sequence[View]) -> DataFrame:
    """(bag_id, id, view, input_ids, attention_mask, token_type_ids): each
    bag's rows get the encoding of its learner type's view (E6)."""
    spark = rows.sparkSession
    vt = spark.createDataFrame(list(view_of_type.items()), "type string, view string")
    route = F.broadcast(assignment.select("bag_id", "type").join(vt, "type"))
    r = rows.select("bag_id", "id").join(route, "bag_id")
    names = [v.name for v in views]
    pick = F.col(names[0])
    for nm in names[1:]:
        pick = F.when(F.col("view") == nm, F.col(nm)).otherwise(pick)
    j = r.join(encoded, "id")
    return j.select("bag_id", "id", "view", pick.alias("_e")).select(
        "bag_id", "id", "view", "_e.input_ids", "_e.attention_mask", "_e.token_type_ids")
