"""Alignment of two tokenizers by an associative fragment monoid.

Both tokenizers cut the same bytes, a space and the text, into tokens.  Byte
offsets at which a token of each ends cut the tokens into groups, and an A and
a B token of one group are linked.

Texts are cut into byte-range chunks at places where both tokenizers surely
start a token.  A chunk yields a Fragment: the tokens up to its first common
end (an open prefix, whose group may have begun before), the groups between
common ends (closed), and the tokens after the last one (an open suffix).
Fragments compose associatively: the suffix of the left and the prefix of the
right become one closed group.  So a document is the ordered product of its
chunks, taken for the usual document in the row at hand, and for very long ones by a
tree of Spark groupings, FAN_IN chunks of a document at a time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import small_batches, text_or_empty
from bagwise.session import materialize

#: Code points of a text that one task encodes and cuts at a time; a chunk ends at the next
#: place where a letter, a space and a letter follow each other.
CHUNK = 1 << 16
#: Fragments of one document that one task composes.
FAN_IN = 16
#: The most frequent pairs, whose counts are joined by broadcast (24 bytes each); the others are rare.
FREQUENT = 100_000

GAP = re.compile("[A-Za-z] (?=[A-Za-z])")
#: The word mark of the B pieces, a fixed value.
SPACE_MARK = "▁"
#: Links of a group that are written out one by one at most.
MANY = 1 << 10
#: B ids below this in a pair's one number.
WIDTH = 1 << 20


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers.  A: a byte-level tokenizer, with its ranks
    and pattern if they give the same ids faster.  B: pieces with byte
    fallback, none of which crosses into a word mark."""

    a: str
    b: str
    ranks: str | None = None
    pattern: str = ""


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Both tokenizers of a worker, with every id's bytes."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.b = SentencePieceProcessor(model_file=files.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        if len(pieces) >= WIDTH:
            raise ValueError(f"pieces of B must be fewer than {WIDTH}")
        #: Whether a text may be cut before a space: no piece goes on over a word mark.
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.fast = None
        if files.ranks:
            import tiktoken
            with open(files.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        # Beyond these characters the pattern depends on the age of Unicode tables.
        self.beyond = re.compile("[^\\x00-ɏ]").search

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of space and ``text``; none if either's bytes differ."""
        whole = " " + text
        raw = whole.encode()
        if self.fast is not None and not self.beyond(whole):
            a = self.fast.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
        else:
            a = np.array(self.a.encode(whole, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode(text), dtype=np.int64)
        for ids, known in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(known.__getitem__, ids.tolist())) != raw:
                return None
        return a, b


@lru_cache(maxsize=2)
def encoder(files: Tokenizers) -> Encoder:
    return Encoder(files)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """``text`` cut before spaces between two letters into parts that begin
    where a part of ``size`` code points ends at the earliest.  The space
    before each part is the one that both tokenizers put, or see, there."""
    found, at = [], 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if not gap:
            break
        found.append(text[at:gap.start() + 1])
        at = gap.end()
    return [*found, text[at:]]


def written(ids) -> str:
    return ",".join(map(str, ids))


def links_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs of one group and how many links each has."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (x[:, None] * WIDTH + y).ravel(), np.outer(n, m).ravel()


def totals(pairs: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links by distinct pair."""
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(back, np.concatenate(links)).astype(np.int64)


NONE = np.zeros(0, dtype=np.int64)


@dataclass
class Fragment:
    """The tokens of a byte range.  ``cut``: whether a common end lies in it;
    without one all its tokens are in the prefix.  ``closed`` has the groups
    written out, in order, and ``pair``, ``links`` their links by id pair."""

    cut: bool = False
    prefix: tuple = (NONE, NONE)
    closed: tuple = ()
    groups: int = 0
    pair: np.ndarray = field(default_factory=lambda: NONE)
    links: np.ndarray = field(default_factory=lambda: NONE)
    suffix: tuple = (NONE, NONE)

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, this one's first."""
        if not self.cut:
            return Fragment(other.cut, joined(self.prefix, other.prefix), other.closed, other.groups, other.pair,
                            other.links, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.closed, self.groups, self.pair, self.links,
                            joined(self.suffix, other.prefix))
        middle = closed_group(joined(self.suffix, other.prefix))
        # The closed texts stay in parts until they are written: no copy per step.
        pair, links = totals([self.pair, middle.pair, other.pair], [self.links, middle.links, other.links])
        return Fragment(True, self.prefix, self.closed + middle.closed + other.closed,
                        self.groups + middle.groups + other.groups, pair, links, other.suffix)


def joined(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(z) for z in zip(x, y))


def closed_group(tokens: tuple) -> Fragment:
    """A closed group of these tokens; nothing if there are none."""
    a, b = tokens
    if not len(a) and not len(b):
        return Fragment(cut=True)
    pair, links = links_of(a, b)
    return Fragment(True, closed=(f"{written(a)}|{written(b)}",), groups=1, pair=pair, links=links)


def fragment(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of tokens with their ends."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(False, (a, b))
    at_a, at_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
    head, tail = (a[:at_a[0]], b[:at_b[0]]), (a[at_a[-1]:], b[at_b[-1]:])
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    inner_a, inner_b = a[at_a[0]:at_a[-1]], b[at_b[0]:at_b[-1]]
    start_a, start_b = at_a[:-1] - at_a[0], at_b[:-1] - at_b[0]
    # Links of the usual groups are written out side by side; a group of many is counted by distinct ids.
    many = size_a * size_b > MANY
    group = np.repeat(np.arange(len(size_a)), size_a)
    each = np.where(many, 0, size_b)[group]
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    pairs = [np.repeat(inner_a, each) * WIDTH + inner_b[np.repeat(start_b[group], each) + nth]]
    links = [np.ones(len(pairs[0]), dtype=np.int64)]
    for i in np.flatnonzero(many):
        p, n = links_of(inner_a[start_a[i]:start_a[i] + size_a[i]], inner_b[start_b[i]:start_b[i] + size_b[i]])
        pairs.append(p)
        links.append(n)
    return Fragment(True, head, groups_written(inner_a, inner_b, size_a, size_b), len(size_a),
                    *totals(pairs, links), tail)


NAMES: list[str] = []


def names(count: int) -> list[str]:
    """Every id's three ways of writing, before a comma, a bar and a semicolon."""
    while len(NAMES) < 3 * count:
        NAMES.extend(f"{len(NAMES) // 3}{sign}" for sign in ",|;")
    return NAMES


def groups_written(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple:
    """Groups as ``a1,a2|b1;a3|b2``, in one text."""
    if not len(size_a):
        return ()
    # Each id with the sign after it: a comma inside a group's side, else | or ;.
    groups = np.arange(len(size_a))
    side = np.concatenate([np.repeat(groups * 2, size_a), np.repeat(groups * 2 + 1, size_b)])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([a, b])[order]
    sign = np.where(np.append(side[1:] != side[:-1], True), side % 2 + 1, 0)
    known = names(int(ids.max()) + 1)
    return ("".join(map(known.__getitem__, (ids * 3 + sign).tolist()))[:-1],)


def product(fragments) -> Fragment:
    return reduce(Fragment.__add__, fragments, Fragment())


def finished(whole: Fragment) -> Fragment:
    """The fragment of a whole document: its two ends are common ends, so what
    is open at them is closed."""
    if not whole.cut:
        return closed_group(whole.prefix)
    first, last = closed_group(whole.prefix), closed_group(whole.suffix)
    pair, links = totals([first.pair, whole.pair, last.pair], [first.links, whole.links, last.links])
    return Fragment(True, closed=first.closed + whole.closed + last.closed,
                    groups=first.groups + whole.groups + last.groups, pair=pair, links=links)


# ------------------------------------------------------------------ Spark

#: A fragment as a row; ids and links as little-endian 64-bit numbers.
FRAGMENT = ("row long, doc_id long, part long, parts long, valid boolean, n_a long, n_b long, cut boolean, prefix_a binary, "
            "prefix_b binary, closed string, groups long, pair binary, links binary, suffix_a binary, suffix_b binary")
FRAGMENT_ROW = pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
                                          "string": pa.string()}[f.split()[1]]) for f in FRAGMENT.split(", ")])
DOCUMENT = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, "
            "b array<int>, links array<long>")
DOCUMENT_ROW = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [
    ("groups", pa.string()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))])


def raw(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8").astype(np.int64)


def packed(row: int, doc_id: int | None, part: int, parts: int, valid: bool, n_a: int, n_b: int, f: Fragment) -> dict:
    return {"row": row, "doc_id": doc_id, "part": part, "parts": parts, "valid": valid, "n_a": n_a, "n_b": n_b, "cut": f.cut,
            "prefix_a": raw(f.prefix[0]), "prefix_b": raw(f.prefix[1]), "closed": ";".join(f.closed) if f.groups else "",
            "groups": f.groups, "pair": raw(f.pair), "links": raw(f.links), "suffix_a": raw(f.suffix[0]),
            "suffix_b": raw(f.suffix[1])}


def unpacked(r: dict) -> Fragment:
    return Fragment(r["cut"], (numbers(r["prefix_a"]), numbers(r["prefix_b"])), (r["closed"],) if r["groups"] else (),
                    r["groups"], numbers(r["pair"]), numbers(r["links"]),
                    (numbers(r["suffix_a"]), numbers(r["suffix_b"])))


def _cut(size: int):
    """(row, doc_id, part, parts, text): the chunks of the very long texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id")), batch.column("text")):
                found = chunks(text.as_py(), size)
                for at in range(0, len(found), 64):
                    some = found[at:at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()),
                         pa.array(range(at, at + len(some)), pa.int64()),
                         pa.array([len(found)] * len(some), pa.int64()), pa.array(some, pa.string())],
                        names=["row", "doc_id", "part", "parts", "text"])
    return run


def encoded(tools: Encoder, text: str) -> tuple[bool, int, int, Fragment]:
    ids = tools.ids(text)
    if ids is None:
        return False, 0, 0, Fragment()
    a, b = ids
    made = fragment(a, b, np.cumsum(tools.sizes_a[a]), np.cumsum(tools.sizes_b[b]))
    return True, len(a), len(b), made


def _fragments(files: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoder(files)
        for batch in batches:
            for r in batch.to_pylist():
                made = packed(r["row"], r["doc_id"], r["part"], r["parts"], *encoded(tools, r["text"]))
                yield pa.RecordBatch.from_pylist([made], schema=FRAGMENT_ROW)
    return run


def _composed():
    """The product of some neighbouring fragments of one document."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["step"]).to_pylist(), key=lambda r: r["part"])
        whole = product(map(unpacked, rows))
        made = packed(rows[0]["row"], rows[0]["doc_id"], key[1].as_py(), -(-rows[0]["parts"] // FAN_IN), all(r["valid"] for r in rows),
                      sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), whole)
        return pa.Table.from_pylist([made], schema=FRAGMENT_ROW)
    return run


def document_row(row: int, doc_id: int | None, valid: bool, n_a: int, n_b: int, whole: Fragment) -> dict:
    if not valid:
        n_a, n_b, whole = 0, 0, Fragment()
    done = finished(whole)
    return {"row": row, "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": done.groups,
            "n_links": int(done.links.sum()), "groups": ";".join(done.closed), "a": done.pair // WIDTH,
            "b": done.pair % WIDTH, "links": done.links}


def _documents(files: Tokenizers, size: int):
    """The usual texts: all chunks of a row composed where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoder(files)
        for batch in batches:
            made, held = [], 0
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                found = encoded(tools, text) if text else (False, 0, 0, Fragment())
                made.append(document_row(row, doc_id, *found))
                held += len(text)
                if held > size:
                    yield pa.RecordBatch.from_pylist(made, schema=DOCUMENT_ROW)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=DOCUMENT_ROW)
    return run


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            made = document_row(r["row"], r["doc_id"], r["valid"], r["n_a"], r["n_b"], unpacked(r))
            yield pa.RecordBatch.from_pylist([made], schema=DOCUMENT_ROW)


def align(docs: DataFrame, files: Tokenizers, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: row (a unique number), doc_id, n_a, n_b
    (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and the links
    by distinct id pair: a, b and links, arrays of one length.

    Texts that are null, empty, or not given back byte by byte by both
    tokenizers have no tokens: zeros and an empty groups.  Texts of more than
    ``chunk`` code points are cut, encoded and composed over tasks.  doc_id
    may repeat or be null; an empty table gives an empty result; other columns
    are not read."""
    small_batches(docs)
    text = text_or_empty(F.col("text"))
    long = F.length(text) > chunk
    # Usual and long texts have numbers of their own, should the two reads of docs differ in order.
    row = F.monotonically_increasing_id() * 2 + long.cast("long")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), long.alias("long"))
    usual = rows.where(~F.col("long")).select("row", "doc_id", "text").mapInArrow(_documents(files, chunk), DOCUMENT)
    whole = 1 << 62
    cut = rows.where("long").select("row", "doc_id", "text").mapInArrow(
        _cut(chunk if encoder(files).splits else whole), "row long, doc_id long, part long, parts long, text string")
    # Dealt by (row, part), so that the chunks of one document are encoded in many tasks.
    parts = materialize(cut.repartition("row", "part").mapInArrow(_fragments(files), FRAGMENT))
    most = parts.agg(F.max("parts")).first()[0] or 0
    while most > 1:
        parts = parts.withColumn("step", F.floor(F.col("part") / FAN_IN)).groupBy("row", "step").applyInArrow(
            _composed(), FRAGMENT)
        most = -(-most // FAN_IN)
    return usual.unionByName(parts.mapInArrow(_finished, DOCUMENT))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold the pair linked, and whether
    that is the highest of its A id.  ``links`` has a row per document and
    distinct pair; counts are added up before the shuffle, so a pair that is
    in every document is one row of each task."""
    counted = materialize(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")))
    highest = counted.groupBy("a").agg(F.max("count").alias("highest"))
    return materialize(counted.join(highest, "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")))


def frequent_from(counts: DataFrame, room: int = FREQUENT) -> int:
    """The count from which on there are at most ``room`` pairs, by counts of
    pairs per eighth of a power of two (at most 512 rows reach the driver)."""
    eighth = F.floor(F.log2("count") * 8)
    bins = counts.groupBy(eighth.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"),
                                                   F.max("count").alias("most")).collect()
    start = max((r["most"] for r in bins), default=0) + 1
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["n"]
        if room < 0:
            break
        start = r["least"]
    return start


def scored(links: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of (row, a, b, n): links of the document whose
    pair is its A id's best, and the pairs' counts over links.

    The most frequent pairs, which make most of all links, are met where they
    stand by broadcast: at most FREQUENT rows of fixed size.  The others, each
    in few documents, are met by a shuffle on the pair.  Both give sums per
    document."""
    counts = pair_counts(links)
    start = frequent_from(counts)
    frequent = materialize(counts.where(F.col("count") >= start))
    values = [F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum")]
    sums = [F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")]
    common = links.join(F.broadcast(frequent), ["a", "b"]).select("row", *values).groupBy("row").agg(*sums)
    rest = links.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti")
    rare = rest.join(counts.where(F.col("count") < start).hint("merge"), ["a", "b"]).select("row", *values)
    return common.unionByName(rare).groupBy("row").agg(*sums)


def digest(groups: Column) -> Column:
    return F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))


def alignment_report(docs: DataFrame, files: Tokenizers, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair has the highest count of its A id, ties included),
    count_sum (its pairs' counts over links; a pair's count is the number of
    rows that hold it linked) and groups_sha256, '' without tokens.

    The cases of ``align`` hold."""
    held = materialize(align(docs, files, chunk).withColumn("groups_sha256", digest(F.col("groups"))).drop("groups"))
    each = held.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("l")).select(
        "row", "l.a", "l.b", F.col("l.links").alias("n"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return held.drop("a", "b", "links").join(scored(each), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
