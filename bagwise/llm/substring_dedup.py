"""Substring deduplication by relative Lempel-Ziv factors.

Every document is a reference block, indexed by anchors: of GRAM-word grams
the least hash in every stretch of GRAM - 1 (winnowing).  A window of
WINDOW = 2 GRAM - 2 words always holds an anchor, and the grams of
neighbouring anchors touch.  A document is then parsed against the blocks:
each of its anchors that also stands in a document of a smaller doc_id points
to the first of these, and neighbouring anchors that point to one block at one
distance grow into a factor, which equals its stretch of the block word for
word.  Windows inside a factor are duplicates.

What a factor's ends may still hide is checked at its boundaries: windows
that lie in no factor, but whose own anchor (the least of their grams) stands
in several documents, are compared by the hash of all their words.  The first document to hold a window
never has it inside a factor, so a duplicate window is either in a factor or
meets its first holder in this comparison; the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import small_batches
from bagwise.llm.wordhash import hash_words, pieces, windows
from bagwise.session import materialize

WINDOW = 50
GRAM = WINDOW // 2 + 1
STRETCH = WINDOW - GRAM + 1
#: Of a row without doc_id: larger than any.
LAST = (1 << 63) - 1


def names() -> list[Column]:
    """doc_id (null: the largest) and a print of the text: one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("print")]


def split(text: str) -> list[bytes]:
    """The words: bytes split at the six ASCII separators only."""
    return text.encode().split()


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    held, have = values, 1
    while 2 * have <= width:
        held, have = np.minimum(held[:-have], held[have:]), 2 * have
    rest = width - have
    return np.minimum(held[:-rest], held[rest:]) if rest else held


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are the least of a stretch."""
    grams = windows(words, GRAM)
    if len(grams) < STRETCH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    lows = least(grams, STRETCH)
    # A gram is an anchor if a stretch that holds it has it as its minimum.
    ends = np.zeros(STRETCH - 1, dtype=np.uint64)
    high = ~least(~np.concatenate([ends, lows, ends]), STRETCH)
    at = np.flatnonzero(high == grams)
    return at, grams[at]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchor = pa.struct([("at", pa.int32()), ("hash", pa.int64())])
    for batch in batches:
        texts = batch.column("text")
        for a, e in pieces(texts):
            part = texts[a:e]
            hashes, at = hash_words(part, lower=False)
            found = [anchors(hashes[i:j]) for i, j in zip(at[:-1], at[1:])]
            counts = np.cumsum([0] + [len(x) for x, _ in found])
            flat = pa.StructArray.from_arrays([
                pa.array(np.concatenate([x for x, _ in found]).astype(np.int32)),
                pa.array(np.concatenate([h for _, h in found]).view(np.int64))], fields=list(anchor))
            digests = [hashlib.sha256(b" ".join(split(t))).hexdigest() for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:e], batch.column("doc")[a:e], batch.column("print")[a:e],
                 pa.array(np.diff(at), pa.int64()), pa.array(digests),
                 pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)],
                names=["doc_id", "doc", "print", "n_words", "sha", "anchors"])


INDEX = "doc_id long, doc long, print long, n_words long, sha string, anchors array<struct<at:int,hash:long>>"


def index(docs: DataFrame) -> DataFrame:
    """Every row's word count, digest of its words and anchors, kept in the
    checkpoint folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names(),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_indexed, INDEX))


def references(indexed: DataFrame) -> DataFrame:
    """Per document, its anchors that stand in several documents, each with
    the first place in the first of these: doc, print, found."""
    each = indexed.select("doc", "print", F.inline("anchors"))
    first = each.groupBy(F.col("hash").alias("same")).agg(F.min("doc").alias("ref"), F.max("doc").alias("last"))
    several = materialize(first.where("ref < last").select("same", "ref"))
    shared = materialize(each.join(several, F.col("hash") == F.col("same")).select("doc", "print", "hash", "at", "ref"))
    places = materialize(shared.where("doc = ref").groupBy(F.col("hash").alias("same")).agg(
        F.min("at").alias("ref_at")))
    found = shared.join(places, F.col("hash") == F.col("same"))
    return found.groupBy("doc", "print").agg(F.collect_set(F.struct("at", "ref", "ref_at")).alias("found"))


def parse(words: np.ndarray, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray,
          doc: int) -> tuple[np.ndarray, np.ndarray]:
    """(inside, unsure): starts of windows inside a factor, and of the other
    windows whose own anchor stands in several documents.  ``at``, ``ref`` and
    ``ref_at``: the shared anchors, sorted by place."""
    n_words = len(words)
    n = n_words - WINDOW + 1
    grams = windows(words, GRAM)
    plain = np.isin(least(grams, STRETCH), grams[at])
    delta = np.zeros(n_words + 1, dtype=np.int64)
    own = ref < doc
    if own.any():
        a, r, d = at[own], ref[own], (ref_at - at)[own]
        cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(d) != 0) | (np.diff(a) > GRAM)) + 1
        starts, ends = a[np.concatenate([[0], cut])], a[np.concatenate([cut - 1, [len(a) - 1]])] + GRAM
        long = ends - starts >= WINDOW
        np.add.at(delta, starts[long], 1)
        np.add.at(delta, ends[long] - WINDOW + 1, -1)
    inside = np.cumsum(delta)[:n] > 0
    return np.flatnonzero(inside), np.flatnonzero(plain & ~inside)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, print, text, found -> unsure windows: doc, print, at, h1, h2."""
    for batch in batches:
        texts = batch.column("text")
        for a, e in pieces(texts):
            hashes, bounds = hash_words(texts[a:e], lower=False)
            out = {k: [] for k in ("doc", "print", "at", "h1", "h2")}
            for i in range(a, e):
                words = hashes[bounds[i - a]:bounds[i - a + 1]]
                inside, unsure = _windows_of(words, batch.column("found")[i], batch.column("doc")[i].as_py())
                for name, value in (("doc", batch.column("doc")[i].as_py()), ("print", batch.column("print")[i].as_py())):
                    out[name].append(np.full(len(unsure), value, dtype=np.int64))
                out["at"].append(unsure.astype(np.int32))
                one, two = (windows(words, WINDOW, seed)[unsure].view(np.int64) for seed in (1, 2))
                out["h1"].append(one)
                out["h2"].append(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))


def _windows_of(words: np.ndarray, found: pa.Scalar, doc: int) -> tuple[np.ndarray, np.ndarray]:
    rows = found.values
    at, ref, ref_at = (rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "ref", "ref_at"))
    order = np.argsort(at)
    return parse(words, at[order], ref[order], ref_at[order], doc)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, print, text, found, extra (starts of further duplicate windows)
    -> doc, print, n_removed, kept_sha, kept_text."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text, doc = batch.column("text")[i].as_py(), batch.column("doc")[i].as_py()
            hashes, _ = hash_words(pa.array([text]), lower=False)
            inside, _ = _windows_of(hashes, batch.column("found")[i], doc)
            starts = np.array(batch.column("extra")[i].as_py() or [], dtype=np.int64)
            delta = np.zeros(len(hashes) + 1, dtype=np.int64)
            for s in (inside, starts):
                np.add.at(delta, s, 1)
                np.add.at(delta, s + WINDOW, -1)
            gone = np.cumsum(delta)[:-1] > 0
            kept = b" ".join(w for w, g in zip(split(text), gone.tolist()) if not g)
            rows.append((doc, batch.column("print")[i].as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                         kept.decode()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
            names=["doc", "print", "n_removed", "kept_sha", "kept_text"])


def cleaned(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc, print, n_removed, kept_sha, kept_text of the documents that share
    an anchor with another."""
    found = references(indexed)
    own = docs.where("text IS NOT NULL").select(*names(), "text").join(found, ["doc", "print"])
    held = materialize(own.dropDuplicates(["doc", "print"]))
    unsure = materialize(held.mapInArrow(_parsed, "doc long, print long, at int, h1 long, h2 long"))
    first = unsure.groupBy(F.col("h1").alias("s1"), F.col("h2").alias("s2")).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    twice = unsure.join(materialize(first.select("s1", "s2", "first")),
                        (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))).where("doc > first")
    extra = twice.groupBy("doc", "print").agg(F.collect_list("at").alias("extra"))
    return held.join(extra, ["doc", "print"], "left").select("doc", "print", "text", "found", "extra").mapInArrow(
        _cleaned, "doc long, print long, n_removed long, kept_sha string, kept_text string")


def substring_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word in a window of WINDOW words whose sequence also
    starts in a document of a smaller doc_id.  Rows of one doc_id remove
    nothing from each other; a null doc_id counts as larger than any; a null
    or empty text has no words (kept_sha256 is that of the empty string).  An
    empty table gives an empty result; other columns are not read."""
    small_batches(docs)
    indexed = index(docs)
    changed = cleaned(docs, indexed).select(
        F.col("doc").alias("d"), F.col("print").alias("p"), "n_removed", "kept_sha")
    rows = indexed.select("doc_id", "doc", "print", "n_words", "sha")
    out = rows.join(changed, (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("kept_sha", "sha").alias("kept_sha256"))
