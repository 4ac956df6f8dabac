"""Fill-in-middle transformation over whole Arrow batches.

A text's units are its lines.  A batch is split into list arrays of units,
flattened with the parent row of each unit, numbered within its row, divided
by role (prefix, middle, suffix) at the row's two cuts, rebuilt into lists and
joined; no step goes row by row.  The two cuts and the form of a document
come from a hash of its id, so reruns and any layout of the rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import small_batches, text_or_empty
from bagwise.llm.wordhash import pieces

#: The sentinels of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Of a hundred documents ``fim`` are transformed, of a hundred of these
    ``spm`` get the suffix first."""

    seed: int = 7
    fim: int = 100
    spm: int = 50


def draws(seed: int) -> list[Column]:
    """Four 32-bit numbers h1 to h4 of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(name, 256), 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
            for i in range(4)]


def units(text: pa.Array) -> pa.ListArray:
    """The lines of each text, each with the line feed that ends it."""
    split = pc.split_pattern(text, "\n")
    line, parent = split.flatten(), pc.list_parent_indices(split)
    sizes = pc.list_value_length(split)
    last = pa.array(np.cumsum(sizes.to_numpy()) - 1)
    is_last = np.zeros(len(line), dtype=bool)
    is_last[last.to_numpy()] = True
    # What follows the last line feed is a unit only if it is not empty.
    whole = pc.binary_join_element_wise(line, pc.if_else(pa.array(is_last), pa.scalar("", line.type), pa.scalar("\n", line.type)),
                                        pa.scalar("", line.type))
    keep = pc.greater(pc.binary_length(whole), 0)
    return lists(whole.filter(keep), parent.filter(keep), len(text))


def lists(values: pa.Array, parent: pa.Array, rows: int) -> pa.ListArray:
    """Values in order of their parent rows as one list per row."""
    counts = np.bincount(parent.to_numpy(), minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def remainder(h: pa.Array, n: pa.Array) -> pa.Array:
    return pc.subtract(h, pc.multiply(pc.divide(h, n), n))


def parts(unit: pa.ListArray, h1: pa.Array, h2: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each row, cut at two unit numbers."""
    rows = len(unit)
    n = pc.cast(pc.list_value_length(unit), pa.int64())
    cuts = [remainder(h, pc.add(n, 1)) for h in (h1, h2)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    flat, parent = unit.flatten(), pc.list_parent_indices(unit)
    starts = np.concatenate([[0], np.cumsum(n.to_numpy())])
    ordinal = pa.array(np.arange(len(flat)) - starts[parent.to_numpy()])
    before, until = pc.less(ordinal, low.take(parent)), pc.less(ordinal, high.take(parent))
    roles = (before, pc.and_(until, pc.invert(before)), pc.invert(until))
    empty = pa.scalar("", flat.type)
    return [pc.binary_join(lists(flat.filter(r), parent.filter(r), rows), empty) for r in roles]


def transform(text: pa.Array, h: list[pa.Array], rates: Rates) -> tuple[pa.Array, ...]:
    """n, form, prefix_chars, middle_chars and output of a string array."""
    unit = units(text)
    prefix, middle, suffix = parts(unit, h[0], h[1])
    marked = pc.match_substring(text, PREFIX)
    for mark in (SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(text, mark))
    hundred = pa.array(np.full(len(text), 100))
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)),
                   pc.greater_equal(remainder(h[2], hundred), rates.fim))
    spm = pc.less(remainder(h[3], hundred), rates.spm)
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    empty, p, s, m = (pa.scalar(x, text.type) for x in ("", PREFIX, SUFFIX, MIDDLE))
    suffix_first = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty)
    prefix_first = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty)
    output = pc.if_else(plain, text, pc.if_else(spm, suffix_first, prefix_first))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return pc.cast(pc.list_value_length(unit), pa.int64()), form, *chars, output


def _transformed(rates: Rates):
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in pieces(batch.column("text")):
                part = batch.slice(a, e - a)
                # A fresh array, so that no kernel meets an offset of the batch.
                text = pa.concat_arrays([part.column("text")])
                made = transform(text, [part.column(f"h{i}") for i in (1, 2, 3, 4)], rates)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=names)
    return run


def fill_in_middle(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """One row per input row: doc_id, n (lines), form (plain, psm or spm),
    prefix_chars, middle_chars (null where plain) and output, the text to
    train on.

    A null text counts as empty; an empty text, or one that holds a sentinel,
    stays plain.  A null doc_id draws as the empty id, rows of one doc_id draw
    alike.  An empty table gives an empty result; other columns are not read.
    Batches are worked on in pieces of bounded bytes, a longer text alone."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"),
                       *draws(rates.seed))
    return rows.mapInArrow(_transformed(rates), RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part holds a sentinel, so the
    three that were put in are the only ones."""
    cut = F.split(output, "<[PSM]>", 4)
    return (F.when(form == PSM, F.concat(cut[1], cut[3], cut[2]))
            .when(form == SPM, F.concat(cut[2], cut[3], cut[1])).otherwise(output))
