"""Sum-of-squares online packing of documents into fixed windows.

Documents are tokenised and cut at multiples of the window; a whole window is
a sequence of its own and the remainder is packed online.  A packer keeps a
level array, the number of open windows at each fill, and puts a remainder
where the sum of the squared counts grows least: into the open window of one
level, or into a new one (Csirik et al., sum-of-squares algorithm).

Packers work on hash-dealt blocks of documents of a bounded number, so the
work spreads over the cluster and a packer's memory is its open windows.  At
the end of a block the windows still open are emptied into each other by
cutting documents, so at most one window a block is not full.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.llm.common import bucket_count, small_batches

WINDOW = 2048
END_ID = 1
DOCS_PER_BLOCK = 4_000
#: Texts beyond these characters go to the full tokenizer: on them the rank
#: encoder's pattern does not depend on the age of its Unicode tables.
LATIN = "\u024f"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level vocabulary: the tokenizer, which defines the
    ids, and its merge ranks with their splitting pattern, which give the
    same ids in less time."""

    tokenizer: str
    ranks: str | None = None
    pattern: str = ""


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary):
    """(text -> ids as a numpy array, bytes an id needs); kept by a worker
    from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(vocabulary.tokenizer)
    width = 2 if model.get_vocab_size() <= 1 << 16 else 4

    def full(text: str) -> np.ndarray:
        return np.array(model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not vocabulary.ranks:
        return full, width
    import tiktoken
    with open(vocabulary.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=special)
    beyond = re.compile(f"[^\\x00-{LATIN}]").search
    known = set(special)

    def quick(text: str) -> np.ndarray:
        if beyond(text):
            return full(text)
        return fast.encode_to_numpy(text, allowed_special=known, disallowed_special=())

    return quick, width


def _encoded(vocabulary: Vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, width = encoder(vocabulary)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                rows = []
                for block, doc, text in zip(part["block"], part["doc_id"], part["text"]):
                    ids = np.concatenate([encode(text), end]).astype(f"<u{width}")
                    rows += [(block, doc, start, len(ids), ids[start:start + WINDOW].tobytes())
                             for start in range(0, len(ids), WINDOW)]
                yield pd.DataFrame(rows, columns=["block", "doc_id", "start", "doc_tokens", "ids"]).astype(
                    {"doc_id": "Int64"})
    return run


class Packer:
    """One block's windows.  ``add`` returns the pieces of a window that it
    fills; ``finish`` those of the windows left."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, size: int, piece) -> list | None:
        levels, window = self.levels, self.window
        if size == window:
            return [piece]
        # Into level h: the squares change by 2 (N[h+size] - N[h] + 1), or by
        # 1 - 2 N[h] if that fills the window; a new one by 2 N[size] + 1.
        here = levels[1:window - size + 1]
        cost = 2 * (levels[1 + size:window + 1] - here + 1)
        cost[-1] = 1 - 2 * here[-1]
        cost[here == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin()) if len(cost) else 0
        if not len(cost) or cost[best] > 2 * levels[size] + 1:
            held, level = [], 0
        else:
            level = best + 1
            held = self.open[level].pop()
            levels[level] -= 1
        held.append(piece)
        level += size
        if level == window:
            return held
        levels[level] += 1
        self.open.setdefault(level, []).append(held)
        return None

    def finish(self) -> list[list]:
        """The open windows' pieces laid end to end, fullest first, and cut
        at every full window."""
        rest = [held for level in sorted(self.open, reverse=True) for held in self.open[level]]
        full, now, room = [], [], self.window
        for doc, start, total, ids in (p for held in rest for p in held):
            while len(ids) > room:
                full.append([*now, (doc, start, total, ids[:room])])
                start, ids, now, room = start + room, ids[room:], [], self.window
            now.append((doc, start, total, ids))
            room -= len(ids)
            if not room:
                full.append(now)
                now, room = [], self.window
        return full + [now] * bool(now)


def _packed(blocks: int, vocabulary: Vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, width = encoder(vocabulary)
        block, packer, made, out = None, None, 0, []

        def lay(windows) -> None:
            nonlocal made
            for held in windows:
                at = 0
                for doc, start, total, ids in held:
                    out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, block + blocks * made, at))
                    at += len(ids)
                made += 1

        def frame() -> pd.DataFrame:
            f = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return f.astype({"doc_id": "Int64"})

        for batch in batches:
            columns = (batch[c] for c in ("block", "doc_id", "start", "doc_tokens", "ids"))
            for b, doc, start, total, ids in zip(*columns):
                if b != block:
                    if packer:
                        lay(packer.finish())
                    block, packer, made = b, Packer(), 0
                ids = np.frombuffer(ids, dtype=f"<u{width}")
                full = packer.add(len(ids), (None if pd.isna(doc) else int(doc), start, total, ids))
                if full:
                    lay([full])
                if len(out) >= 1000:
                    yield frame()
        if packer:
            lay(packer.finish())
        yield frame()
    return run


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every row, its end id included, lies in exactly one piece;
    offsets of a sequence run on from 0.  A null or empty text is the end id
    alone.  Rows are dealt to blocks by a hash of doc_id and text and packed
    in the order of another, so reruns agree; rows alike in both are
    interchangeable.  An empty table gives no pieces; other columns are not
    read.  sequence_id is unique, not dense."""
    small_batches(docs)
    blocks = bucket_count(docs, docs_per_block)
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(blocks)).alias("block"), "doc_id", text.alias("text"))
    pieces = dealt.mapInPandas(_encoded(vocabulary), "block long, doc_id long, start long, doc_tokens long, ids binary")
    ordered = pieces.repartition(blocks, "block").sortWithinPartitions(
        "block", F.xxhash64("doc_id", "doc_tokens", "start"), "doc_id", "ids")
    return ordered.mapInPandas(_packed(blocks, vocabulary), PIECES)
