"""Near-duplicate documents by SetSketch registers.

A document's shingle set is sketched by REGISTERS minima of exponential
hashes, kept on an exponential scale: K = 1 + floor(-log_BASE h), truncated
to 0..LIMIT (Ertl, SetSketch).  Registers merge by maximum and collide with a
probability that grows with the Jaccard similarity.  Bands of registers find
candidates; the joint likelihood of two sketches, given both set sizes, sets
aside those that the threshold all but rules out; the others are verified on
their full shingle sets.

Bands are not multiplied out.  Texts with equal sets are one node.  A node
whose set is too much its own (shingles that no other bucket member has) has
no link and goes.  In every band bucket one member, a lead, is compared with
the others; nodes linked so far are one component.  Then the members outside
the largest component lead, and are compared with the members of other
components whose own shingles leave room for the threshold, until a bucket is
one component or each of them has led.  Buckets that hold many components are
divided by further registers first.  So the components are those of all pairs
that share a band, without comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.common import small_batches
from bagwise.llm.components import components
from bagwise.llm.wordhash import hash_words, pieces, shingles
from bagwise.session import materialize

WORDS = 5
THRESHOLD = 80  # per cent
ROWS = 5
BANDS = 32
REGISTERS = ROWS * BANDS
BASE = 1.02
RATE = 20.0
LIMIT = (1 << 16) - 2
#: A candidate is set aside if the threshold is less likely than the best
#: estimate by this factor (natural logarithm).
SET_ASIDE = 14.0
#: Leads of a bucket in one round, and components in a bucket that is divided first.
LEADS = 512
CROWDED = 4096

_DRAWN = np.random.default_rng(4_060)
MULTIPLIERS = _DRAWN.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAWN.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each non-empty set of 64-bit hashes."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((REGISTERS, len(sets)), dtype=np.uint64)
    hashed = np.empty_like(joined)
    for i in range(REGISTERS):
        np.multiply(joined, MULTIPLIERS[i], out=hashed)
        np.add(hashed, SHIFTS[i], out=hashed)
        np.minimum.reduceat(hashed, starts, out=least[i])
    # The minimum of uniform hashes is the minimum of their exponentials.
    h = -np.log1p(-(least.T + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def _sketched(words: int):
    import xxhash
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("print2", pa.int64()), ("n", pa.int64()),
                        ("set", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, e in pieces(texts):
                hashes, at = hash_words(texts[a:e], lower=True)
                sets = [shingles(hashes[i:j], words) for i, j in zip(at[:-1], at[1:])]
                n = np.array([len(s) for s in sets])
                regs = np.zeros((len(sets), REGISTERS), dtype="<u2")
                if n.any():
                    regs[n > 0] = registers([s for s in sets if len(s)])
                part = batch.slice(a, e - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "doc_id", "print", "print2")] + [
                     pa.array(n, pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([r.tobytes() if k else None for r, k in zip(regs, n)], pa.binary())], schema=schema)
    return run


def prints() -> list[Column]:
    """128 bits that name a doc_id with its text, by which texts are found again."""
    return [F.xxhash64("doc_id", "text").alias("print"), F.xxhash64(F.lit(7), "doc_id", "text").alias("print2")]


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id, prints, n (distinct shingles), set (a 128-bit digest of
    the set) and registers of every row, kept in the checkpoint folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       *prints(), text.alias("text"))
    return materialize(rows.mapInArrow(
        _sketched(words), "row long, doc_id long, print long, print2 long, n long, set binary, regs binary"))


def register_slice(at: int, count: int) -> Column:
    return F.substring("regs", 2 * at + 1, 2 * count)


def log_likelihood(n_a, n_b, more, less, jaccard):
    """Of ``more`` registers larger in a, ``less`` smaller and the rest equal,
    at a Jaccard similarity (Ertl, joint estimation with known sizes)."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    tilt = (BASE - 1) / BASE

    def larger(x):
        return -np.log1p(-np.clip(x, 1e-9, 1.0) * tilt) / np.log(BASE)

    up, down = larger(u - v * jaccard), larger(v - u * jaccard)
    same = np.clip(1 - up - down, 1e-9, 1.0)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)


def _plausible(threshold: float):
    grid = np.linspace(0.0, 1.0, 41)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
                    for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
            most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
            each = np.stack([log_likelihood(n_a, n_b, more, less, np.minimum(j, most)) for j in grid])
            over = np.where(grid[:, None] >= threshold - 1e-9, each, -np.inf).max(axis=0)
            keep = pa.array(over >= each.max(axis=0) - SET_ASIDE)
            yield batch.select(["a", "b"]).filter(keep)
    return run


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = batch.column("text"), batch.column("node").to_numpy()
            for a, e in pieces(texts):
                hashes, at = hash_words(texts[a:e], lower=True)
                sets = [shingles(hashes[i:j], words) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[a:e], [len(s) for s in sets])),
                     pa.array(np.concatenate(sets).view(np.int64))], names=["node", "hash"])
    return run


#: Slots in which the shingles that a node lacks of its lead are counted.
SLOTS = 64
VERIFIED = "a long, b long, n_a long, common long, linked boolean, gaps array<short>"


def _verified(words: int, per_cent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("common", pa.int64()),
                        ("linked", pa.bool_()), ("gaps", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            rows = []
            for a, b, left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                                         batch.column("text_a"), batch.column("text_b")):
                if a != last:
                    last, held = a, shingles(hash_words(pa.array([left.as_py()]), True)[0], words)
                other = shingles(hash_words(pa.array([right.as_py()]), True)[0], words)
                lacks = held[~np.isin(held, other, assume_unique=True)]
                common = len(held) - len(lacks)
                gaps = np.bincount((lacks % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                rows.append((a, b, len(held), common, 100 * common >= per_cent * (len(held) + len(other) - common),
                             np.minimum(gaps, (1 << 15) - 1).astype(np.int16)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


#: What a bucket member carries: its shingles n, of which u its own, the lead it met, the lead's shingles and what
#: it lacks of them, in all and by slot.
MEMBER = ("node", "n", "u", "lead", "n_lead", "lack", "gaps")


class Search:
    """The rounds over one corpus.  Nodes are distinct shingle sets."""

    def __init__(self, docs: DataFrame, words: int, per_cent: int):
        small_batches(docs)
        self.words, self.per_cent = words, per_cent
        self.rows = sketch(docs, words)
        one = F.min_by(F.struct("n", "print", "print2", "regs"), "row").alias("of")
        self.classes = materialize(self.rows.where("n > 0").groupBy("set").agg(
            F.min("row").alias("node"), one).select("set", "node", "of.*"))
        # Sets too small to reach the threshold unless equal take no part: n - 1 of n is too little.
        least = -(-per_cent // (100 - per_cent)) if per_cent < 100 else 1 << 62
        self.nodes = self.classes.where(F.col("n") >= least).drop("set")
        bands = F.array(*[F.xxhash64(F.lit(i), register_slice(i * ROWS, ROWS)) for i in range(BANDS)])
        self.buckets = self._shared(self.nodes.select(F.explode(bands).alias("key"), "node"))
        self.texts = self._texts(docs)
        self.buckets = self._hopeful()
        self.links: list[DataFrame] = []

    def _shared(self, rows: DataFrame) -> DataFrame:
        """The rows of keys with more than one node, with the least node."""
        keys = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
        keys = materialize(keys.where("least < most").select("key", "least"))
        return materialize(rows.join(keys.hint("merge"), "key"))

    def _texts(self, docs: DataFrame) -> DataFrame:
        """(node, text) of the nodes in buckets."""
        wanted = self.nodes.join(self.buckets.select("node"), "node", "left_semi").select("print", "print2", "node")
        found = docs.select(*prints(), "text").join(wanted.hint("merge"), ["print", "print2"])
        once = F.row_number().over(Window.partitionBy("print", "print2").orderBy("node"))
        return materialize(found.withColumn("k", once).where("k = 1").select("node", "text"))

    def _hopeful(self) -> DataFrame:
        """(key, node, least, n, u) of the bucket members that can have a link: u of
        a node's n shingles stand in no other member of any bucket, so no
        other set shares more than n - u of them."""
        each = self.texts.mapInArrow(_shingled(self.words), "node long, hash long")
        once = each.groupBy("hash").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("c")).where("c = 1")
        alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("u"))
        sizes = self.nodes.select("node", "n").join(alone.hint("merge"), "node", "left").withColumn(
            "u", F.coalesce("u", F.lit(0)))
        hopeful = (F.col("n") - F.col("u")) * 100 >= F.col("n") * self.per_cent
        return materialize(self.buckets.select("key", "node").join(sizes.where(hopeful).hint("merge"), "node"))

    def possible(self) -> Column:
        """Whether a and b can reach the threshold.  Their own shingles lie
        outside each other.  If both met the same lead, they share of it no
        more than what neither lacks: in each slot one of them lacks the
        larger of both counts at least.  Outside of it they share no more than
        either has there that is not its own.  The lead itself has met them."""
        common = F.least(F.col("n_a") - F.col("u_a"), F.col("n_b") - F.col("u_b"))
        room = common * 100 >= F.greatest(F.col("n_a") + F.col("u_b"), F.col("n_b") + F.col("u_a")) * self.per_cent
        outside = F.least(*[F.col(f"n_{x}") - F.col(f"n_lead_{x}") + F.col(f"lack_{x}") - F.col(f"u_{x}") for x in "ab"])

        def near(lacked: Column) -> Column:
            shared = F.col("n_lead_a") - lacked + outside
            return shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * self.per_cent

        slots = F.zip_with("gaps_a", "gaps_b", lambda x, y: F.greatest(x, y).cast("long"))
        lacked = F.aggregate(slots, F.lit(0).cast("long"), lambda s, x: s + x)
        # The cheap bound first; the slots only where it leaves room.
        tight = F.when(near(F.greatest("lack_a", "lack_b")), near(lacked)).otherwise(False)
        met = (F.col("node_a") == F.col("lead_a")) | (F.col("node_b") == F.col("lead_b"))
        same = F.coalesce(F.col("lead_a") == F.col("lead_b"), F.lit(False))
        return room & (~same | (~met & tight))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Verify distinct (a, b) pairs; the links are added to ``links``."""
        small = self.nodes.select("node", "n", "regs")
        pairs = pairs.join(small.toDF("b", "n_b", "regs_b").hint("merge"), "b").join(
            small.toDF("a", "n_a", "regs_a").hint("merge"), "a")
        near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.per_cent
        likely = pairs.where(near).select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(
            _plausible(self.per_cent / 100), "a long, b long")
        # Never by broadcast: near copies are many times larger in memory than as compressed files.
        both = likely.join(self.texts.toDF("b", "text_b").hint("merge"), "b").join(
            self.texts.toDF("a", "text_a").hint("merge"), "a")
        scored = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(
            _verified(self.words, self.per_cent), VERIFIED))
        self.links.append(scored.where("linked").select("a", "b"))
        return scored

    def found(self) -> DataFrame:
        """(node, component) of every node with a link so far."""
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.union(more)
        return components(edges)

    def _divided(self, named: DataFrame, crowds: DataFrame, depth: int) -> DataFrame:
        """The crowds' members, divided by other registers; a pair at the
        threshold stays together in one of the parts with a probability as in
        the first bands."""
        inside = named.join(crowds.hint("merge"), "key").join(self.nodes.select("node", "regs").hint("merge"), "node")
        drawn = np.random.default_rng(depth)
        parts = F.array(*[F.xxhash64("key", F.lit(depth), F.lit(i), F.concat(
            *[register_slice(int(r), 1) for r in drawn.choice(REGISTERS, ROWS, replace=False)]))
            for i in range(BANDS)])
        return self._shared(inside.select(F.explode(parts).alias("key"), *MEMBER, "comp")).select("key", *MEMBER, "comp")

    def _sizes(self, named: DataFrame) -> DataFrame:
        """Of the keys that hold several components: how many, the members,
        the largest component and its members."""
        by_comp = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        by_key = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("members"),
                                            F.max(F.struct("c", "comp")).alias("top"))
        return materialize(by_key.where("comps > 1").select(
            "key", "comps", "members", F.col("top.c").alias("most"), F.col("top.comp").alias("largest")))

    def run(self) -> DataFrame:
        """(node, component) of every node with a link."""
        # First each node meets one lead only, a member with the fewest shingles of its own: copies of
        # one text differ least from the one that was changed least.
        own = F.struct("u", "node")
        leads = self.buckets.groupBy("key").agg(F.min(own).alias("lead"))
        first = self.compare(self.buckets.join(leads, "key").where("node <> lead.node").groupBy(F.col("node").alias("b")).agg(
            F.min("lead").alias("lead")).select("b", F.col("lead.node").alias("a")))
        # Shingles of its lead that a node lacks; a lead lacks none of its own.
        lacks = first.select(F.col("b").alias("node"), F.col("a").alias("lead"), F.col("n_a").alias("n_lead"),
                             (F.col("n_a") - F.col("common")).alias("lack"), "gaps")
        none = F.array_repeat(F.lit(0).cast("short"), SLOTS)
        lacks = lacks.unionByName(lacks.select(F.col("lead").alias("node"), "lead", "n_lead").distinct().withColumns(
            {"lack": F.lit(0).cast("long"), "gaps": none}))
        lacks = materialize(lacks.groupBy("node").agg(
            F.min(F.struct("lead", "n_lead", "lack", "gaps")).alias("l")).select("node", "l.*"))
        depth, found = 0, self.found()
        buckets = self.buckets.select("key", "node", "n", "u").join(lacks.hint("merge"), "node", "left")
        while True:
            named = materialize(buckets.join(found.hint("merge"), "node", "left").select(
                "key", *MEMBER, F.coalesce("component", "node").alias("comp")))
            sizes = self._sizes(named)
            if sizes.isEmpty():
                return found
            # A bucket that is one component is done.
            named = named.join(sizes.select("key"), "key", "left_semi")
            crowds = sizes.where(F.col("comps") > CROWDED).select("key")
            depth += 1
            if depth <= 8 and not crowds.isEmpty():
                split = self._divided(named, crowds, depth)
                named = materialize(named.join(crowds, "key", "left_anti").unionByName(split))
                sizes = self._sizes(named)
            nth = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            leads = materialize(named.join(sizes.hint("merge"), "key").where("comp <> largest").withColumn("nth", nth).where(
                F.col("nth") <= LEADS).select("key", *[F.col(c).alias(f"{c}_a") for c in (*MEMBER, "comp")]))
            links = len(self.links)
            met = named.select("key", *[F.col(c).alias(f"{c}_b") for c in (*MEMBER, "comp")]).join(
                leads.hint("merge"), ["key"]).where((F.col("comp_a") != F.col("comp_b")) & self.possible())
            self.compare(met.select(F.least("node_a", "node_b").alias("a"),
                                    F.greatest("node_a", "node_b").alias("b")).distinct())
            if not self.links[links].isEmpty():
                found = self.found()
            # A lead has met its whole bucket and leaves it; a bucket all of
            # whose members outside the largest component were leads is done.
            more = sizes.where(F.col("members") - F.col("most") > LEADS).select("key")
            if more.isEmpty():
                return found
            buckets = materialize(named.join(more.hint("merge"), "key", "left_semi").select("key", *MEMBER).join(
                leads.select("key", F.col("node_a").alias("node")).hint("merge"), ["key", "node"], "left_anti"))


def near_duplicates(docs: DataFrame, words: int = WORDS, per_cent: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, prints
    and first (whether the row is the one of its component to stay).

    A null or empty text, or one without words, has no shingles and is linked
    with nothing: its component is its own doc_id.  A text of fewer than
    ``words`` words is one shingle.  component_id is the least doc_id of the
    component (null only if all are), kept says that it is the row's own;
    rows under one doc_id may so be kept together, ``first`` marks one row
    per component.  An empty table gives an empty result; other columns are
    not read."""
    search = Search(docs, words, per_cent)
    found = search.run()
    classes = search.classes.join(found, "node", "left").select(
        F.col("set").alias("same"), F.coalesce("component", "node").alias("component"))
    rows = search.rows.drop("regs")
    rows = rows.join(materialize(classes), F.col("set") == F.col("same"), "left").drop("same", "set")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "row")))
    best = materialize(rows.groupBy(F.col("component").alias("c")).agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))["row"].alias("best")))
    out = rows.join(best, F.col("component") == F.col("c"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      "print", "print2", (F.col("row") == F.col("best")).alias("first"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, per_cent: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row per component, the least doc_id's, with its
    columns.  Of rows alike in doc_id and text one stays, the first by a hash
    of all columns."""
    named = [F.col(f"`{c}`") for c in docs.columns]
    stay = near_duplicates(docs, words, per_cent).where("first").select(
        F.col("print").alias("__print"), F.col("print2").alias("__print2"))
    one, two = prints()
    marked = docs.select(F.struct(*named).alias("__doc"), one.alias("__print"), two.alias("__print2"))
    kept = marked.join(stay, ["__print", "__print2"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("__print", "__print2").orderBy(F.xxhash64("__doc")))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(
        *[F.col("__doc").getField(c).alias(c) for c in docs.columns])
