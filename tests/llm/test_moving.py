"""Packing, exact dedup, sharding and mixing against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bagwise.llm import exact_dedup, mixing, packing, queries, sharding
from tests.llm.rows import SCHEMA, awkward, frame, prose


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


@pytest.mark.parametrize("extra", [False, True])
def test_shards_are_gapless_and_consistent(spark, extra):
    rows = awkward() + [(1000 + i, prose(i, 3), "en", "s", 1) for i in range(400)]
    out = sharding.shard_documents(frame(spark, rows, extra), 8).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.size, r.text_crc32) for r in out) == sorted(
        (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    other = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, rows[20:]), 8).collect()}
    assert all(other[r.doc_id] == r.shard for r in out if r.doc_id in other)


def test_jump_moves_only_into_the_new_shard(spark):
    from pyspark.sql import functions as F
    df = spark.range(3000)
    for n in (1, 5, 40, 200):
        got = df.select(sharding.jump_shard(F.col("id"), n).alias("a"),
                        sharding.jump_shard(F.col("id"), n + 1).alias("b")).collect()
        assert all(r.b in (r.a, n) and 0 <= r.a < n for r in got)
        counts = Counter(r.b for r in got)
        assert len(counts) == n + 1 or n > 100
        assert max(counts.values()) < 3000 / (n + 1) * 1.5 + 40


@pytest.mark.parametrize("extra", [False, True])
def test_mix_cuts_each_source_exactly(spark, extra):
    rows = awkward() + [(1000 + i, prose(i, i % 40), "en", f"s{i % 5}", 1) for i in range(300)]
    df = frame(spark, rows, extra)
    out = mixing.mix_documents(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    # Brute force: share by weight, cap, share the excess again.
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 2 * size[s] if s in capped else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    taken, seen = Counter(), {}
    by_row = {(r.doc_id, r["size"], r.source_size): r for r in out}
    for row in rows:
        r = by_row[(row[0], len(words(row[1])), size[row[3]])]
        assert r.target == pytest.approx(target[row[3]])
        assert 0 <= r.taken <= 2 * r["size"]
    for r in mixing.mix(mixing.sizes(df)).collect():
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-6) for s in names)


def test_mix_in_small_buckets_is_the_same(spark):
    rows = [(i, prose(i, i % 40), "en", f"s{i % 3}", 1) for i in range(300)]
    sized = mixing.sizes(frame(spark, rows))
    a = {r.doc_id: r.taken for r in mixing.mix(sized).collect()}
    assert a == {r.doc_id: r.taken for r in mixing.mix(sized, per_bucket=7).collect()}


@pytest.mark.parametrize("extra", [False, True])
def test_emitted_mix_has_the_taken_words(spark, extra):
    rows = awkward() + [(1000 + i, prose(i, i % 40), "en", f"s{i % 5}", 1) for i in range(200)]
    df = frame(spark, rows, extra)
    out = mixing.emit(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += len(words(r.text))
    want = Counter()
    for r in mixing.mix(mixing.sizes(df)).collect():
        want[r.source] += r.taken
    assert got == +want


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup_matches_brute_force(spark, extra):
    rows = awkward() + [(2000 + i, prose(i % 7, 400), "en", "s", i) for i in range(40)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    df = frame(spark, rows, extra)
    out = exact_dedup.dedup_report(df).collect()
    want = Counter((r[0], largest[r[1] or ""], len(groups[r[1] or ""])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((largest[t], t) for t in groups)


def test_chunks_are_the_text(spark):
    from pyspark.sql import functions as F
    df = frame(spark, [r for r in awkward() if r[1] is not None])
    for r in df.select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= exact_dedup.MAX_CHUNK for c in r.c)


@pytest.mark.parametrize("extra", [False, True])
def test_packing_is_a_round_trip(spark, extra):
    from tokenizers import Tokenizer
    rows = awkward() + [(1000 + i, prose(i, (i * 37) % 900), "en", "s", 1) for i in range(150)]
    model = Tokenizer.from_file(queries.vocabulary().tokenizer)
    out = packing.pack_documents(frame(spark, rows, extra), queries.vocabulary(), 60).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, ids))
        windows[r.sequence_id].append((r.offset, r.length))
    got = Counter()
    for (doc, total), parts in pieces.items():
        copies = sum(s == 0 for s, _ in parts)
        flat = sorted(set((s, tuple(i)) for s, i in parts)) if copies > 1 else sorted((s, tuple(i)) for s, i in parts)
        if copies == 1:
            assert [s for s, _ in flat] == list(np.cumsum([0] + [len(i) for _, i in flat])[:-1])
            got[(doc, tuple(x for _, i in flat for x in i))] += 1
    for doc, text, *_ in rows:
        ids = tuple(model.encode(text or "", add_special_tokens=False).ids) + (packing.END_ID,)
        if sum(r[0] == doc and (r[1] or "") == (text or "") for r in rows) == 1 and doc is not None:
            assert got[(doc, ids)] == 1
    assert sum(r.length for r in out) == sum(
        len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    short = 0
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    assert short <= -(-len(rows) // 60)


def test_rank_file_gives_the_tokenizers_ids():
    quick, width = packing.encoder(queries.vocabulary())
    full, _ = packing.encoder(packing.Vocabulary(queries.vocabulary().tokenizer))
    r = __import__("random").Random(4)
    texts = [r[1] for r in awkward() if r[1]] + [
        "".join(r.choice("ab Z9'\n\t ,.é\xa0\x85\x1cßñ<|endoftext|>$#\u0180") for _ in range(r.randint(1, 200))) for _ in range(500)]
    assert width == 2
    for t in texts:
        assert quick(t).tolist() == full(t).tolist()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty, 8).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.emit(empty).count() == 0
    assert exact_dedup.dedup_report(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert packing.pack_documents(empty, queries.vocabulary()).count() == 0
