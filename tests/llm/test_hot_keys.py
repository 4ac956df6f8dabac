"""Hot keys and thresholds without steps."""

import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from bagwise.llm import common, mixing, quality_rules, sharding
from tests.llm.rows import frame, prose


def test_one_key_and_text_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 50)
    rows = [(None, "same text", "en", "hot", 1)] * 333 + [(7, prose(i, 5), "en", "hot", 1) for i in range(200)]
    rows += [(i, prose(i, 4 + i % 3), "en", f"s{i % 3}", 1) for i in range(300)]
    df = frame(spark, rows)
    out = sharding.shard_documents(df, 4).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mixed = mixing.mix_documents(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in mixed) == Counter((r[0], len(r[1].split())) for r in rows)
    taken = Counter()
    for r in mixing.mix(mixing.sizes(df), per_bucket=100).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    target = {r.source_size: r.target for r in mixed}
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    assert {s: taken[s] for s in size} == {s: int(target[size[s]] + 1e-6) for s in size}


def test_jump_follows_an_independent_walk(spark):
    from pyspark.sql import functions as F

    def walk(key, shards):
        b, j, i = -1, 0, 0
        while j < shards:
            b, i = j, i + 1
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            seed = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SALT), seed=seed)
            drawn = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed)
            j = int((b + 1) / (((drawn >> 11) + 1) / 2.0 ** 53))
        return b

    got = spark.range(500).select("id", *[sharding.jump_shard(F.col("id"), n).alias(f"n{n}") for n in (1, 8, 100)])
    for r in got.collect():
        assert [r.n1, r.n8, r.n100] == [walk(r.id, n) for n in (1, 8, 100)]


def brute_fences(rows, prior=quality_rules.PRIOR_ROWS):
    """(lang, source, measure) -> quartile edges of the blended sketches."""
    import math

    def spread(counts):
        total = sum(counts.values())
        return {b: prior * n / total for b, n in counts.items()}

    levels = [defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)]
    for lang, source, value in rows:
        b = 0 if value <= quality_rules.SMALLEST else math.floor(
            math.log(value / quality_rules.SMALLEST) / math.log(quality_rules.RESOLUTION)) + 1
        for level, key in zip(levels, [(), (lang,), (lang, source)]):
            level[key][b] += 1
    for child in (1, 2):
        for key, counts in levels[child].items():
            for b, n in spread(levels[child - 1][key[:-1]]).items():
                counts[b] += n
    out = {}
    for key, counts in levels[2].items():
        upto, edges = 0, {}
        for b in sorted(counts):
            upto += counts[b]
            for q in (0.25, 0.75):
                if q not in edges and upto + 1e-6 >= q * sum(counts.values()):
                    edges[q] = 0.0 if b == 0 else quality_rules.SMALLEST * quality_rules.RESOLUTION ** b
        out[key] = edges
    return out


@pytest.mark.parametrize("small", [5, 199, 200])
def test_blended_fences_match_brute_force(spark, small):
    groups = [("en", "big", 600, 4.0), ("en", "small", small, 9.0), (None, None, 40, 6.0)]
    rows = [(lang, source, mean + (i % 11) / 10) for lang, source, n, mean in groups for i in range(n)]
    measured = spark.createDataFrame([(lang, source, 100, round(100 * v), 0, 1, 0) for lang, source, v in rows],
                                     "lang string, source string, n_words long, word_chars long, n_symbols long, "
                                     "n_lines long, n_dup_lines long")
    want = brute_fences([(lang, source, round(100 * v) / 100) for lang, source, v in rows])
    got = {(r.lang, r.source): r for r in quality_rules.fences(quality_rules.sketches(measured)).collect()}
    assert set(got) == set(want)
    for key, edges in want.items():
        reach = quality_rules.REACH * max(edges[0.75] - edges[0.25], 1.50)
        assert got[key].high_chars_per_word == pytest.approx(edges[0.75] + reach)
        assert got[key].low_chars_per_word == pytest.approx(edges[0.25] - reach)


def test_fences_have_no_step(spark):
    def high(n):
        rows = [("en", "big", 100, 400, 0, 1, 0)] * 900 + [("en", "small", 100, 900 + i % 50, 0, 1, 0) for i in range(n)]
        measured = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, "
                                               "n_symbols long, n_lines long, n_dup_lines long")
        found = quality_rules.fences(quality_rules.sketches(measured)).where("source = 'small'").collect()[0]
        return found.high_chars_per_word, found.low_chars_per_word

    for a, b in zip(high(199), high(200)):
        assert a == pytest.approx(b, rel=0.06)


def test_exact_dedup_of_rows_alike_and_of_shared_names(spark, monkeypatch):
    """A third of all rows alike in every column, ties of doc_id and text, and
    recipes whose names collide under the first salt."""
    from bagwise.llm import exact_dedup
    same, other = prose(1, 700), prose(2, 300)
    rows = [(7, same, "en", "s", 1)] * 300 + [(None, other, "en", "s", i % 3) for i in range(90)]
    rows += [(i, prose(i, 30), "en", "s", 1) for i in range(100, 400)]
    rows += [(9, same, "de", "t", i % 2) for i in range(50)] + [(None, None, None, None, None)] * 40
    df = frame(spark, rows).repartition(5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    out = exact_dedup.dedup_report(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out if r.kept) == Counter(
        [(9, 9, 350), (None, None, 90), (None, None, 40)] + [(i, i, 1) for i in range(100, 400)])
    assert Counter((r.doc_id, r.group_size) for r in out)[7, 350] == 300
    left = exact_dedup.drop_copies(df).collect()
    assert len(left) == 303 and {tuple(r) for r in left} <= set(rows) and sum(r.text == same for r in left) == 1
    weak = exact_dedup.F.md5
    monkeypatch.setattr(exact_dedup, "SALTS", ("", "b"))
    tried = []

    def collide(col):
        tried.append(1)
        return exact_dedup.F.lit("00") if len(tried) == 1 else weak(col)

    recipes = exact_dedup.recipes(df, [exact_dedup.F.col("doc_id")])
    monkeypatch.setattr(exact_dedup.F, "md5", collide)
    named, groups = exact_dedup.name_recipes(recipes)
    assert len(tried) == 2 and groups.count() == 303 and named.select("same").distinct().count() == 303
