"""Near-dedup, substring dedup, the quality classifier and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from bagwise.llm import components, near_dedup, quality_model, substring_dedup, wordhash
from tests.llm.rows import SCHEMA, awkward, frame, prose

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, k):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"w{r.randrange(10 ** 6)}"
    return " ".join(w)


def near_rows():
    """Groups of near copies around the threshold, chains, a common line, and
    texts of few words."""
    rows, base = [], [prose(100 + i, 120) for i in range(4)]
    for g, b in enumerate(base):
        rows += [edited(b, 1000 * g + i, i % 9) for i in range(40)]
    chain = prose(50, 100).split()
    rows += [" ".join(chain[i * 3:] + [f"c{j}" for j in range(i * 3)]) for i in range(12)]
    line = prose(60, 15)
    rows += [line + " " + prose(2000 + i, 20) for i in range(60)]
    rows += ["one two three", "One two THREE", "a b c d e", "a b c d e f", "a b c d e g", "a b c d"] * 2
    return [(3000 + i, t, "en", "s", 1) for i, t in enumerate(random.Random(1).sample(rows, len(rows)))]


def linked(rows, k, per_cent):
    """Least doc_id of each row's component, by comparing all pairs."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= per_cent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[find(i)] is None or r[0] < least[find(i)]):
            least[find(i)] = r[0]
    return [(r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)], len({find(i) for i in range(len(rows))})


@pytest.mark.parametrize("k,extra", [(4, False), (5, True)])
def test_near_duplicates_match_all_pairs(spark, k, extra):
    rows = awkward() + near_rows()
    want, groups = linked(rows, k, 80)
    df = frame(spark, rows, extra)
    out = near_dedup.near_duplicates(df, k, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert sum(r["first"] for r in out) == groups
    left = near_dedup.drop_near_copies(df, k, 80)
    assert left.columns == df.columns
    assert left.count() == groups


def test_crowded_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 3)
    monkeypatch.setattr(near_dedup, "LEADS", 2)
    rows = near_rows()
    want, _ = linked(rows, 4, 80)
    out = near_dedup.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(want)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    b[:2500] = a[:2500]
    one, two, both = near_dedup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(one, two) == both).all()
    more, less = int((one > two).sum()), int((one < two).sum())
    grid = np.linspace(0, 1, 201)
    best = grid[np.argmax([near_dedup.log_likelihood(3000.0, 3000.0, more, less, j) for j in grid])]
    assert abs(best - 2500 / 3500) < 0.12


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_word_hashes_do_not_depend_on_place():
    texts = ["a bc  a\tÉ", "", "bc", None, " x\n", "É bc a"]
    h, at = wordhash.hash_words(pa.array([t or "" for t in texts]), False)
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        w = words(t)
        assert at[i + 1] - at[i] == len(w)
        for x, y in zip(w, h[at[i]:at[i + 1]]):
            seen[x].add(int(y))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    low, _ = wordhash.hash_words(pa.array(["ABC É abc"]), True)
    assert low[0] == low[2] != low[1]


def passages():
    shared = [prose(70 + i, n) for i, n in enumerate((49, 50, 51, 80, 200))]
    rows = []
    for i in range(60):
        r = random.Random(i)
        parts = [prose(5000 + i, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared).split()
            cut = r.randint(0, 20) if r.random() < 0.5 else 0
            parts += [" ".join(s[cut:]), prose(r.randrange(10 ** 6), r.randint(0, 30))]
        rows.append((4000 + i, "\n".join(parts), "en", "s", 1))
    rows += [(4200, "la " * 300, "en", "s", 1), (4201, "la " * 200 + "lu " * 60, "en", "s", 1),
             (4202, prose(3, 300) + " end", "en", "s", 1), (4203, prose(3, 300), "en", "s", 1)]
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_substrings_match_brute_force(spark, extra):
    rows = awkward() + passages()
    last = 1 << 63
    first = {}
    for doc, text, *_ in rows:
        w, doc = words(text), last if doc is None else doc
        for p in range(len(w) - 49):
            key = tuple(w[p:p + 50])
            first[key] = min(first.get(key, last), doc)
    want = Counter()
    for doc, text, *_ in rows:
        w, own, gone = words(text), last if doc is None else doc, set()
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < own:
                gone.update(range(p, p + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    out = substring_dedup.substring_report(frame(spark, rows, extra)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 2000


def junk(i):
    base = prose(7000 + i, 60).split()
    return [" ".join(w + "***" for w in base), " ".join(w.upper() + "!!" for w in base) + " " + " ".join(
        w.upper() + "!!" for w in base), " | ".join(base), " ".join(base[:12]) + "\n" + ("x y z w\n" * 40)][i % 4]


@pytest.mark.parametrize("extra", [False, True])
def test_classifier_tells_junk_from_prose(spark, extra):
    good = [(8000 + i, prose(i, 20 + i).capitalize() + ".", "en", "s", 1) for i in range(200)]
    bad = [(9000 + i, junk(i), "en", "s", 1) for i in range(40)]
    df = frame(spark, awkward() + good + bad, extra)
    out = quality_model.quality_report(df).collect()
    assert len(out) == df.count()
    kept = {r.doc_id: r.kept for r in out if r.doc_id is not None and r.doc_id >= 8000}
    assert sum(kept[8000 + i] for i in range(200)) == 200
    assert sum(kept[9000 + i] for i in range(40)) <= 2
    assert not any(r.kept for r in out if r.n_words == 0)
    left = quality_model.keep_good(df)
    assert left.columns == df.columns
    assert left.count() == sum(r.kept for r in out)


def test_classifier_on_held_out_labels(spark):
    out = quality_model.quality_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.93
    assert all(r.kept for r in rows if r.quality == 1) or sum(
        not r.kept for r in rows if r.quality == 1) <= 0.01 * len(rows)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, held = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, held, SMALL)
        if name != "pack":
            assert got.columns == names
        rows, before = got.collect(), held.collect()
        if name == "exact_dedup":
            assert sorted(r.text for r in rows) == sorted({r.text for r in before})
        if name == "near_dedup":
            assert len(rows) == linked([(r.doc_id, r.text) for r in before], 5, 80)[1]
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        if name == "mix":
            assert sum(len(words(r.text)) for r in rows) == pytest.approx(
                1.5 * sum(len(words(r.text)) for r in before), rel=0.01)
        held = spark.createDataFrame(rows, got.schema) if name != "pack" else got
    assert held.agg({"length": "sum"}).collect()[0][0] > 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_copies(empty).count() == 0
    assert substring_dedup.substring_report(empty).count() == 0
    assert quality_model.quality_report(empty).count() == 0
    assert quality_model.keep_good(empty).count() == 0


def test_pipeline_run_is_its_stages(spark):
    held = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SMALL)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in rows) == Counter(
        (r.doc_id, r.start, bytes(r.ids)) for r in held.collect())
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in w) <= 2048 and [o for o, _ in sorted(w)] == [
        sum(n for _, n in sorted(w)[:i]) for i in range(len(w))] for w in windows.values())
