"""Fill-in-middle, cross-tokenizer alignment and exact top-k against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagwise.llm import alignment, fill_in_middle, queries, topk_search
from tests.llm.rows import SCHEMA, awkward, frame, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------ fill in middle

def lined():
    r = random.Random(11)
    texts = ["\n", "\n\n\n", "a\n", "a\nb", "\na", "x\r\ny\r\n", "has <P> in it\nand more\n", "<S", "<M>", "<\nP>\n",
             "é\n日本\n\U0001f600\n" * 20, "l\n" * 5000]
    texts += ["".join(prose(i * 7 + j, r.randint(0, 5)) + "\n" * r.randint(0, 2) for j in range(r.randint(1, 12)))
              for i in range(60)]
    return [(3000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


def middle(doc_id, text, rates):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rates.fim:
        return doc_id, len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < rates.spm:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("extra,rates", [(False, fill_in_middle.Rates()), (True, fill_in_middle.Rates(3, 60, 20))])
def test_fill_in_middle_matches_brute_force(spark, extra, rates):
    rows = awkward() + lined()
    made = fill_in_middle.fill_in_middle(frame(spark, rows, extra), rates)
    out = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(middle(r[0], r[1], rates) for r in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((r[0], r[1] or "") for r in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_reruns_agree_on_any_layout(spark):
    df = frame(spark, lined())
    one = {tuple(r) for r in fill_in_middle.fill_in_middle(df.repartition(7)).collect()}
    assert one == {tuple(r) for r in fill_in_middle.fill_in_middle(df.coalesce(1)).collect()}


# ------------------------------------------------------------ alignment

@pytest.fixture(scope="module")
def tools():
    return alignment.encoder(queries.tokenizers())


def tokens(tools, text):
    """Whole texts, by the tokenizers themselves."""
    a = tools.a.encode(" " + text, add_special_tokens=False).ids
    return a, tools.b.encode(text)


def groups_of(tools, text):
    if not text:
        return []
    a, b = tokens(tools, text)
    raw = (" " + text).encode()
    if b"".join(tools.bytes_a[i] for i in a) != raw or b"".join(tools.bytes_b[i] for i in b) != raw:
        return []
    ends_a, ends_b = (np.cumsum([len(k[i]) for i in ids]).tolist() for ids, k in ((a, tools.bytes_a), (b, tools.bytes_b)))
    common = sorted(set(ends_a) & set(ends_b))
    out = [([], []) for _ in common]
    for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
        g = 0
        for i, e in zip(ids, ends):
            out[g][side].append(i)
            g += e == common[g]
    return out


def odd_texts():
    r = random.Random(5)
    texts = ["<|endoftext|> <s> a </s> <unk> <0x0A>", "▁ marked", "café ﬁ ½ ´ ́a", "a\tb\n\n c  d   e", "日本語のテキスト" * 9,
             "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 mixed " * 5, "x" * 3000, " lead", "trail ", "'s 're DON'T 123 4567",
             "def f(x):\n    return x**2  # sq\n" * 8]
    alphabet = "ab cXé日  \n\t.,'0<>▁"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(40)]
    texts += [prose(300 + i, r.randint(1, 400)) for i in range(20)]
    return [(6000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


def aligned(tools, rows):
    found = [groups_of(tools, r[1]) for r in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    docs = Counter(p for l in links for p in l)
    highest = defaultdict(int)
    for (x, _), n in docs.items():
        highest[x] = max(highest[x], n)
    out = []
    for r, g, l in zip(rows, found, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(l.values()),
                    sum(n for p, n in l.items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in l.items()),
                    sha(text) if text else ""))
    return out


@pytest.mark.parametrize("extra,chunk,frequent", [(False, 1 << 16, 100_000), (True, 64, 200), (False, 7, 0)])
def test_alignment_matches_brute_force(spark, tools, monkeypatch, extra, chunk, frequent):
    short = [r for r in awkward() if len(r[1] or "") < 40_000 or chunk > 1000]
    rows = short + odd_texts()
    monkeypatch.setattr(alignment, "FAN_IN", 4)
    monkeypatch.setattr(alignment.frequent_from, "__defaults__", (frequent,))
    out = alignment.alignment_report(frame(spark, rows, extra), queries.tokenizers(), chunk).collect()
    assert Counter(map(tuple, out)) == Counter(aligned(tools, rows))


def test_chunks_hold_the_text_and_its_tokens(tools):
    texts = [r[1] for r in odd_texts()] + [prose(9, 5000), ("it's x I'm " * 50) + "a<|endoftext|> b"]
    for text in texts:
        found = alignment.chunks(text, 50)
        assert " ".join(found) == text
        a, b = zip(*(tokens(tools, c) for c in found))
        assert (sum(a, []), sum(b, [])) == tokens(tools, text)
    assert len(alignment.chunks(prose(9, 5000), 50)) > 300


def test_quick_ids_are_the_tokenizers(tools):
    for r in odd_texts():
        got = tools.ids(r[1])
        if got is not None:
            assert (got[0].tolist(), got[1].tolist()) == tuple(map(list, tokens(tools, r[1])))


def same(x, y):
    plain = [(f.cut, *(t.tolist() for t in (*f.prefix, *f.suffix, f.pair, f.links)), ";".join(f.closed), f.groups)
             for f in (x, y)]
    return plain[0] == plain[1]


@pytest.mark.parametrize("many", [0, 1 << 10])
def test_fragments_are_a_monoid(monkeypatch, many):
    monkeypatch.setattr(alignment, "MANY", many)
    r = np.random.default_rng(3)
    for _ in range(60):
        size_a, size_b = r.integers(1, 5, 24), r.integers(1, 5, 30)
        a, b = r.integers(0, 6, 24), r.integers(0, 6, 30)
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        bounds = np.sort(r.integers(0, 90, 4))
        parts, last = [], 0
        for e in (*bounds, 1000):
            in_a, in_b = (ends_a > last) & (ends_a <= e), (ends_b > last) & (ends_b <= e)
            parts.append(alignment.fragment(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]))
            last = e
        whole = alignment.fragment(a, b, ends_a, ends_b)
        x, y, z, u, v = parts
        nothing = alignment.Fragment()
        assert same(((x + y) + z) + (u + v), x + ((y + (z + u)) + v))
        assert same(alignment.product(parts), whole)
        assert same(nothing + x, x) and same(x + nothing, x)


# ------------------------------------------------------------ top-k

VECTORS = "vec_id long, embedding array<float>, label int"


def top(rows, k=5):
    good = [(i, v, np.floor(256 * np.array(e, dtype=np.float32).astype(np.float64)).astype(np.int64))
            for i, (v, e, *_) in enumerate(rows)
            if e is not None and all(x is not None and np.isfinite(np.float32(x)) for x in e)]
    out = []
    for i, v, e in good:
        if v is None or v % 50:
            continue
        found = [(-int(sum(int(x) * int(y) for x, y in zip(e, f))), w is None, w) for j, w, f in good if j != i]
        out += [(v, n + 1, w, -s) for n, (s, _, w) in enumerate(sorted(found, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return out


def vectors(n=400, dims=12):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.1, dims)], 0) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(60)]                       # a common vector
    rows += [(50, rows[3][1], 1), (50, rows[50][1], 1), (None, rows[7][1], 1), (None, None, None)]
    rows += [(1000, None, 1), (1050, [0.1, None] * 6, 1), (1100, [float("nan")] * 12, 1), (1150, [float("inf")] + [0.0] * 11, 1),
             (1200, [], 1), (1250, [0.5, -0.5], 1), (1300, [0.0] * 12, 1), (-50, rows[9][1], 1), (1301, [-0.001] * 30, 1)]
    return rows


@pytest.mark.parametrize("sizes", [(8192, 4096), (50, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, sizes):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1))
    monkeypatch.setattr(topk_search.top_k, "__defaults__", (5, *sizes))
    out = topk_search.search(df).collect()
    assert Counter(map(tuple, out)) == Counter(top(rows))


def test_top_k_of_few_and_no_rows(spark):
    few = [(0, [0.5, 0.25], 0), (1, [0.1, 0.2], 0), (2, [1.0, 0.0], 0)]
    assert Counter(map(tuple, topk_search.search(spark.createDataFrame(few, VECTORS)).collect())) == Counter(top(few))
    assert topk_search.search(spark.createDataFrame(few[:1], VECTORS)).count() == 0
    assert topk_search.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 20, 1.0, -(2.0 ** 21)], 0), (1, [2.0 ** 22, 3.0, 2.0 ** 20], 0), (2, [-1.0, 2.0, 1.0], 0),
            (50, [2.0 ** 23, 0.0, 2.0 ** 22], 0)]
    assert Counter(map(tuple, topk_search.search(spark.createDataFrame(rows, VECTORS)).collect())) == Counter(top(rows))


def test_accumulated_scores_are_the_products():
    r = np.random.default_rng(2)
    block, asked = r.integers(-3, 3, (300, 20)), r.integers(-3, 3, (16, 20))
    block[:, 5] = 0
    block[:280, 6] = 0
    got = topk_search.accumulate(asked, topk_search.postings(block), 300)
    assert (got == asked @ block.T).all()
    big = np.array([[1 << 40]], dtype=object)
    assert topk_search.score_type(big.astype(np.int64), big.astype(np.int64)) is object


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_in_middle.fill_in_middle(empty).count() == 0
    assert alignment.alignment_report(empty, queries.tokenizers()).count() == 0


def test_units_of_sliced_batches():
    text = pa.array(["skip\n", "a\nb\n", "", "\n", "c"])[1:]
    made = fill_in_middle.units(pa.concat_arrays([text]))
    assert made.to_pylist() == [["a\n", "b\n"], [], ["\n"], ["c"]]
