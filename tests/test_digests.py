"""Row digests (D2-D5, R7, W6), charsets by file (S2) and evaluator state."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagwise.operators import digests, metrics, normalise, resample
from bagwise.sources.delimited import file_charsets, read_delimited

ROW = "id long, a string, b string, c long"


def rows(seed=0, n=300):
    r = random.Random(seed)
    pick = [None, "", "x", "y", "xy", "long " * 50]
    return [(r.choice([i, i, i, 5]), r.choice(pick), r.choice(pick), r.choice([None, 0, 1])) for i in range(n)]


@pytest.fixture(params=["real", "one name"])
def hashes(request, monkeypatch):
    """Digests as they are, or three names for all keys."""
    real = digests._hash
    if request.param == "one name":
        monkeypatch.setattr(digests, "_hash", lambda seed, cols: real(seed, cols) if seed == 2 else F.pmod(
            real(seed, cols), F.lit(3)))
    return request.param


def test_first_row_of_every_key(spark, hashes):
    data = rows()
    df = spark.createDataFrame(data, ROW)
    got = normalise.first_per_key(df, ["a", "b"]).collect()
    least, among = {}, {}
    for r in data:
        key = r[1:3]
        if key not in least or r[0] < least[key]:
            least[key], among[key] = r[0], set()
        if r[0] == least[key]:
            among[key].add(r)
    assert len(got) == len(least)
    assert all(tuple(g) in among[tuple(g)[1:3]] for g in got)
    # Nulls and empty texts are different keys, and so are ('x', null) and (null, 'x').
    assert {(None, "x"), ("x", None), ("", "x")} <= {tuple(g)[1:3] for g in got}


def test_rows_in_one(spark, hashes):
    left, right = rows(1), rows(2)[:100] + rows(1)[:120]
    bags = spark.createDataFrame([(i % 3, *r) for i, r in enumerate(right)], "bag_id int, " + ROW)
    got = resample.oob_by_rows(spark.createDataFrame(left, ROW), bags).collect()
    count = Counter(left) + Counter(set(right))
    assert Counter(map(tuple, got)) == Counter([r for r, n in count.items() if n == 1])


def test_texts_move_once(spark, tmp_path):
    """The bags' texts are in no exchange; the data's in one join."""
    path = str(tmp_path / "t")
    spark.createDataFrame(rows(), ROW).write.parquet(path)
    df = spark.read.parquet(path)
    narrow = digests.named(df, df.columns).select(*digests.NAME)
    plan = narrow.groupBy(*digests.NAME).count()._jdf.queryExecution().executedPlan().toString()
    assert not any("a#" in line or "b#" in line for line in plan.splitlines() if "Exchange" in line)


def test_charsets_by_file(spark, tmp_path):
    head = "id|digit_1|digit_2|digit_3|text_obj|text_mthd|text_deal\n"
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "one file.txt").write_bytes((head + "1|A|1|1|가나다|라|마\n").encode("cp949"))
    (folder / "two.txt").write_bytes((head + "2|B|2|2|바사아|자|차\n").encode())
    (folder / "three.txt").write_bytes(b"\xef\xbb\xbf" + (head + "3|C|3|3|카타|é|日本\n").encode())
    (folder / "four.txt").write_bytes((head + "4|D|4|4|plain|a|b\n").encode())
    (folder / "empty.txt").write_bytes(b"")
    found = file_charsets(spark, str(folder))
    assert {k: len(v) for k, v in found.items()} == {"cp949": 1, "UTF-8": 3}
    got = {r.id: (r.digit_1, r.text_obj) for r in read_delimited(spark, str(folder)).collect()}
    assert got == {"1": ("A", "가나다"), "2": ("B", "바사아"), "3": ("C", "카타"), "4": ("D", "plain")}


def test_state_is_the_sum_of_its_batches(spark, tmp_path):
    r = random.Random(3)
    data = [(i % 2, r.randrange(4), r.randrange(5), r.random()) for i in range(400)]
    pred = spark.createDataFrame(data, "model int, label int, pred int, loss double").withColumn(
        "part", F.monotonically_increasing_id() % 5)
    classes = spark.createDataFrame([(c,) for c in range(6)], "label int")
    want = {r.model: r for r in metrics.macro(pred, classes, ["model"], loss_col="loss").collect()}
    for order in ([0, 1, 2, 3, 4], [4, 2, 2, 0, 1, 3, 0]):
        state = metrics.EvaluationState(str(tmp_path / f"s{len(order)}"), by=["model"])
        for part in order:
            state.update(f"p{part}", pred.where(F.col("part") == part))
        for got in state.scores(spark, classes).collect():
            assert got.n == want[got.model].n
            for c in ("loss", "accuracy", "precision", "recall", "f1score"):
                assert got[c] == pytest.approx(want[got.model][c])
    with pytest.raises(ValueError):
        state.update("a/b", pred)
