"""Small tables with the awkward cases that every corpus operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    same = prose(2, 120)
    texts = [None, "", " \t\n ", "a", long, same, same, same + " tail", prose(3, 300), "x" * 50_000,
             "été ñandú 日本語 \U0001f600 <|endoftext|> a  b c\x1c d \r\n e", prose(4, 20)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 1 else f"src{i % 3}", len(t) if t else None)
            for i, t in enumerate(texts)]
    rows += [(5, same, "en", "src2", len(same))] * 2           # repeated rows
    rows += [(None, same, None, None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows, extra: bool = False):
    """A documents table; with ``extra``, also columns whose names clash with
    names that the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("size", "key", "bucket", "taken", "recipe", "kept", "shard", "block", "n", "ids", "id", "a.b"):
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
    return df
