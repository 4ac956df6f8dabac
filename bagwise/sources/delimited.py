"""Pipe-delimited record files with an explicit schema (S1) and charset
detection (S2).

Spark does not fail on wrong bytes (it yields replacement characters), so the
charset is decided first, for each file: every line valid UTF-8 -> UTF-8 (a
byte order mark is skipped), else cp949.  cp949 needs
``spark.sql.legacy.javaCharsets=true`` in Spark 4.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("digit_1", T.StringType(), True),
    T.StructField("digit_2", T.IntegerType(), True),
    T.StructField("digit_3", T.IntegerType(), True),
    T.StructField("text_obj", T.StringType(), True),
    T.StructField("text_mthd", T.StringType(), True),
    T.StructField("text_deal", T.StringType(), True),
])

UNLABELLED_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("text_obj", T.StringType(), True),
    T.StructField("text_mthd", T.StringType(), True),
    T.StructField("text_deal", T.StringType(), True),
])


def detect_charset(spark: SparkSession, path: str) -> str:
    """'UTF-8' if every line is valid UTF-8, else 'cp949' (S2)."""
    # the text source keeps the raw line bytes, so validity can be tested
    ok = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return "UTF-8" if ok in (True, None) else "cp949"


def file_charsets(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Charset -> files of ``path``, from one pass over the lines' bytes; file
    names, one per file, reach the driver.  Empty files have no lines and are
    left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    decided = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(decided):
        found.setdefault("UTF-8" if r["utf8"] else "cp949", []).append(unquote(r["file"]))
    return found


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA,
                   encoding: str | None = None, sep: str = "|") -> DataFrame:
    """Read headed, ``sep``-delimited text with a fixed schema (S1).  Without
    ``encoding`` each file is read in its own charset: one reader for the
    files of each, and their union."""
    found = {encoding: [path]} if encoding else file_charsets(spark, path) or {"UTF-8": [path]}
    parts = []
    for enc, files in sorted(found.items()):
        if enc.lower() not in ("utf-8", "utf8"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        parts.append(spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", enc)
                     .option("mode", "PERMISSIVE").csv(files))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
