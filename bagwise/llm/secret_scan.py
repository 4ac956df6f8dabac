"""Secret scan: fixed patterns and a randomness test battery.

Patterns give the base spans.  Every other long token is put to the battery:

* its encoding is inferred from its characters (hex, base32, base36, base62,
  base64) and its characters become numbers 0 to A-1;
* chi-squared uniformity of the alphabet, kept as the number of equal pairs
  m (X2 = A (2m + n) / n - n), against prose, whose pairs are equal with
  probability PROSE_MATCH or more: the chance that prose of this length
  looks as uniform is the p-value, so short tokens need more evenness;
* a runs test and a lag-1 serial-correlation test of the numbers give
  two-sided p-values against random order; their harmonic mean, which holds
  for tests that depend on each other, is the p-value of order.

The two p-values have opposite nulls (prose; random order), so they are not
multiplied into one: an alphabet is more even than chance, and no calm order
could make up for that.  Both are held to a false-discovery rate per length
class (Benjamini-Hochberg on binned p-values, counted over the whole corpus):
tokens that are not prose are found, and those of them that are found to be
ordered (alphabets, counters) are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.spans import apart, matches, place, report, scan
from bagwise.session import materialize

#: Base kinds in order and their patterns.
BASE = ["assign", "access", "hex"]
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST_PART = 6

LEAST_TOKEN = 20
TOKEN = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+"

#: Encoding: pattern and alphabet; the first that fits.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[0-9A-Za-z+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Index of coincidence of prose in Latin script (English 0.067, others higher).
PROSE_MATCH = 0.065
FALSE_DISCOVERY_RATE = 0.01
#: Of the tokens dropped for their order, so many may be random.
FALSE_ORDER_RATE = 0.01
LENGTH_CLASSES = (24, 32, 48, 96)
#: Bins per factor e of the p-value.
P_BINS = 4


def find(text: Column) -> list[Column]:
    lower = F.lower(text)
    named = reduce(lambda a, b: a | b, [lower.contains(k) for k in KEYWORDS])
    return [matches(text, "assign", ASSIGN, part=2, maybe=named),
            matches(text, "access", ACCESS, maybe=text.contains("AKIA")),
            matches(text, "hex", HEX), matches(text, "random", TOKEN)]


def normal_tail(x: Column) -> Column:
    """The chance of more than ``x`` (not negative): Abramowitz and Stegun
    26.2.17, error below 1e-7; far tails by the density."""
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / F.lit(2.5066282746310002) * series


def normal_cdf(z: Column) -> Column:
    upper = normal_tail(F.abs(z))
    return F.when(z < 0, upper).otherwise(1 - upper)


def two_sided(z: Column) -> Column:
    return F.greatest(2 * normal_tail(F.abs(z)), F.lit(1e-300))


def battery(tokens: DataFrame) -> DataFrame:
    """(token, ...) -> plus encoding, p (chance under prose), p_runs, p_serial
    (chances under random order) and p_order (their harmonic mean)."""
    token = F.col("token")
    encoding = F.coalesce(*[F.when(token.rlike(p), F.lit(e)) for e, (p, _) in ENCODINGS.items()])
    t = tokens.withColumn("encoding", encoding).where("encoding IS NOT NULL")
    # Joined, the alphabet is a column of its own and not worked out again for every character.
    known = tokens.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(e).alias("e"), F.lit(a).alias("alphabet"), F.lit(float(len(a))).alias("a"))
        for e, (_, a) in ENCODINGS.items()])))
    t = t.join(F.broadcast(known), F.col("encoding") == F.col("e")).drop("e")
    plain = F.when(F.col("encoding") == "hex", F.lower("token")).when(
        (F.col("encoding") == "base36"), F.lower("token")).otherwise(F.translate("token", "_-", "/+"))
    t = t.withColumn("chars", F.split(plain, "")).withColumn("n", F.size("chars").cast("double"))
    t = t.withColumn("v", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c) - 1))
    half, mean, var = (F.col("a") - 1) / 2, (F.col("a") - 1) / 2, (F.col("a") * F.col("a") - 1) / 12
    # Equal pairs: runs of the sorted numbers.
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("m"))
    pairs = F.aggregate(F.sort_array("v"), zero, lambda s, x: F.struct(
        x.alias("last"), F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(0)).cast("long").alias("run"),
        (s["m"] + F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(0))).alias("m")))["m"]
    first = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("s"))
    order = F.aggregate("v", first, lambda s, x: F.struct(
        x.cast("double").alias("last"),
        (s["runs"] + F.when((s["last"] > half) != (x > half), 1.0).otherwise(0.0)).alias("runs"),
        (s["s"] + F.coalesce((s["last"] - mean) * (x - mean), F.lit(0.0))).alias("s")))
    t = t.withColumn("m", pairs).withColumn("order", order)
    steps = F.col("n") - 1
    null = F.col("n") * steps / 2 * F.greatest(F.lit(PROSE_MATCH), 2 / F.col("a"))
    # Square roots make the number of equal pairs, a count, nearly normal with variance 1/4.
    z = 2 * (F.sqrt(F.col("m") + 0.375) - F.sqrt(null + 0.375))
    return (t.withColumn("p", F.greatest(normal_cdf(z), F.lit(1e-300)))
            .withColumn("p_runs", two_sided((F.col("order.runs") - 1 - steps / 2) / F.sqrt(steps / 4)))
            .withColumn("p_serial", two_sided(F.col("order.s") / (var * F.sqrt(steps))))
            .withColumn("p_order", 2 / (1 / F.col("p_runs") + 1 / F.col("p_serial")))
            .drop("alphabet", "a", "chars", "v", "order", "m"))


def rejected(tested: DataFrame, p: str, rate: float) -> DataFrame:
    """(length_class, least_bin): within each length class, the p-values in
    this bin and beyond are those that Benjamini-Hochberg rejects at ``rate``.
    A bin counts as its upper edge, so the rate holds."""
    counts = tested.groupBy("length_class", p_bin(p).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("length_class").orderBy(F.col("bin").desc())
    every = Window.partitionBy("length_class")
    counts = counts.withColumn("upto", F.sum("c").over(down)).withColumn("all", F.sum("c").over(every))
    edge = F.exp(-F.col("bin") / F.lit(float(P_BINS)))
    return (counts.where(edge * F.col("all") <= F.lit(rate) * F.col("upto"))
            .groupBy("length_class").agg(F.min("bin").alias("least_bin")))


def p_bin(p: str) -> Column:
    return F.floor(-F.log(p) * P_BINS).cast("int")


def discoveries(tested: DataFrame, rate: float = FALSE_DISCOVERY_RATE,
                order_rate: float = FALSE_ORDER_RATE) -> DataFrame:
    """The tokens that the battery calls random: not prose at a
    false-discovery rate of ``rate`` within each length class, and of those
    not ordered, held to ``order_rate`` alike."""
    length = F.size(F.filter(F.array(*[F.lit(c) for c in LENGTH_CLASSES]), lambda c: c <= F.col("n")))
    kept = ["row", "kind", "start", "end", "encoding", "p", "p_order"]
    tested = materialize(tested.withColumn("length_class", length).select(*kept, "length_class"))
    # At most a row per length class and bin.
    found = tested.join(F.broadcast(rejected(tested, "p", rate)), "length_class")
    found = found.where(p_bin("p") >= F.col("least_bin")).drop("least_bin")
    ordered = rejected(found, "p_order", order_rate)
    found = found.join(F.broadcast(ordered), "length_class", "left")
    random = F.col("least_bin").isNull() | (p_bin("p_order") < F.col("least_bin"))
    return found.where(random).select("row", "kind", "start", "end", "encoding", "p")


def find_secrets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned texts, spans).  Spans: row, kind, start, end; kinds assign,
    access, hex and ``random`` (found by the battery, apart from base spans)."""
    scanned = scan(docs, find)
    placed = place(scanned)
    base = placed.where((F.col("kind") != "random") & ((F.col("kind") != "assign") | (F.length("part") >= LEAST_PART)))
    base = base.select("row", "kind", "start", "end")
    found = discoveries(battery(placed.where("kind = 'random'").select("row", "kind", "start", "end", "token")))
    added = apart(found, base).select("row", "kind", "start", "end")
    return scanned, base.unionByName(added)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans (base_sha256 is that of the empty
    string).  Repeated rows are scanned and counted each; doc_id may be null;
    an empty table gives an empty result; other columns are not read."""
    scanned, spans = find_secrets(docs)
    return report(scanned, spans, BASE)
