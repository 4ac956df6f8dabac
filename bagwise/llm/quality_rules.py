"""Quality rules with thresholds learned per language and source.

Every document gets a few shape measures.  Their distributions are kept as
mergeable quantile sketches: counts of logarithmic bins (relative error
RESOLUTION), which add up over tasks, sources and languages.  A group's sketch
is blended with PRIOR_ROWS rows dealt like its language's, and a language's
with as many dealt like the corpus's: a small group leans on its parents, a
large one on itself, without a step at any size.  A group's fence lies REACH
spreads outside its quartiles.  Documents are filtered by a join with the
fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.common import SEP, SEP_CHARS, let, text_or_empty, words_of
from bagwise.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
RESOLUTION = 1.05
SMALLEST = 0.001
REACH = 3.0
#: Rows' weight of the parent's distribution in a group's sketch.
PRIOR_ROWS = 200
#: Counts are sums of fractions; a quantile is reached within so many rows.
SLACK = 1e-6
#: Measure: (columns above the line, below the line, least spread of a fence, lower fence too).
#: A group whose quartiles lie closer than the least spread is not held to less.
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words", 0.10, False),
    "dup_lines_per_line": ("n_dup_lines", "n_lines", 0.15, False),
    "chars_per_word": ("word_chars", "n_words", 1.50, True),
}


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words of an array that lie in a window of ``window`` words occurring
    twice or more in it.  Windows are compared by 64-bit hash."""
    def covered(found: Column) -> Column:
        n = F.size(found)
        twice = F.filter(found, lambda x, k: ((k > 0) & (F.get(found, k - 1)["h"] == x["h"]))
                         | ((k < n - 1) & (F.get(found, k + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, nothing, lambda s, p: F.struct(
            (p + window).alias("end"), (s["n"] + p + window - F.greatest(p, s["end"])).alias("n")))["n"]

    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return F.when(F.size(hashes) < window, F.lit(0)).otherwise(let(windows, lambda w: F.when(
            F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
                let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def echo_words(words: Column) -> Column:
    """Words of an array that equal the word before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("long")


def base_measures(text: Column, echoes: bool = False) -> Column:
    """Struct of the base counts of a non-null text, with ``echoes`` also of
    the words equal to the word before them."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SEP}]"))
    by_word = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeat_words(w).alias("twice"),
        *[echo_words(w).alias("echoes")] * echoes))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (
        F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda c: F.struct(
        c["w"]["n"].alias("n_words"), F.length(F.translate(text, SEP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        c["l"]["n"].alias("n_lines"), c["l"]["dup"].alias("n_dup_lines"), c["w"]["twice"].alias("n_repeat_words"),
        *[c["w"]["echoes"].alias("n_echo_words")] * echoes))


def measure(docs: DataFrame) -> DataFrame:
    """The base counts of every row; a null text has no words."""
    counted = docs.select("doc_id", "lang", "source", base_measures(text_or_empty(F.col("text"))).alias("m"))
    return counted.select("doc_id", "lang", "source", "m.*")


def value(name: str) -> Column:
    above, below, _, _ = MEASURES[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def bin_of(v: Column) -> Column:
    step = F.floor(F.log(v / SMALLEST) / F.log(F.lit(RESOLUTION)))
    return F.when(v <= SMALLEST, F.lit(0)).otherwise(step + 1).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): one quantile sketch per group and
    measure.  Counts of two tables' sketches add up."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(value(m)).alias("bin")) for m in MEASURES]))
    return (measured.where("n_words > 0").select("lang", "source", each.alias("m"))
            .groupBy("lang", "source", "m.measure", "m.bin").agg(F.count(F.lit(1)).alias("n")))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def blend(sketch: DataFrame, parent: DataFrame, by: list[str], parent_by: list[str],
          weight: float = PRIOR_ROWS) -> DataFrame:
    """``sketch`` merged over ``by``, with ``weight`` rows dealt like the
    ``parent`` sketch of each group (``parent_by``, a part of ``by``).  Null
    keys are keys like others.  A group has at most the parent's bins."""
    own = merge(sketch, by)
    whole = F.sum("n").over(Window.partitionBy(*parent_by))
    shares = parent.select(*[F.col(c).alias(f"p_{c}") for c in parent_by], F.col("bin").alias("p_bin"),
                           (F.lit(float(weight)) * F.col("n") / whole).alias("p_n"))
    on = F.lit(True)
    for c in parent_by:
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    leaned = own.select(*by).distinct().join(shares, on).select(
        *by, F.col("p_bin").alias("bin"), F.col("p_n").alias("n"))
    return merge(own.withColumn("n", F.col("n").cast("double")).unionByName(leaned), by)


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Merge ``sketch`` over ``by`` and read quantiles: by, rows and ``at``'s names."""
    merged = merge(sketch, by)
    group = Window.partitionBy(*by)
    merged = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("rows", F.sum("n").over(group))
    edge = F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.pow(F.lit(RESOLUTION), F.col("bin")))
    found = [F.min(F.when(F.col("upto") + SLACK >= F.lit(q) * F.col("rows"), edge)).alias(name) for name, q in at.items()]
    return merged.groupBy(*by).agg(F.first("rows").alias("rows"), *found)


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> low_<measure> and high_<measure>."""
    corpus = merge(sketch, ["measure"])
    by_lang = blend(sketch, corpus, ["lang", "measure"], ["measure"])
    own = blend(sketch, by_lang, ["lang", "source", "measure"], ["lang", "measure"])
    t = quantiles(own, ["lang", "source", "measure"], {"q25": 0.25, "q75": 0.75})
    bounds = []
    for m, (_, _, spread, lower) in MEASURES.items():
        reach = F.lit(REACH) * F.greatest(F.col("q75") - F.col("q25"), F.lit(spread))
        mine = F.col("measure") == m
        bounds.append(F.max(F.when(mine, F.col("q75") + reach)).alias(f"high_{m}"))
        bounds.append(F.max(F.when(mine, F.col("q25") - reach if lower else F.lit(-1.0))).alias(f"low_{m}"))
    return t.groupBy("lang", "source").agg(*bounds)


def judge(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and failed (the measures
    outside their fences).

    A null or empty text has no words and fails the base rule.  Null
    languages and sources are groups like others.  Repeated rows count as
    often as they occur.  An empty table gives an empty result; other columns
    are not read."""
    measured = materialize(measure(docs))
    bounds = fences(materialize(sketches(measured))).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("f_lang"))
                           & F.col("source").eqNullSafe(F.col("f_source")), "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    outside = [F.when((value(m) > F.col(f"high_{m}")) | (value(m) < F.col(f"low_{m}")), F.lit(m)) for m in MEASURES]
    judged = joined.withColumn("base_failed", base).withColumn("failed", F.concat_ws(",", *outside))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
