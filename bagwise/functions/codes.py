"""Category-code and text expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_COLS = ("text_obj", "text_mthd", "text_deal")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def num2code(x, digits: int) -> Column:
    """Left-pad with zeros to ``digits``; longer values pass unchanged.

    Plain ``lpad`` would truncate '1234' to '123'."""
    s = _c(x).cast("string")
    return F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0"))


def make_code(d1="digit_1", d2="digit_2", d3="digit_3") -> Column:
    """digit_1 + pad2(digit_2) + pad3(digit_3) (P2); a null part counts as
    empty (P3), so no row loses its code: A, null, 1 -> 'A00001'."""
    def part(x) -> Column:
        return F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.concat(part(d1), num2code(part(d2), 2), num2code(part(d3), 3))


def split_code(code="digit") -> list[Column]:
    """Code back to its parts: [0], [1:3], [3:]."""
    c = _c(code)
    return [F.substring(c, 1, 1).alias("digit_1"),
            F.substring(c, 2, 2).alias("digit_2"),
            F.expr(f"substring({code}, 4)").alias("digit_3") if isinstance(code, str)
            else c.substr(F.lit(4), F.length(c)).alias("digit_3")]


def fill_text(df: DataFrame, cols: Sequence[str] = TEXT_COLS) -> DataFrame:
    """Nulls -> '' on the text columns and a text digit_1 (P3); numeric code
    parts stay null and count as empty in the code."""
    own = [c for c, t in df.dtypes if c == "digit_1" and t == "string"]
    return df.fillna("", subset=list(cols) + own)


def concat_text(cols: Sequence[str] = TEXT_COLS) -> Column:
    """Join the texts with one blank keeping empties (P4); call after P3."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def clean_texts(df: DataFrame, clean_fn: Callable[[Column], Column] | None,
                cols: Sequence[str] = TEXT_COLS) -> DataFrame:
    """Apply a Column -> Column cleaner to every text column."""
    if clean_fn is None:
        return df
    return df.withColumns({c: clean_fn(F.col(c)) for c in cols})


def any_text(cols: Sequence[str] = TEXT_COLS) -> Column:
    """At least one text non-empty (F1); null counts as empty."""
    cond = None
    for c in cols:
        e = F.coalesce(F.length(F.col(c)), F.lit(0)) > 0
        cond = e if cond is None else (cond | e)
    return cond


def default_clean(col: Column) -> Column:
    """Example cleaner: collapse white space and trim."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))
