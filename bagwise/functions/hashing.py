"""Portable, seeded randomness.

A draw is a function of (seed, salt, keys...) only, computed from md5 so that
Spark and DuckDB give identical values:

* ``order_key``  -- md5 hex string of ``seed:salt:k1:k2...``; sorting by it
  (then by id) is a seeded shuffle.
* ``uniform``    -- first 13 hex digits (52 bits, exact in a double) / 2^52,
  in [0, 1).  Monotone in ``order_key``: u(a) < u(b) implies key(a) < key(b).
* ``draw_index`` -- 1 + floor(u * n), uniform on 1..n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hash_text(seed, salt: str, *keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(salt)] + [_c(k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def order_key(seed, salt: str, *keys) -> Column:
    return F.md5(hash_text(seed, salt, *keys))


def uniform_from_key(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def uniform(seed, salt: str, *keys) -> Column:
    return uniform_from_key(order_key(seed, salt, *keys))


def draw_index(u: Column, n: Column) -> Column:
    """Uniform integer in 1..n from u in [0,1)."""
    return (F.floor(u * n.cast("double")) + 1).cast("long")


def split_flag(seed, id_col, modulus: int = 10) -> Column:
    """Integer in 0..modulus-1 from 8 hex digits (used by the fixture split)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), _c(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % modulus
