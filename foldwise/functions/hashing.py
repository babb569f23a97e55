"""Random-looking columns that depend only on a seed and a key.

MD5 is used so that any SQL engine gives the same numbers, and so that a task
that is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits are 52 bits, which a double holds exactly.
_DIGITS = 13
_SPAN = float(16**_DIGITS)


def order_key(seed: int, *parts: Column) -> Column:
    """Hex digest that puts rows into a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for each key."""
    head = F.substring(order_key(seed, *parts), 1, _DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(_SPAN)


def derived_seed(seed: int, *parts: Column) -> Column:
    """A seed in [0, 2^31) for each key, e.g. one per replicate."""
    head = F.substring(order_key(seed, *parts), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % F.lit(2**31)).cast("int")
