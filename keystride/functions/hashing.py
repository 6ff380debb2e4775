"""Ring positions and repeatable pseudo-random numbers, both taken from MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_position(key: Column) -> Column:
    """First eight bytes of the key's MD5, big-endian, as a signed 64-bit integer; 0 for null.

    Never null, so that no join on it makes Spark hash every row once more for a null filter.
    """
    return F.coalesce(F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("bigint"), F.lit(0).cast("bigint"))


def hashed_below(bound: Column | int, *parts: Column | str) -> Column:
    """Integer in ``[0, bound)`` that depends only on ``parts``.

    Unlike a random generator it gives the same value when a lost task runs again.
    """
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    drawn = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 13), 16, 10).cast("bigint")
    drawn = F.coalesce(drawn, F.lit(0).cast("bigint"))
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return F.pmod(drawn, bound.cast("bigint"))
