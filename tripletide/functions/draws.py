"""Pseudo-random draws that any engine can repeat: integer arithmetic on the identifiers of a row, so that a seed fixes a result on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime (2^31 - 1) below which all products fit 64 bits, and the coefficients of a round.
PRIME, A, B = 2_147_483_647, 48_271, 1_299_709


def _round(x: Column) -> Column:
    return F.pmod(x * (x + A) + B, F.lit(PRIME))


def draw(seed: int, *ids: str) -> Column:
    """A number from 0 to PRIME - 1 for integer columns; null where one of them is null."""
    x = F.lit(seed % PRIME).cast("bigint")
    for c in ids:
        x = _round(F.pmod(x + F.pmod(F.col(c).cast("bigint"), F.lit(PRIME)), F.lit(PRIME)))
    return _round(x)


def uniform(seed: int, *ids: str) -> Column:
    """`draw` as a share of 1, below 1."""
    return draw(seed, *ids) / float(PRIME)


def number(text: Column) -> Column:
    """A number below 2^32 for a text, by its digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_sql(seed: int, *ids: str) -> str:
    x = str(seed % PRIME)
    for c in ids:
        x = f"(({x} + {c}::BIGINT % {PRIME}) % {PRIME})"
        x = f"(({x} * ({x} + {A}) + {B}) % {PRIME})"
    return f"(({x} * ({x} + {A}) + {B}) % {PRIME})"


def uniform_sql(seed: int, *ids: str) -> str:
    return f"({draw_sql(seed, *ids)} / {PRIME}.0::DOUBLE)"


def number_sql(text: str) -> str:
    return f"('0x' || md5({text})[1:8])::BIGINT"
