"""Arithmetic used by every report, written so that any engine gives the same digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
WILSON_Z = 1.96
LAMPORTS_PER_COIN = 1_000_000_000
BASE_FEE = 5_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, digits: int = 6) -> Column:
    """Half-up rounding by floor; null, NaN, infinities and very large values stay as they are."""
    scale = float(10 ** digits)
    x = col(c).cast("double")
    return F.when(F.abs(x) < 1e11, F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(x)


def rounded_all(df, names, digits: int = 6):
    """The table with the named columns rounded."""
    return df.select(*[rounded(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def cents(c) -> Column:
    return F.floor(col(c) * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def ratio(num, den) -> Column:
    """num / den as double, null when the denominator is 0 or null."""
    d = col(den).cast("double")
    return F.when(d != 0, col(num).cast("double") / d)


def int_mean(total, n) -> Column:
    """Whole-number mean, 0 for an empty group."""
    return F.when(col(n) > 0, F.floor(col(total).cast("double") / col(n))).otherwise(F.lit(0)).cast("bigint")


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_if(cond: Column, value) -> Column:
    return F.coalesce(F.sum(F.when(cond, col(value))), F.lit(0))


def each(values, name: str = "value", kind: str = "double") -> Column:
    """A few literal values to one row each, next to the row at hand."""
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name)


def beside(df, one):
    """Put the columns of a one-row aggregate next to every row. Only for `agg` results without keys."""
    return df.crossJoin(F.broadcast(one))


def wilson_bounds(k, n, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval for k hits in n tries, null for n = 0."""
    hits, tries = col(k).cast("double"), col(n).cast("double")
    share = hits / tries
    z2 = z * z
    scale = 1 + z2 / tries
    centre = (share + z2 / (2 * tries)) / scale
    half = z * F.sqrt(share * (1 - share) / tries + z2 / (4 * tries * tries)) / scale
    ok = tries > 0
    return F.when(ok, centre - half), F.when(ok, centre + half)
