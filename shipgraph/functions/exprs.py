"""Column-expression helpers: all JVM-side built-ins, no Python on the row path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with a zero denominator giving NULL (pandas replace(0, NaN))."""
    return num / F.nullif(den, F.lit(0.0))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Null-preserving clip (Spark's least/greatest skip NULLs, pandas keeps NaN)."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """A comparison where NULL counts as False (pandas NaN comparison)."""
    return F.coalesce(cond, F.lit(False))


def exact_mean(x: Column, scale: int = 10) -> Column:
    """Mean with an exact decimal sum: Σ as DECIMAL(38, scale), then one
    conversion to double and one division.  Means of short decimals (times,
    distances) often land exactly on a decimal tie; summing exactly makes the
    result independent of partitioning and summation order."""
    return F.sum(x.cast(T.DecimalType(38, scale))).cast("double") / F.count(x)


def rate(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; NULL counts as 0 like pandas."""
    return F.avg(flag(cond).cast("double"))


def hist_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """numpy.histogram bin of ``clip(x, lo, hi)``; the last bin is closed."""
    width = (hi - lo) / bins
    c = clip(x, lo, hi)
    return F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")


def entropy_terms(p: Column) -> Column:
    """One term of base-2 Shannon entropy with the reference's +1e-10 guard."""
    return p * F.log2(p + F.lit(1e-10))


def normalise_output(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Final projection for checked results: integers/booleans → BIGINT,
    floating → DOUBLE (rounded only when ``digits`` is given)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType,
                                   T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = c.cast("double") if digits is None else F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)
