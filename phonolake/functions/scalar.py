"""Scalar and aggregate building blocks. Undefined values are NULL, never NaN (but for `cents`)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def defined(x: Column) -> Column:
    """x with NaN as NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def db(x: Column, floor: float = -120.0) -> Column:
    """A power ratio in decibels, not under the floor."""
    return F.greatest(F.lit(10.0) * F.log10(F.greatest(x, F.lit(1e-12))), F.lit(floor))


def cents(a: Column, b: Column) -> Column:
    """1200 log2(a / b) as floating point has it, so that no row fails: infinite where one side is zero,
    NaN where both are or the signs differ."""
    # The inverse of zero is infinite, with zero's sign.
    r = F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))
    return F.lit(1200.0) * F.when(r < 0, F.lit(math.nan)).when(r == 0, F.lit(-math.inf)).otherwise(F.log2(r))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def pearson(a: Column, b: Column, least: int = 3) -> Column:
    """Correlation over pairs without NULL; NULL for fewer pairs or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when(F.count(x) >= least, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def frame_samples(rate: Column) -> Column:
    """Samples of a 25 ms frame, halves to even."""
    return F.greatest(F.lit(1), F.bround(rate * F.lit(0.025), 0).cast("int"))


def hop_samples(rate: Column) -> Column:
    """Samples of a 10 ms hop, halves to even."""
    return F.greatest(F.lit(1), F.bround(rate * F.lit(0.010), 0).cast("int"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive integers, by Euclid's steps: 64 are enough for longs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), F.pmod(acc["a"], F.greatest(acc["b"], F.lit(1).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda acc: acc["a"])


def formant_rate(rate: Column, ceiling: float) -> Column:
    """The rate at which formants are measured: twice the ceiling where an exact factor is cheap, else
    the nearest whole decimation at most 2 % above; lower rates stay."""
    target = round(2 * ceiling)
    up = F.lit(target) / gcd(rate, F.lit(target))
    down = F.greatest(F.lit(1.0), F.bround(rate / F.lit(2.0 * ceiling), 0), F.ceil(rate / F.lit(2.04 * ceiling)))
    return F.when(rate <= 2 * ceiling, rate).when(up <= 64, F.lit(target)).otherwise(F.floor(rate / down)).cast("int")


def frame_time(k: Column, hop: int, length: int, rate: float) -> Column:
    """Seconds of frame k's centre; odd lengths sit half a sample late."""
    return (k * F.lit(float(hop)) + F.lit(length / 2 - length // 2)) / F.lit(float(rate))


def hann(length: int) -> list[float]:
    """Symmetric raised cosine."""
    if length == 1:
        return [1.0]
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / (length - 1)) for i in range(length)]


def pre_emphasis(rate: float, corner: float = 50.0) -> float:
    return math.exp(-2 * math.pi * corner / rate)


def safe_name(path: Column, longest: int = 80) -> Column:
    """Last path part; characters that break headers become underscores."""
    base = F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)
    return F.substring(F.regexp_replace(base, r'[\r\n"]', "_"), 1, longest)


def storage_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def redacted_path(path: Column) -> Column:
    """Only the last part, after an ellipsis."""
    return F.concat(F.lit("…/"), F.substring_index(path, "/", -1))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that a generator makes, one row for each, so that the optimizer does not copy
    their expressions into each place that reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
