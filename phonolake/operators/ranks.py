"""Ranks, running sums and exact quantiles of groups too large for one task.

A group's rows fall into ranges of the leading sort column, cut at approximate
quantiles of the whole table, so a group of any size is dealt over about PARTS
tasks. What a range counts or sums to is a row for each group and range; their
running totals are the offsets that make what each range finds by itself exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the leading sort column is cut into.
PARTS = 64


def _cuts(rows: DataFrame, columns: list[str], parts: int) -> list[list[float]]:
    """For each numeric column the values that cut it into ranges."""
    found = rows.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).approxQuantile([f"v{i}" for i in range(len(columns))], [i / parts for i in range(1, parts)], 0.25 / parts)
    return [sorted(set(cuts)) for cuts in found]


def _range(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie under a value, by halving: it never falls as the value grows; null is in the
    first range, NaN in the last."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= F.lit(cuts[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(value.isNull(), 0).otherwise(among(0, len(cuts)))


def ranged(rows: DataFrame, column: str, parts: int = PARTS, out: str = "__range") -> DataFrame:
    """rows with the number of their range of the (numeric) column. Equal values share a range."""
    return rows.withColumn(out, _range(F.col(column), _cuts(rows, [column], parts)[0]))


def _offsets(ranges: DataFrame, by: list[str], value: Column, name: str, down: bool = False) -> DataFrame:
    """ranges (by, __range, ..) with the sum of value over the ranges before each, or after it."""
    order = F.col("__range").desc() if down else F.col("__range")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _joined(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "__range"]
    named = ranges.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in ranges.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return rows.join(named, on).drop(*[f"__of_{k}" for k in keys])


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of value over their group up to and with them, in the order given."""
    cut = ranged(rows, order[0])
    sums = _offsets(cut.groupBy(*by, "__range").agg(F.sum(value).alias("__sum")), by, F.col("__sum"), "__before").drop("__sum")
    w = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(value).over(w)
    # Without any value so far the sum is null.
    some = F.when(own.isNull() & (F.col("__before") == 0), F.lit(None)).otherwise(F.coalesce(own, F.lit(0)) + F.col("__before"))
    return _joined(cut, sums, by).withColumn(out, some).drop("__range", "__before")


def upper_half(rows: DataFrame, by: list[str], value: str, tie: list[str], least: int = 5) -> DataFrame:
    """The upper half of each group by value, ties by the later tie columns, `least` rows at least if it
    has them. Only the range that the limit falls into is ranked."""
    cut = ranged(rows, value)
    counts = _offsets(cut.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n")), by, F.col("__n"), "__above", down=True)
    total = F.sum("__n").over(Window.partitionBy(*by))
    counts = counts.withColumn("__limit", F.greatest(F.lit(least).cast("long"), F.floor(total / 2))).where("__above < __limit")
    near = _joined(cut, counts, by)
    inside = F.col("__above") + F.col("__n") <= F.col("__limit")
    helpers = ["__range", "__n", "__above", "__limit"]
    w = Window.partitionBy(*by, "__range").orderBy(F.col(value).desc(), *[F.col(t).desc() for t in tie])
    edge = near.where(~inside).withColumn("__rank", F.row_number().over(w)).where(F.col("__above") + F.col("__rank") <= F.col("__limit"))
    return near.where(inside).drop(*helpers).unionByName(edge.drop("__rank", *helpers))


def quantiles(rows: DataFrame, by: list[str], values: list[str], shares: list[float], out: str, like: DataFrame | None = None) -> DataFrame:
    """(by, out): for each group the exact quantiles, interpolated, of each column's values that are not
    null, as an array of arrays; null where there is no value. Only rows of ranges that hold a wanted rank
    are ranked. The ranges are cut by `like`, a table with those columns that is cheaper to read than
    rows; it only has to spread alike."""
    own = [F.struct(F.lit(i).alias("__m"), F.col(v).cast("double").alias("__v"), _range(F.col(v), cuts).alias("__range")) for i, (v, cuts) in enumerate(zip(values, _cuts(rows if like is None else like, values, PARTS), strict=True))]
    cut = rows.select(*by, F.inline(F.array(*own))).where("__v IS NOT NULL")
    keys = [*by, "__m"]
    counts = _offsets(cut.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n")), keys, F.col("__n"), "__below")
    total = F.sum("__n").over(Window.partitionBy(*keys))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("__total") - 1) * s), F.ceil((F.col("__total") - 1) * s)) for s in shares])))
    held = F.filter(wanted, lambda r: (r >= F.col("__below")) & (r < F.col("__below") + F.col("__n")))
    counts = counts.withColumn("__total", total).withColumn("__ranks", held).where(F.size("__ranks") > 0)
    w = Window.partitionBy(*keys, "__range").orderBy("__v")
    ranked = _joined(cut, counts, keys).withColumn("__rank", F.col("__below") + F.row_number().over(w) - 1).where(F.array_contains("__ranks", F.col("__rank")))
    found = ranked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"), F.first("__total").alias("__total"))
    place = [(F.col("__total") - 1) * F.lit(s) for s in shares]
    low, high = [[F.element_at("__at", f(p)) for p in place] for f in (F.floor, F.ceil)]
    each = F.array(*[a + (b - a) * (p - F.floor(p)) for a, b, p in zip(low, high, place, strict=True)])
    every = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__m", each))).alias("__q"))
    return every.select(*by, F.array(*[F.element_at("__q", F.lit(i)) for i in range(len(values))]).alias(out))
