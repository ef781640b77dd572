"""Runs, gaps and islands over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """rows with `island`, counted up wherever breaks holds; breaks may use lag over the same order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__new", F.when(breaks, 1).otherwise(0)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def islands(rows: DataFrame, by: list[str], at: str, gap: float, order: list[str], least: float) -> DataFrame:
    """Stretches of rows never more than gap apart and at least `least` long: by, start, end, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    split = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False))
    found = numbered_islands(rows, by, order, split).groupBy(*by, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("end") - F.col("start") >= least).drop("island")


def longest(segments: DataFrame, by: list[str]) -> DataFrame:
    """The longest segment of each group, the first of equals."""
    w = Window.partitionBy(*by).orderBy((F.col("end") - F.col("start")).desc(), "start")
    return segments.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def inside(rows: DataFrame, by: list[str], at: str, gap: float, order: list[str], least: float) -> DataFrame:
    """The rows that some stretch of `islands` holds. A row lies in its own stretch or in none, so
    stretches are measured where their rows stand, without a join."""
    w = Window.partitionBy(*by).orderBy(*order)
    split = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False))
    own = Window.partitionBy(*by, "island")
    numbered = numbered_islands(rows, by, order, split).withColumn("__long", F.max(at).over(own) - F.min(at).over(own) >= least)
    return numbered.where("__long").drop("__long", "island")


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: by, run, value, first and last row number, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(w))
    changed = ~F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(False))
    marked = numbered_islands(numbered, by, order, changed)
    return marked.groupBy(*by, F.col("island").alias("run")).agg(F.first(value).alias(value), F.min("__n").alias("first"), F.max("__n").alias("last"), F.count(F.lit(1)).alias("n"))


def inner_gaps(rows: DataFrame, by: list[str], order: list[str], flag: str, least: int) -> DataFrame:
    """Runs where flag is false, of at least `least` rows, with true rows on both sides."""
    w = Window.partitionBy(*by)
    sides = rows.withColumn("__n", F.row_number().over(w.orderBy(*order)))
    sides = sides.withColumn("__first", F.min(F.when(F.col(flag), F.col("__n"))).over(w)).withColumn("__last", F.max(F.when(F.col(flag), F.col("__n"))).over(w))
    between = sides.where((F.col("__n") > F.col("__first")) & (F.col("__n") < F.col("__last"))).drop("__first", "__last", "__n")
    return runs(between, by, order, flag).where(~F.col(flag) & (F.col("n") >= least))


def merged_turns(turns: DataFrame, by: list[str], order: str, least: float) -> DataFrame:
    """Turns (by, order, speaker, start, end) with those under `least` given to the turn before them and
    equal neighbours merged: by, turn (from 0), speaker, start, end. A short turn always goes to the
    last one that is not, so each pass is a running count and an aggregation."""
    w = Window.partitionBy(*by).orderBy(order)
    first, last = F.min_by("speaker", order).alias("speaker"), F.max_by("end", order).alias("end")

    def pass_(rows: DataFrame, new: Column) -> DataFrame:
        marked = rows.withColumn("__part", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "__part").agg(first, F.min("start").alias("start"), last, F.min(order).alias("__first")).drop("__part").withColumnRenamed("__first", order)

    head = F.lag("speaker").over(w)
    absorbed = pass_(turns.withColumn("__head", F.row_number().over(w) == 1), F.col("__head") | (F.col("end") - F.col("start") >= least))
    merged = pass_(absorbed.withColumn("__new", F.coalesce(head != F.col("speaker"), F.lit(True))), F.col("__new"))
    return merged.select(*by, (F.row_number().over(w) - 1).alias("turn"), "speaker", "start", "end")


def folded_turns(turns: Column, least: float) -> Column:
    """`merged_turns` over one array of (speaker, start, end): what begins a turn is marked, and what
    lies between two marks is one turn. A null speaker is one of its own."""
    size = F.size(turns)

    def parts(rows: Column, begins: Callable[[Column, Column], Column]) -> Column:
        marks = F.filter(F.transform(rows, lambda t, i: F.when((i == 0) | begins(t, i), i)), lambda i: i.isNotNull())
        stop = lambda k: F.coalesce(F.get(marks, k + 1), F.size(rows)) - 1
        return F.transform(marks, lambda i, k: F.struct(F.get(rows, i)["speaker"].alias("speaker"), F.get(rows, i)["start"].alias("start"), F.get(rows, stop(k))["end"].alias("end")))

    one = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  computed once
    absorbed = parts(turns, lambda t, i: t["end"] - t["start"] >= least)
    merged = one(absorbed, lambda rows: parts(rows, lambda t, i: ~t["speaker"].eqNullSafe(F.get(rows, i - 1)["speaker"])))
    return F.when(size > 0, merged).otherwise(F.slice(turns, 1, 0))


def spaced(times: Column, least: float) -> Column:
    """How many times of a sorted array a left-to-right walk accepts at `least` apart: it only has to
    remember the last one."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))
    step = lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= least), F.struct(t.cast("double").alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return F.aggregate(times, start, step, lambda acc: acc["n"])
