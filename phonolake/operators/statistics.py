"""Summaries, agreement and comparison over tables of measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.scalar import pearson, ratio
from phonolake.operators import ranks

#: Screening ranges (metric, band, low, high, note). Fixed values.
NORMS = (
    ("f0_hz", "men", 85.0, 180.0, "everyday speech"),
    ("f0_hz", "women", 165.0, 255.0, "everyday speech"),
    ("f0_hz", "children", 250.0, 350.0, "everyday speech"),
    ("jitter_percent", "typical", 0.0, 1.0, "held vowels"),
    ("jitter_percent", "borderline", 1.0, 1.5, "held vowels"),
    ("shimmer_db", "typical", 0.0, 0.35, "held vowels"),
    ("shimmer_db", "borderline", 0.35, 0.7, "held vowels"),
    ("hnr_db", "typical", 20.0, 45.0, "held vowels"),
    ("hnr_db", "borderline", 15.0, 20.0, "held vowels"),
    ("snr_db", "typical", 30.0, 60.0, "what a recording should reach"),
)


def norms(spark) -> DataFrame:
    return spark.createDataFrame(list(NORMS), "metric string, band string, lo double, hi double, note string")


def reference_ranges(table: DataFrame, metric: str = "") -> DataFrame:
    """The norms of the first metric whose leading word the query holds, or that holds the query; all for no query."""
    if not metric:
        return table
    key = metric.lower().replace(" ", "_")
    order = {m: i for i, m in enumerate(dict.fromkeys(n[0] for n in NORMS))}
    fits = F.lit(key).contains(F.substring_index("metric", "_", 1)) | F.col("metric").contains(key)
    place = F.coalesce(*[F.when(F.col("metric") == m, F.lit(i)) for m, i in order.items()], F.lit(len(order)))
    ranked = table.where(fits).withColumn("__place", place)
    return ranked.withColumn("__first", F.min("__place").over(Window.partitionBy())).where("__place = __first").drop("__place", "__first")


def graded(values: DataFrame, table: DataFrame, metric: str, value: str) -> DataFrame:
    """values (with metric and value columns) and the band they fall in, `out` if none; where bands
    touch, typical comes before borderline. Each metric's bands are one row, so no row multiplies."""
    band = F.struct((F.col("band") != "typical").alias("late"), "band", "lo", "hi")
    bands = table.groupBy(F.col("metric").alias("__m")).agg(F.array_sort(F.collect_list(band)).alias("__bands"))
    joined = values.join(F.broadcast(bands), F.col(metric) == F.col("__m"), "left")  # a row for each of a handful of metrics
    hit = F.filter("__bands", lambda b: F.col(value).between(b["lo"], b["hi"]))
    return joined.select(*values.columns, F.coalesce(F.get(hit, F.lit(0))["band"], F.lit("out")).alias("grade"))


def pitch_summary(frames: DataFrame, by: list[str], f0: str, voiced: Column) -> DataFrame:
    """Voicing and the voiced frames' pitch: mean, median, population deviation and range."""
    v = F.when(voiced, F.col(f0))
    whole = frames.groupBy(*by).agg(
        (F.count(v) / F.count(F.lit(1))).alias("voiced_ratio"),
        F.count(v).alias("n_voiced_frames"),
        F.avg(v).alias("f0_mean_hz"),
        F.stddev_pop(v).alias("f0_std_hz"),
        F.min(v).alias("f0_min_hz"),
        F.max(v).alias("f0_max_hz"),
    )
    middle = ranks.quantiles(frames.where(voiced).select(*by, F.col(f0).alias("__f0")), by, ["__f0"], [0.5], "__q", frames.select(F.col(f0).alias("__f0")))
    joined = _beside(whole, middle, by).withColumn("f0_median_hz", F.get(F.get("__q", F.lit(0)), F.lit(0)))
    return joined.select(*by, "voiced_ratio", "n_voiced_frames", "f0_mean_hz", "f0_median_hz", "f0_std_hz", "f0_min_hz", "f0_max_hz")


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the columns of b for the same group, nulls equal; both have a row for each group."""
    named = b.select(*[F.col(k).alias(f"__b_{k}") for k in by], *[c for c in b.columns if c not in by])
    return a.join(named, [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in by], "left").drop(*[f"__b_{k}" for k in by])


def energetic_half(frames: DataFrame, by: list[str], energy: str, tie: list[str], bounded: bool = False) -> DataFrame:
    """The most energetic half of a group's frames, five at least if it has them. Groups that are known
    to fit a task, as one recording's frames do, are ranked there in one pass over frames."""
    if not bounded:
        return ranks.upper_half(frames, by, energy, tie)
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.col(energy).desc(), *[F.col(t).desc() for t in tie]))
    ranked = frames.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__place", place)
    return ranked.where(F.col("__place") <= F.greatest(F.lit(5), F.floor(F.col("__n") / 2))).drop("__n", "__place")


def formant_summary(frames: DataFrame, by: list[str], names: list[str], like: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Median and quartile distance of each formant over frames that have all, and its confidence:
    how often it was found, times how little it scatters. For like see `ranks.quantiles`, for bounded
    `energetic_half`."""
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    found = [F.avg(F.col(n).isNotNull().cast("int")).alias(f"__c_{n}") for n in names]
    shares = [0.25, 0.5, 0.75]
    if bounded:
        own = F.array(*[F.percentile(F.when(full, F.col(n)), F.array(*[F.lit(x) for x in shares])) for n in names])
        out = frames.groupBy(*by).agg(F.sum(full.cast("long")).alias("n_frames"), *found, own.alias("__q"))
    else:
        out = frames.groupBy(*by).agg(F.sum(full.cast("long")).alias("n_frames"), *found)
        out = _beside(out, ranks.quantiles(frames.where(full).select(*by, *names), by, names, shares, "__q", like), by)
    cols = [*by, "n_frames"]
    for k, n in enumerate(names):
        q = F.col("__q")[k]
        iqr = q[2] - q[0]
        stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - iqr / (0.2 * F.greatest(q[1], F.lit(1.0)))))
        cols += [q[1].alias(f"{n}_hz"), iqr.alias(f"{n}_iqr_hz"), (F.col(f"__c_{n}") * stable).alias(f"{n}_confidence")]
    return out.where("n_frames > 0").select(*cols)


def jitter(periods: DataFrame, by: list[str], order: list[str], period: str, factor: float = 1.3) -> DataFrame:
    """Mean step between neighbouring periods within the factor, in percent of the mean period."""
    before = F.lag(period).over(Window.partitionBy(*by).orderBy(*order))
    rows = periods.withColumn("__before", before)
    p, q = F.col(period), F.col("__before")
    stable = F.greatest(ratio(p, q), ratio(q, p)) <= factor
    step = F.avg(F.when(stable, F.abs(p - q)))
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 2, 100 * ratio(step, F.avg(p))).alias("jitter_local_percent"), F.count(F.lit(1)).alias("n_periods"))


def shimmer(periods: DataFrame, by: list[str], order: list[str], amp: str, factor: float | None = 1.6) -> DataFrame:
    """Mean size of the decibel steps between neighbouring amplitudes within the factor."""
    rows = periods.withColumn("__before", F.lag(amp).over(Window.partitionBy(*by).orderBy(*order)))
    r = F.when(F.abs("__before") >= 1e-12, F.col(amp) / F.col("__before"))
    kept = r > 0
    if factor is not None:
        kept = kept & (F.greatest(r, ratio(F.lit(1.0), r)) <= factor)
    return rows.groupBy(*by).agg(F.avg(F.when(kept, F.abs(20 * F.log10(r)))).alias("shimmer_local_db"))


def agreement(pairs: DataFrame, by: list[str], a: Column, b: Column, least: int = 3) -> DataFrame:
    """Bias, its sample deviation, limits of agreement, mean error and correlation of a against b."""
    d = a - b
    grouped = pairs.groupBy(*by) if by else pairs.groupBy()
    return grouped.agg(*agreement_columns(a, b, d, least))


def agreement_columns(a: Column, b: Column, d: Column, least: int = 3) -> list[Column]:
    n = F.count(d)
    enough = lambda c: F.when(n >= least, c)
    return [
        n.alias("n"),
        enough(F.avg(F.abs(d))).alias("mae"),
        pearson(a, b, least).alias("r"),
        enough(F.avg(d)).alias("bias"),
        enough(F.stddev_samp(d)).alias("sd"),
        enough(F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_low"),
        enough(F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_high"),
    ]


#: Groups that `welch` pairs at most: half a million pairs.
MOST_GROUPS = 1000


def welch(groups: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """Every pair of groups: t, Welch-Satterthwaite degrees of freedom, sizes and the effect size by
    medians. The groups are summed up before they are paired. The result has a row for every pair, so
    more than MOST_GROUPS groups are refused rather than paired."""
    if groups.select(key).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"{key} has more than {MOST_GROUPS} groups to pair")
    s = groups.groupBy(F.col(key).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.median(value).alias("med"), F.stddev_pop(value).alias("sd")).where(F.col("n") >= least)
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, F.col("a.g") < F.col("b.g"))
    wa, wb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    pooled = F.sqrt((F.col("a.sd") * F.col("a.sd") + F.col("b.sd") * F.col("b.sd")) / 2)
    return pairs.select(
        F.col("a.g").alias("group_a"),
        F.col("b.g").alias("group_b"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
        ratio(F.col("a.m") - F.col("b.m"), F.sqrt(wa + wb)).alias("t"),
        ratio((wa + wb) * (wa + wb), wa * wa / (F.col("a.n") - 1) + wb * wb / (F.col("b.n") - 1)).alias("df"),
        F.when(pooled > 1e-9, (F.col("b.med") - F.col("a.med")) / pooled).alias("effect"),
    )


def metric_differences(a: DataFrame, b: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Two one-row reports side by side: metrics both have, their values, difference and unit."""
    long = lambda df, name: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", name)).where(F.col(name).isNotNull())
    unit = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])
    joined = long(a, "a").join(long(b, "b"), "metric")
    return joined.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("diff_b_minus_a"), unit[F.col("metric")].alias("unit"))


def nearest(a: DataFrame, b: DataFrame, by: list[str], at: str, within: float, tie: str | None = None) -> DataFrame:
    """Each row of a with the row of b nearest in time, not further than `within`; the later one of
    two as near. Times fall into buckets as wide as the tolerance, and b's rows stand in three, so the
    join is by equality. Equal rows of a are matched once and come back as often as they stand there.
    Where Python makes the rows, Spark takes them for few; so the join is by merging, whatever it thinks."""
    width = F.lit(within)
    left = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__bucket", F.floor(F.col(at) / width))
    right = b.select(F.struct(*[F.col(c).alias(f"b_{c}") for c in b.columns]).alias("__b"), F.explode(F.array(*[F.floor(F.col(at) / width) + k for k in (-1, 0, 1)])).alias("__b_bucket"))
    other = lambda c: F.col("__b")[f"b_{c}"]
    apart = F.abs(other(at) - F.col(at))
    joined = left.join(right.hint("merge"), [F.col(c) == other(c) for c in by] + [F.col("__bucket") == F.col("__b_bucket"), apart <= within])
    best = F.struct(-apart, other(at), *([other(tie)] if tie else []))
    found = joined.groupBy(*a.columns, "__copies").agg(F.max_by("__b", best).alias("__b"))
    again = found.select(*a.columns, "__b", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__copy"))
    return again.select(*a.columns, "__b.*")


def condition(name: Column) -> Column:
    """The recording condition that a file name tells."""
    snr = F.regexp_extract(name, r"snr(\d+)db", 1)
    return F.when(name.contains("44k"), "44.1 kHz").when(name.contains("22k"), "22.05 kHz").when(snr != "", F.concat(snr, F.lit(" dB SNR"))).otherwise("clean 16 kHz")
