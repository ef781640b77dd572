"""Frames, filters and pools over sample tables (rec, i, x): one row a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.scalar import db, hann
from phonolake.operators.segments import runs


def samples(recordings: DataFrame, rec: str, array: str) -> DataFrame:
    """(rec, i, x) of arrays of samples, i from 0."""
    return recordings.select(F.col(rec).alias("rec"), F.posexplode(F.col(array)).alias("i", "x")).select("rec", "i", F.col("x").cast("double").alias("x"))


def padded(signal: DataFrame, n: int, pad: int) -> DataFrame:
    """signal of n samples with pad more at both ends, mirrored if it is longer than the pad, else
    zero; (rec, j, x) with j from 0. Each sample makes its own mirror images: no join."""
    i = F.col("i")
    if pad < n:
        places = F.array(i + pad, F.when((i >= 1) & (i <= pad), pad - i), F.when((i <= n - 2) & (i >= n - 1 - pad), 2 * (n - 1) + pad - i))
        return signal.select("rec", F.explode(F.array_compact(places)).alias("j"), "x")
    zeros = signal.select("rec").distinct().select("rec", F.explode(F.array(*[F.lit(j) for j in [*range(pad), *range(pad + n, n + 2 * pad)]])).alias("j"), F.lit(0.0).alias("x"))
    return signal.select("rec", (i + pad).alias("j"), "x").union(zeros) if pad else signal.select("rec", i.alias("j"), "x")


def framed(signal: DataFrame, n: int, length: int, hop: int, center: bool = True) -> DataFrame:
    """(rec, frame, o, x): every sample in every frame that holds it, o its place there. The frames
    of a sample follow from its index, so a generator takes the place of a range join."""
    pad = length // 2 if center else 0
    frames = 1 + (n + 2 * pad - length) // hop
    rows = padded(signal, n, pad) if center else signal.select("rec", F.col("i").alias("j"), "x")
    first = F.greatest(F.lit(0), F.ceil((F.col("j") - (length - 1)) / hop)).cast("int")
    last = F.least(F.lit(frames - 1), F.floor(F.col("j") / hop)).cast("int")
    held = F.when(first <= last, F.sequence(first, last))
    return rows.select("rec", "j", "x", F.explode(held).alias("frame")).select("rec", "frame", (F.col("j") - F.col("frame") * hop).alias("o"), "x")


def frame_power(frames: DataFrame) -> DataFrame:
    """(rec, frame, power): mean square plus the floor that keeps logarithms finite."""
    return frames.groupBy("rec", "frame").agg((F.avg(F.col("x") * F.col("x")) + F.lit(1e-12)).alias("power"))


def emphasized(signal: DataFrame, alpha: float) -> DataFrame:
    before = F.lag("x").over(Window.partitionBy("rec").orderBy("i"))
    return signal.withColumn("x", F.col("x") - F.coalesce(F.lit(alpha) * before, F.lit(0.0)))


def autocorrelation(arrays: DataFrame, rec: str, x: Column, lags: int, weights: list[float] | None = None) -> DataFrame:
    """(rec, lag, r) for lags 0 .. lags of each array, inside its row."""
    if weights is not None:
        x = F.zip_with(x, F.array(*[F.lit(w) for w in weights]), lambda a, w: a * w)
    rows = arrays.select(F.col(rec).alias("rec"), x.alias("x")).select("rec", "x", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    shifted = F.slice("x", F.col("lag") + 1, F.greatest(F.size("x") - F.col("lag"), F.lit(0)))
    products = F.zip_with(shifted, F.slice("x", F.lit(1), F.greatest(F.size("x") - F.col("lag"), F.lit(0))), lambda a, b: a * b)
    return rows.select("rec", "lag", F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v).alias("r"))


def _around(n: int) -> list[Column]:
    w = Window.partitionBy("rec").orderBy("i")
    return [F.lag("x", d).over(w) for d in range(n, -n - 1, -1)]


def smoothed3(signal: DataFrame) -> DataFrame:
    """Inner samples as the mean of three; the ends stay."""
    before, x, after = _around(1)
    return signal.withColumn("y", F.when(before.isNull() | after.isNull(), F.col("x")).otherwise((before + F.col("x") + after) / 3))


def median3(signal: DataFrame) -> DataFrame:
    """Median of three with zeros past the ends."""
    three = [F.coalesce(c, F.lit(0.0)) for c in _around(1)]
    return signal.withColumn("y", F.array_sort(F.array(*three))[1])


def hann_smoothed(signal: DataFrame, width: int) -> DataFrame:
    """Weighted mean over an odd width, zeros past the ends."""
    w = hann(width)
    total = sum(w)
    terms = [F.coalesce(c, F.lit(0.0)) * F.lit(v / total) for c, v in zip(_around(width // 2), w, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return signal.withColumn("y", out)


def pooled(signal: DataFrame, n: int, target: int) -> DataFrame:
    """(rec, block, x): means of whole blocks of ceil(n / target) samples; unchanged if n fits."""
    size = 1 if n <= target else -(-n // target)
    return signal.where(F.col("i") < n // size * size).groupBy("rec", F.floor(F.col("i") / size).alias("block")).agg(F.avg("x").alias("x"))


def strided(signal: DataFrame, n: int, target: int) -> DataFrame:
    return signal.where(F.col("i") % max(1, n // target) == 0)


def prominence(signal: DataFrame, look: int = 12) -> DataFrame:
    """(rec, i, x, prominence): how far x stands over the higher of the two valleys within reach."""
    w = Window.partitionBy("rec").orderBy("i")
    left, right = F.min("x").over(w.rowsBetween(-look, 0)), F.min("x").over(w.rowsBetween(0, look))
    held = F.count(F.lit(1)).over(w.rowsBetween(-look, look))
    p = F.when((held < 3) | (F.col("x") <= 0), F.lit(0.0)).otherwise((F.col("x") - F.greatest(left, right)) / F.col("x"))
    return signal.withColumn("prominence", p)


def power_spectrum(signal: DataFrame, n: int, bins: int) -> DataFrame:
    """(rec, bin, power) of the first bins of an n-point transform, by its definition."""
    angle = F.lit(-6.283185307179586 / n) * ((F.col("bin") * F.col("i")) % n)
    terms = signal.select("rec", "i", "x", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    parts = terms.groupBy("rec", "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return parts.select("rec", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def log_bands(spectrum: DataFrame, rate: float, n: int, bands: int = 20) -> DataFrame:
    """(rec, band, level) of power spectra (rec, bin, power) of n points: log amplitudes in triangular
    bands, geometric from 80 Hz to 6 kHz or just under half the rate."""
    top = min(6000.0, rate / 2 - 200.0)
    edge = [80.0 * (top / 80.0) ** (k / (bands + 1)) for k in range(bands + 2)]
    hz = [k * rate / n for k in range(n // 2 + 1)]
    share = lambda f, low, mid, high: max(0.0, min((f - low) / max(mid - low, 1e-9), (high - f) / max(high - mid, 1e-9)))
    rows = [(k, b, share(f, *edge[b : b + 3])) for k, f in enumerate(hz) for b in range(bands)]
    rows = [r for r in rows if r[2] > 0 or r[0] == 0]  # bin 0 stands for bands without any
    weights = spectrum.sparkSession.createDataFrame(rows, "__bin int, band int, __w double")
    joined = spectrum.join(F.broadcast(weights), F.col("bin") == F.col("__bin"))  # two rows a bin, and one a band
    energy = F.greatest(F.sum(F.col("power") * F.col("__w")), F.lit(1e-12))
    return joined.groupBy("rec", "band").agg(F.log(F.sqrt(energy) + F.lit(1e-10)).alias("level"))


def issues(recordings: DataFrame, signal: DataFrame) -> DataFrame:
    """(rec, issues): what is wrong with each of recordings (rec), by its samples in signal (rec, i, x)."""
    square = F.col("x") * F.col("x")
    found = signal.groupBy("rec").agg(db(F.max(square)).alias("peak"), F.percentile(db(square + F.lit(1e-12)), F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    full = runs(signal.withColumn("full", F.abs("x") >= 0.999), ["rec"], ["i"], "full").where("full AND n >= 3").groupBy("rec").agg(F.lit(True).alias("clipped"))
    whole = recordings.join(found, "rec", "left").join(full, "rec", "left")
    gap = F.col("q")[1] - F.col("q")[0]
    listed = F.array_compact(F.array(F.when(F.col("clipped"), "clipping"), F.when(F.col("peak") < -30, "too quiet"), F.when((gap >= 6) & (gap < 20), "low SNR")))
    return whole.select("rec", F.when(F.col("peak").isNull(), F.array(F.lit("empty file"))).otherwise(listed).alias("issues"))


def harmonicity(arrays: DataFrame, rec: str, x: Column, lag: int) -> DataFrame:
    """(rec, hnr_db) of one frame each: the normalised correlation at the lag as harmonics to noise.
    NULL where the frame is silent or the correlation is not positive."""
    rows = arrays.select(F.col(rec).alias("rec"), x.alias("raw"))
    mean = F.aggregate("raw", F.lit(0.0), lambda a, v: a + v) / F.size("raw")
    rows = rows.withColumn("mean", mean).select("rec", F.transform("raw", lambda v: v - F.col("mean")).alias("x"))
    kept = F.size("x") - lag
    head, tail = F.slice("x", F.lit(1), kept), F.slice("x", F.lit(lag + 1), kept)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    r = dot(head, tail) / F.greatest(F.sqrt(dot(head, head) * dot(tail, tail)), F.lit(1e-20))
    rows = rows.select("rec", dot(F.col("x"), F.col("x")).alias("energy"), r.alias("r"))
    capped = F.least("r", F.lit(0.999999))
    return rows.select("rec", F.when((F.col("energy") >= 1e-10) & (F.col("r") > 0), 10 * F.log10(capped / (1 - capped))).alias("hnr_db"))
