"""The engine's relational queries, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolake.functions import scalar
from phonolake.operators import segments, signal, statistics, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """df with those columns rounded, as the SQL twins are."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 64-sample signals (rec, i, x)."""
    return signal.samples(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, whole microseconds."""
    return _table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


_UNNEST = "v AS (SELECT vec_id AS rec, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_TONE = "SELECT CAST(range AS INT) AS i, {} AS x FROM range({})"
#: Mirrored frames of 400 samples every 160 of a signal s(i, x) of n samples.
_FRAMES = """p AS (
  SELECT i + 200 AS j, x FROM s UNION ALL SELECT 200 - i, x FROM s WHERE i BETWEEN 1 AND 200
  UNION ALL SELECT 2 * ({n} - 1) + 200 - i, x FROM s WHERE i BETWEEN {n} - 201 AND {n} - 2
), f AS (
  SELECT CAST(k AS INT) AS frame_idx, avg(x * x) + 1e-12 AS power
  FROM p JOIN (SELECT unnest(range({n} // 160 + 1)) AS k) ON j BETWEEN k * 160 AND k * 160 + 399 GROUP BY k
)"""
_DB = "greatest(10 * log10(greatest({}, 1e-12)), -120)"


def _tone(spark: SparkSession, n: int, x) -> DataFrame:
    return spark.range(n).select(F.lit(0).alias("rec"), F.col("id").cast("int").alias("i")).select("rec", "i", x.alias("x"))


def _sine(amplitude: float, hz: float) -> "F.Column":
    return F.lit(amplitude) * F.sin(F.lit(6.283185307179586 * hz / 16000) * F.col("i"))


_BURST = "CASE WHEN (i // 4000) % 3 < 2 THEN 0.5::DOUBLE * sin(6.283185307179586::DOUBLE * 150 / 16000 * i) ELSE 0.0001::DOUBLE * sin(6.283185307179586::DOUBLE * 50 / 16000 * i) END"


def _bursts(spark: SparkSession) -> DataFrame:
    loud = F.floor(F.col("i") / 4000) % 3 < 2
    return _tone(spark, 48000, F.when(loud, _sine(0.5, 150.0)).otherwise(_sine(0.0001, 50.0)))


@query(
    "WITH s AS (SELECT i, 0.5::DOUBLE * sin(6.283185307179586::DOUBLE * 200 / 16000 * i) AS x FROM (SELECT CAST(range AS INT) AS i FROM range(16000))), "
    + _FRAMES.format(n=16000)
    + f" SELECT frame_idx, round(frame_idx * 160 / 16000.0::DOUBLE, 6) AS t_s, round(sqrt(power), 6) AS rms, round({_DB.format('power')}, 6) AS rms_db FROM f"
)
def tone_frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred frames of a 200 Hz tone, their level and time."""
    power = signal.frame_power(signal.framed(_tone(spark, 16000, _sine(0.5, 200.0)), 16000, 400, 160))
    out = power.select(F.col("frame").alias("frame_idx"), scalar.frame_time(F.col("frame"), 160, 400, 16000).alias("t_s"), F.sqrt("power").alias("rms"), scalar.db(F.col("power")).alias("rms_db"))
    return _r(out, "t_s", "rms", "rms_db")


def _gated(spark: SparkSession) -> DataFrame:
    power = signal.frame_power(signal.framed(_bursts(spark), 48000, 400, 160)).withColumn("db", scalar.db(F.col("power")))
    return power.withColumn("speech", F.col("db") > F.max("db").over(Window.partitionBy("rec")) - 32)


_GATE = f"WITH s AS (SELECT i, {_BURST} AS x FROM (SELECT CAST(range AS INT) AS i FROM range(48000))), " + _FRAMES.format(n=48000) + f", g AS (SELECT frame_idx, {_DB.format('power')} AS db FROM f), h AS (SELECT *, db > (SELECT max(db) FROM g) - 32 AS speech FROM g)"


@query(_GATE + " SELECT frame_idx, round(db, 6) AS db, speech FROM h")
def frame_speech_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: frames within 32 dB of the loudest."""
    return _r(_gated(spark).select(F.col("frame").alias("frame_idx"), "db", "speech"), "db")


@query(
    _GATE
    + """, b AS (SELECT *, max(CASE WHEN speech THEN frame_idx END) OVER () AS hi, min(CASE WHEN speech THEN frame_idx END) OVER () AS lo FROM h),
n AS (SELECT frame_idx, speech, frame_idx - row_number() OVER (PARTITION BY speech ORDER BY frame_idx) AS grp FROM b WHERE frame_idx > lo AND frame_idx < hi),
r AS (SELECT count(*) AS n FROM n WHERE NOT speech GROUP BY grp HAVING count(*) >= 20),
c AS (SELECT sum(CAST(speech AS INT)) AS sf, count(*) AS fr FROM h)
SELECT round(sf * 0.01::DOUBLE, 6) AS speech_s, round(1 - sf / fr::DOUBLE, 6) AS silence_ratio, (SELECT count(*) FROM r) AS n_pauses,
 round((SELECT sum(n) * 0.01::DOUBLE FROM r), 6) AS pause_total_s, round((SELECT max(n) * 0.01::DOUBLE FROM r), 6) AS pause_max_s FROM c"""
)
def pause_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, Q8: silences of 0.2 s or more between speech, and the share of silence."""
    g = _gated(spark)
    gaps = segments.inner_gaps(g, ["rec"], ["frame"], "speech", 20).groupBy("rec").agg(F.count(F.lit(1)).alias("n_pauses"), F.sum("n").alias("n"), F.max("n").alias("m"))
    total = g.groupBy("rec").agg(F.sum(F.col("speech").cast("int")).alias("sf"), F.count(F.lit(1)).alias("fr")).join(gaps, "rec", "left")
    out = total.select((F.col("sf") * 0.01).alias("speech_s"), (1 - F.col("sf") / F.col("fr")).alias("silence_ratio"), F.coalesce("n_pauses", F.lit(0)).cast("long").alias("n_pauses"), (F.col("n") * 0.01).alias("pause_total_s"), (F.col("m") * 0.01).alias("pause_max_s"))
    return _r(out, "speech_s", "silence_ratio", "pause_total_s", "pause_max_s")


@query(
    _GATE
    + f""", q AS (SELECT quantile_cont(db, 0.1) AS lo, quantile_cont(db, 0.9) AS hi FROM g), k AS (SELECT {_DB.format('max(abs(x)) * max(abs(x))')} AS peak FROM s)
SELECT round(peak, 4) AS peak_dbfs, round(CASE WHEN hi - lo >= 6 THEN hi - lo END, 4) AS snr_db,
 concat_ws('; ', CASE WHEN peak < -30 THEN 'too quiet' END, CASE WHEN hi - lo >= 6 AND hi - lo < 20 THEN 'low SNR' END) AS issues FROM q, k"""
)
def snr_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q3, Q4, C14: peak level, percentile signal-to-noise, and issues joined for a report."""
    q = _gated(spark).groupBy("rec").agg(F.percentile("db", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    peak = _bursts(spark).groupBy("rec").agg(scalar.db(F.max(F.abs("x")) * F.max(F.abs("x"))).alias("peak_dbfs"))
    both = q.join(peak, "rec").withColumn("gap", F.col("q")[1] - F.col("q")[0]).withColumn("snr_db", F.when(F.col("gap") >= 6, F.col("gap")))
    issues = F.concat_ws("; ", F.when(F.col("peak_dbfs") < -30, "too quiet"), F.when(F.col("snr_db") < 20, "low SNR"))
    return _r(both.select("peak_dbfs", "snr_db", issues.alias("issues")), "peak_dbfs", "snr_db", places=4)


@query(
    f"WITH {_UNNEST}, s AS (SELECT rec, i, least(1, greatest(-1, x * CASE rec % 4 WHEN 0 THEN 20 WHEN 1 THEN 1 WHEN 2 THEN 0.01::DOUBLE ELSE 400 END)) AS x FROM v WHERE rec % 50 <> 7), "
    f"q AS (SELECT rec, {_DB.format('max(x * x)')} AS peak, quantile_cont({_DB.format('x * x + 1e-12')}, 0.9) - quantile_cont({_DB.format('x * x + 1e-12')}, 0.1) AS gap FROM s GROUP BY rec), "
    "c AS (SELECT rec, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM s WHERE abs(x) >= 0.999::DOUBLE), k AS (SELECT DISTINCT rec FROM (SELECT rec, g FROM c GROUP BY rec, g HAVING count(*) >= 3)) "
    "SELECT vec_id AS rec, CASE WHEN q.rec IS NULL THEN 'empty file' ELSE concat_ws('; ', CASE WHEN k.rec IS NOT NULL THEN 'clipping' END, CASE WHEN peak < -30 THEN 'too quiet' END, CASE WHEN gap >= 6 AND gap < 20 THEN 'low SNR' END) END AS issues "
    "FROM embeddings LEFT JOIN q ON q.rec = vec_id LEFT JOIN k ON k.rec = vec_id"
)
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 to Q4, C14: every issue of every array as a recording, louder and quieter, some without samples."""
    gain = F.when(F.col("rec") % 4 == 0, 20.0).when(F.col("rec") % 4 == 1, 1.0).when(F.col("rec") % 4 == 2, 0.01).otherwise(400.0)
    s = _vectors(spark, sf_dir).where("rec % 50 <> 7").withColumn("x", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("x") * gain)))
    found = signal.issues(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec")), s)
    return found.select("rec", F.concat_ws("; ", "issues").alias("issues"))


_CLIP = "least(1, greatest(-1, 1.3::DOUBLE * sin(6.283185307179586::DOUBLE * 100 / 16000 * i)))"


@query(
    f"WITH s AS (SELECT i, {_CLIP} AS x FROM (SELECT CAST(range AS INT) AS i FROM range(16000))), "
    "c AS (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM s WHERE abs(x) >= 0.999::DOUBLE), "
    "r AS (SELECT count(*) AS n FROM c GROUP BY g HAVING count(*) >= 3) "
    "SELECT count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS clipped, round(sum(n) / 16000::DOUBLE, 6) AS clipping_ratio FROM r"
)
def clip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: runs of three samples or more at full scale."""
    s = _tone(spark, 16000, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.lit(1.3) * F.sin(F.lit(6.283185307179586 * 100 / 16000) * F.col("i")))))
    r = segments.runs(s.withColumn("full", F.abs("x") >= 0.999), ["rec"], ["i"], "full").where("full AND n >= 3")
    return _r(r.agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("clipped"), (F.sum("n") / F.lit(16000.0)).alias("clipping_ratio")), "clipping_ratio")


@query(f"WITH {_UNNEST} SELECT rec, i, round(x - coalesce(exp(-2 * pi() * 50 / 16000) * lag(x) OVER (PARTITION BY rec ORDER BY i), 0), 6) AS x FROM v")
def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First difference with a 50 Hz corner."""
    return _r(signal.emphasized(_vectors(spark, sf_dir), scalar.pre_emphasis(16000)), "x")


@query(f"WITH {_UNNEST}, l AS (SELECT unnest(range(11)) AS lag) SELECT a.rec, CAST(lag AS INT) AS lag, round(sum(a.x * b.x), 5) + 0.0::DOUBLE AS r FROM l JOIN v a ON true JOIN v b ON a.rec = b.rec AND a.i = b.i + lag GROUP BY a.rec, lag")
def autocorr_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation at the first lags, inside each array."""
    e = _table(spark, sf_dir, "embeddings")
    return _r(signal.autocorrelation(e, "vec_id", F.col("embedding").cast("array<double>"), 10), "r", places=5)


@query(
    f"WITH {_UNNEST}, w AS (SELECT rec, i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63)) AS x FROM v), l AS (SELECT unnest(range(11)) AS lag), "
    "r AS (SELECT a.rec, lag, sum(a.x * b.x) AS r FROM l JOIN w a ON true JOIN w b ON a.rec = b.rec AND a.i = b.i + lag GROUP BY a.rec, lag) "
    "SELECT r.rec, CAST(lag AS INT) AS lag, round(r.r / z.r, 5) + 0.0::DOUBLE AS nccf FROM r JOIN (SELECT rec, r FROM r WHERE lag = 0) z USING (rec)"
)
def windowed_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a raised cosine, relative to lag 0."""
    r = signal.autocorrelation(_table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"), 10, scalar.hann(64))
    zero = F.max(F.when(F.col("lag") == 0, F.col("r"))).over(Window.partitionBy("rec"))
    return _r(r.select("rec", "lag", scalar.ratio(F.col("r"), zero).alias("nccf")), "nccf", places=5)


@query(f"WITH {_UNNEST} SELECT rec, i, round(CASE WHEN i IN (0, 63) THEN x ELSE avg(x) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) AS y FROM v")
def smooth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three, ends unchanged."""
    return _r(signal.smoothed3(_vectors(spark, sf_dir)).select("rec", "i", "y"), "y")


@query(
    f"WITH {_UNNEST}, n AS (SELECT rec, i, x, coalesce(lag(x) OVER w, 0) AS a, coalesce(lead(x) OVER w, 0) AS b FROM v WINDOW w AS (PARTITION BY rec ORDER BY i)) "
    "SELECT rec, i, round(a + b + x - greatest(a, b, x) - least(a, b, x), 6) AS y FROM n"
)
def medfilt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of three, zeros past the ends."""
    return _r(signal.median3(_vectors(spark, sf_dir)).select("rec", "i", "y"), "y")


@query(
    f"WITH {_UNNEST}, w AS (SELECT d, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (d + 2) / 4)) / 2 AS k FROM (SELECT unnest(range(-2, 3)) AS d)) "
    "SELECT a.rec, a.i, round(sum(b.x * k), 6) AS y FROM v a JOIN w ON true JOIN v b ON b.rec = a.rec AND b.i = a.i + d GROUP BY a.rec, a.i"
)
def hann_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: weighted mean over five."""
    return _r(signal.hann_smoothed(_vectors(spark, sf_dir), 5).select("rec", "i", "y"), "y")


@query(f"WITH {_UNNEST} SELECT rec, CAST(i // 4 AS BIGINT) AS block, round(avg(x), 6) AS x FROM v WHERE i < 64 GROUP BY rec, i // 4")
def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values pooled to at most 20 blocks."""
    return _r(signal.pooled(_vectors(spark, sf_dir), 64, 20), "x")


@query(f"WITH {_UNNEST} SELECT rec, i, round(x, 6) AS x FROM v WHERE i % 3 = 0")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third of 64 for a target of 20."""
    return _r(signal.strided(_vectors(spark, sf_dir), 64, 20), "x")


@query(
    f"WITH {_UNNEST}, m AS (SELECT rec, i, x, min(x) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS l, min(x) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS r FROM v) "
    "SELECT rec, i, round(CASE WHEN x <= 0 THEN 0 ELSE (x - greatest(l, r)) / x END, 4) AS prominence FROM m"
)
def peak_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height over the higher valley on either side."""
    return _r(signal.prominence(_vectors(spark, sf_dir)).select("rec", "i", "prominence"), "prominence", places=4)


@query(
    f"WITH {_UNNEST}, b AS (SELECT unnest(range(33)) AS bin), t AS (SELECT rec, bin, sum(x * cos(-2 * pi() / 64 * ((bin * i) % 64))) AS re, sum(x * sin(-2 * pi() / 64 * ((bin * i) % 64))) AS im FROM v, b GROUP BY rec, bin) "
    "SELECT rec, CAST(bin AS INT) AS bin, round(re * re + im * im, 5) AS power FROM t"
)
def spectrum_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: power spectrum of each array."""
    return _r(signal.power_spectrum(_vectors(spark, sf_dir), 64, 33), "power", places=5)


_SPECTRUM = "b AS (SELECT unnest(range(33)) AS bin), t AS (SELECT rec, bin, sum(x * cos(-2 * pi() / 64 * ((bin * i) % 64))) AS re, sum(x * sin(-2 * pi() / 64 * ((bin * i) % 64))) AS im FROM {}, b GROUP BY rec, bin), s AS (SELECT rec, bin, re * re + im * im AS power FROM t)"


@query(f"WITH {_UNNEST}, {_SPECTRUM.format('v')} SELECT rec, CAST(bin // 2 AS BIGINT) AS block, round(avg({_DB.format('power')}), 4) AS level_db FROM s WHERE bin < 32 GROUP BY rec, bin // 2")
def spectrum_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: levels of the spectrum, pooled to at most 20 blocks."""
    s = signal.power_spectrum(_vectors(spark, sf_dir), 64, 33).select("rec", F.col("bin").alias("i"), scalar.db(F.col("power")).alias("x"))
    return _r(signal.pooled(s, 33, 20).withColumnRenamed("x", "level_db"), "level_db", places=4)


@query(
    f"WITH {_UNNEST}, w AS (SELECT rec, i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63)) AS x FROM v), {_SPECTRUM.format('w')}, "
    "e AS (SELECT k AS band, 80 * power(1080 / 80.0::DOUBLE, k / 21.0::DOUBLE) AS low, 80 * power(1080 / 80.0::DOUBLE, (k + 1) / 21.0::DOUBLE) AS mid, 80 * power(1080 / 80.0::DOUBLE, (k + 2) / 21.0::DOUBLE) AS high FROM (SELECT unnest(range(20)) AS k)), "
    "a AS (SELECT rec, band, sum(power * greatest(0, least((bin * 40 - low) / (mid - low), (high - bin * 40) / (high - mid)))) AS energy FROM s, e GROUP BY rec, band) "
    "SELECT rec, CAST(band AS INT) AS band, round(ln(sqrt(greatest(energy, 1e-12)) + 1e-10), 4) AS level FROM a"
)
def log_band_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each array as one frame at 2560 Hz, under a raised cosine, in 20 bands."""
    e = _table(spark, sf_dir, "embeddings")
    under = F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(v) for v in scalar.hann(64)]), lambda a, b: a * b)
    rows = signal.samples(e.select("vec_id", under.alias("embedding")), "vec_id", "embedding")
    return _r(signal.log_bands(signal.power_spectrum(rows, 64, 33), 2560.0, 64), "level", places=4)


@query(
    f"WITH {_UNNEST}, c AS (SELECT rec, i, x - avg(x) OVER (PARTITION BY rec) AS x FROM v), "
    "p AS (SELECT a.rec, sum(a.x * b.x) AS num, sum(a.x * a.x) AS e1, sum(b.x * b.x) AS e2 FROM c a JOIN c b ON a.rec = b.rec AND b.i = a.i + 5 GROUP BY a.rec), "
    "q AS (SELECT rec, num / greatest(sqrt(e1 * e2), 1e-20) AS r FROM p) SELECT rec, round(CASE WHEN r > 0 THEN 10 * log10(least(r, 0.999999::DOUBLE) / (1 - least(r, 0.999999::DOUBLE))) END, 4) AS hnr_db FROM q"
)
def hnr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: harmonics to noise of each array as one frame, at lag 5."""
    return _r(signal.harmonicity(_table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"), 5), "hnr_db", places=4)


_RATES = "(8000, 11025, 16000, 22050, 44100, 48000)"


@query(f"SELECT CAST(r AS INT) AS rate, CAST(greatest(1, round_even(r * 0.025::DOUBLE, 0)) AS INT) AS frame, CAST(greatest(1, round_even(r * 0.01::DOUBLE, 0)) AS INT) AS hop FROM (SELECT unnest([{_RATES[1:-1]}]) AS r)")
def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of frame and hop by rate."""
    r = spark.createDataFrame([(int(x),) for x in _RATES[1:-1].split(",")], "rate int")
    return r.select("rate", scalar.frame_samples(F.col("rate")).alias("frame"), scalar.hop_samples(F.col("rate")).alias("hop"))


@query(
    f"SELECT CAST(r AS INT) AS rate, CAST(CASE WHEN r <= 11000 THEN r WHEN 11000 // gcd(r, 11000) <= 64 THEN 11000 ELSE r // CAST(greatest(1, round_even(r / 11000.0::DOUBLE, 0), ceil(r / 11220.0::DOUBLE)) AS BIGINT) END AS INT) AS formant_rate FROM (SELECT unnest([{_RATES[1:-1]}, 32000, 96000]) AS r)"
)
def formant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of formant analysis by sample rate."""
    r = spark.createDataFrame([(int(x),) for x in [*_RATES[1:-1].split(","), "32000", "96000"]], "rate int")
    return r.select("rate", scalar.formant_rate(F.col("rate"), 5500.0).alias("formant_rate"))


_USER_ISLANDS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT user_id, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM k GROUP BY user_id, island HAVING max(t) - min(t) >= 60000000)"


def _user_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.islands(_events(spark, sf_dir), ["user_id"], "t", 3_600_000_000, ["t", "event_id"], 60_000_000)


@query(f'WITH {_USER_ISLANDS} SELECT user_id, start, "end", n FROM g')
def voiced_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: stretches of events never more than an hour apart, a minute long at least."""
    return _user_islands(spark, sf_dir)


@query(f'WITH {_USER_ISLANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - start DESC, start) AS rk FROM g) SELECT user_id, start, "end", n FROM r WHERE rk = 1')
def longest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: each user's longest stretch, the first of equals."""
    return segments.longest(_user_islands(spark, sf_dir), ["user_id"])


@query(f'WITH {_USER_ISLANDS} SELECT e.user_id, event_id FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND e.t BETWEEN g.start AND g."end")')
def segment_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events inside some stretch of their user."""
    return segments.inside(_events(spark, sf_dir), ["user_id"], "t", 3_600_000_000, ["t", "event_id"], 60_000_000).select("user_id", "event_id")


@query("SELECT event_type, round(count(value) FILTER (value > 100) / count(*), 6) AS voiced_ratio, count(value) FILTER (value > 100) AS n_voiced_frames, round(avg(value) FILTER (value > 100), 6) AS f0_mean_hz, round(median(value) FILTER (value > 100), 6) AS f0_median_hz, round(stddev_pop(value) FILTER (value > 100), 6) AS f0_std_hz, min(value) FILTER (value > 100) AS f0_min_hz, max(value) FILTER (value > 100) AS f0_max_hz FROM events GROUP BY event_type")
def f0_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary over the rows that count as voiced."""
    out = statistics.pitch_summary(_table(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") > 100)
    return _r(out, "voiced_ratio", "f0_mean_hz", "f0_median_hz", "f0_std_hz")


_PERIODS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events), d AS (SELECT *, (t - lag(t) OVER w) / 1000000.0::DOUBLE AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return _events(spark, sf_dir).withColumn("p", t / F.lit(1e6)).where("p IS NOT NULL")


@query(f"WITH {_PERIODS}, q AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM d WHERE p IS NOT NULL) SELECT user_id, round(CASE WHEN count(*) >= 2 THEN 100 * (avg(abs(p - b)) FILTER (p > 0 AND b > 0 AND greatest(p / b, b / p) <= 1.3::DOUBLE)) / avg(p) END, 6) AS jitter_local_percent, count(*) AS n_periods FROM q GROUP BY user_id")
def perturb_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: period steps within a factor of 1.3, relative to the mean period."""
    return _r(statistics.jitter(_periods(spark, sf_dir), ["user_id"], ["t", "event_id"], "p"), "jitter_local_percent")


@query(f"WITH {_PERIODS}, q AS (SELECT *, value / lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM e) SELECT user_id, round(avg(abs(20 * log10(r))) FILTER (r > 0 AND greatest(r, 1 / r) <= 1.6::DOUBLE), 6) AS shimmer_local_db FROM q GROUP BY user_id")
def perturb_shimmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: decibel steps within a factor of 1.6."""
    return _r(statistics.shimmer(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value"), "shimmer_local_db")


_HALF = "r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), h AS (SELECT * FROM r WHERE n <= 5 OR rk <= greatest(5, n // 2))"


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.energetic_half(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(f"WITH {_HALF} SELECT l_returnflag, l_orderkey, l_linenumber FROM h")
def energetic_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the upper half of each group by energy."""
    return _half(spark, sf_dir).select("l_returnflag", "l_orderkey", "l_linenumber")


_FORMANTS = "CASE WHEN l_linenumber < 7 THEN l_extendedprice END"


@query(
    f"WITH {_HALF}, f AS (SELECT l_returnflag, l_quantity * 20 AS f1, l_extendedprice / 10 AS f2, CASE WHEN l_linenumber < 7 THEN l_extendedprice / 5 END AS f3 FROM h), "
    "q AS (SELECT l_returnflag, count(f3) AS n_frames, count(f3) / count(*) AS c3, "
    + ", ".join(f"quantile_cont(f{k}, 0.25) FILTER (f3 IS NOT NULL) AS a{k}, quantile_cont(f{k}, 0.5) FILTER (f3 IS NOT NULL) AS m{k}, quantile_cont(f{k}, 0.75) FILTER (f3 IS NOT NULL) AS b{k}" for k in (1, 2, 3))
    + " FROM f GROUP BY l_returnflag) SELECT l_returnflag, n_frames, "
    + ", ".join(f"round(m{k}, 4) AS f{k}_hz, round(b{k} - a{k}, 4) AS f{k}_iqr_hz, round({'c3' if k == 3 else '1'} * greatest(0, least(1, 1 - (b{k} - a{k}) / (0.2::DOUBLE * greatest(m{k}, 1)))), 4) AS f{k}_confidence" for k in (1, 2, 3))
    + " FROM q"
)
def formant_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, quartile distances and confidence of three measures over the upper half."""
    measured = lambda rows: rows.select("l_returnflag", (F.col("l_quantity") * 20).alias("f1"), (F.col("l_extendedprice") / 10).alias("f2"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice") / 5).alias("f3"))
    out = statistics.formant_summary(measured(_half(spark, sf_dir)), ["l_returnflag"], ["f1", "f2", "f3"], measured(_table(spark, sf_dir, "lineitem")))
    return _r(out, *[c for c in out.columns if c.startswith("f")], places=4)


@query(
    "WITH s AS (SELECT o_orderpriority AS g, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, median(o_totalprice) AS med, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1 HAVING count(o_totalprice) >= 5) "
    "SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, "
    "round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS df, round((b.med - a.med) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2), 6) AS effect FROM s a JOIN s b ON a.g < b.g"
)
def welch_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T, degrees of freedom and effect size for every pair of groups."""
    return _r(_r(statistics.welch(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), "t", "effect"), "df", places=4)


@query(
    "WITH r AS (SELECT c_mktsegment AS seg, median(c_acctbal) AS f0_median_hz, avg(c_acctbal) AS jitter_percent, CASE WHEN c_mktsegment <> 'BUILDING' THEN max(c_acctbal) END AS hnr_db FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING') GROUP BY 1), "
    "u AS (SELECT seg, 'f0_median_hz' AS metric, f0_median_hz AS v, 'Hz' AS unit FROM r UNION ALL SELECT seg, 'jitter_percent', jitter_percent, '%' FROM r UNION ALL SELECT seg, 'hnr_db', hnr_db, 'dB' FROM r) "
    "SELECT a.metric, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS diff_b_minus_a, a.unit FROM u a JOIN u b USING (metric) WHERE a.seg = 'AUTOMOBILE' AND b.seg = 'BUILDING' AND a.v IS NOT NULL AND b.v IS NOT NULL"
)
def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics two reports share."""
    c = _table(spark, sf_dir, "customer")
    report = lambda seg, hnr: c.where(F.col("c_mktsegment") == seg).agg(F.median("c_acctbal").alias("f0_median_hz"), F.avg("c_acctbal").alias("jitter_percent"), (F.max("c_acctbal") if hnr else F.lit(None).cast("double")).alias("hnr_db"))
    out = statistics.metric_differences(report("AUTOMOBILE", True), report("BUILDING", False), {"f0_median_hz": "Hz", "jitter_percent": "%", "hnr_db": "dB"})
    return _r(out, "a", "b", "diff_b_minus_a")


_AGREE = "count(a - b) AS n, round(avg(abs(a - b)), 4) AS mae, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS r, round(avg(a - b), 4) AS bias, round(stddev_samp(a - b), 4) AS sd, round(avg(a - b) - 1.96::DOUBLE * stddev_samp(a - b), 4) AS loa_low, round(avg(a - b) + 1.96::DOUBLE * stddev_samp(a - b), 4) AS loa_high"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("b"))


def _agreed(df: DataFrame) -> DataFrame:
    return _r(_r(df, "mae", "bias", "sd", "loa_low", "loa_high", places=4), "r")


@query(f"SELECT l_returnflag, {_AGREE} FROM (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem) GROUP BY l_returnflag")
def bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias, limits of agreement and correlation by group."""
    return _agreed(statistics.agreement(_pairs(spark, sf_dir), ["l_returnflag"], F.col("a"), F.col("b")))


@query(f"SELECT l_returnflag, l_linestatus, {_AGREE} FROM (SELECT l_returnflag, l_linestatus, l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agreement_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row counts in its condition, in its speaker and in all."""
    p = _pairs(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return _agreed(p.groupingSets(sets, "l_returnflag", "l_linestatus").agg(*statistics.agreement_columns(a, b, a - b)))


@query(
    f"WITH p AS (SELECT l_extendedprice AS a1, l_quantity * 1500 AS b1, l_discount AS a2, l_tax AS b2 FROM lineitem), "
    f"u AS (SELECT 'price' AS metric, a1 AS a, b1 AS b FROM p UNION ALL SELECT 'rate', a2, b2 FROM p) SELECT metric, {_AGREE} FROM u GROUP BY metric"
)
def summarize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics side by side, unpivoted, then summed up in one aggregation."""
    li = _table(spark, sf_dir, "lineitem")
    pair = lambda m, a, b: F.struct(F.lit(m).alias("metric"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    u = li.select(F.inline(F.array(pair("price", F.col("l_extendedprice"), F.col("l_quantity") * 1500), pair("rate", F.col("l_discount"), F.col("l_tax")))))
    return _agreed(statistics.agreement(u, ["metric"], F.col("a"), F.col("b")))


_NAME = "p_brand || '_' || CASE p_partkey % 5 WHEN 0 THEN '44k' WHEN 1 THEN '22k' WHEN 2 THEN 'snr' || CAST(p_size AS VARCHAR) || 'db' ELSE '16k' END || '.wav'"


@query(
    f"WITH n AS (SELECT p_partkey, {_NAME} AS file FROM part) SELECT p_partkey, CASE WHEN contains(file, '44k') THEN '44.1 kHz' WHEN contains(file, '22k') THEN '22.05 kHz' WHEN regexp_matches(file, 'snr\\d+db') THEN regexp_extract(file, 'snr(\\d+)db', 1) || ' dB SNR' ELSE 'clean 16 kHz' END AS condition FROM n"
)
def condition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the condition that a file name tells."""
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    kind = F.when(k == 0, "44k").when(k == 1, "22k").when(k == 2, F.concat(F.lit("snr"), F.col("p_size").cast("string"), F.lit("db"))).otherwise("16k")
    return p.select("p_partkey", statistics.condition(F.concat("p_brand", F.lit("_"), kind, F.lit(".wav"))).alias("condition"))


@query(
    "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, value FROM events), a AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT * FROM e WHERE event_type = 'click'), "
    "j AS (SELECT a.user_id, a.event_id, b.event_id AS b_event_id, b.value AS bv, a.value AS av, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.t DESC, b.event_id DESC) AS rk FROM a JOIN b ON a.user_id = b.user_id AND abs(b.t - a.t) <= 3600000000) "
    "SELECT user_id, event_id, b_event_id, round(1200 * log2(av / bv), 4) AS cents FROM j WHERE rk = 1"
)
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the user's nearest click within the hour, and their values' interval in cents."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "t", "value")
    a, b = e.where("event_type = 'view'"), e.where("event_type = 'click'")
    m = statistics.nearest(a, b, ["user_id"], "t", 3_600_000_000, "event_id")
    return _r(m.select("user_id", "event_id", "b_event_id", scalar.cents(F.col("value"), F.col("b_value")).alias("cents")), "cents", places=4)


@query("SELECT event_id, CASE WHEN value BETWEEN 20 AND 45 THEN 'typical' WHEN value BETWEEN 15 AND 20 THEN 'borderline' ELSE 'out' END AS grade FROM events")
def grade_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against the screening ranges of one metric."""
    e = _table(spark, sf_dir, "events").select("event_id", "value", F.lit("hnr_db").alias("metric"))
    return statistics.graded(e, statistics.norms(spark), "metric", "value").select("event_id", "grade")


@query("SELECT * FROM (VALUES ('jitter_percent', 'typical', 0.0::DOUBLE, 1.0::DOUBLE, 'held vowels'), ('jitter_percent', 'borderline', 1.0::DOUBLE, 1.5::DOUBLE, 'held vowels')) t(metric, band, lo, hi, note)")
def norm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges a loose metric name means."""
    return statistics.reference_ranges(statistics.norms(spark), "Jitter local")


#: Centroids that one array holds at most, about.
LABELS = 4000

_CONV = "c AS (SELECT conv_id AS id, 'u' || CAST(conv_id % 7 AS VARCHAR) AS user_key, CAST(min(turn) AS DOUBLE) AS created_at, CAST(max(turn) + conv_id % 13 AS DOUBLE) AS updated_at FROM conversations GROUP BY conv_id)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").cast("double").alias("created_at"), F.max("turn").alias("m"))
    return c.select("id", F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("user_key"), "created_at", (F.col("m") + F.col("id") % 13).cast("double").alias("updated_at"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "conversations")
    files = F.when(F.col("turn") % 3 == 0, '["a.wav","b.wav"]').when(F.col("turn") % 3 == 1, "not json")
    return m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), files.alias("files"), (F.col("turn") * F.lit(3.0)).alias("created_at"))


@query(f"WITH {_CONV} SELECT id, user_key, updated_at FROM c WHERE user_key = 'u3' ORDER BY updated_at DESC, id LIMIT 30")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's latest conversations."""
    return store.listed(_conversations(spark, sf_dir), "u3").select("id", "user_key", "updated_at")


@query("SELECT conv_id * 1000 + turn AS id, role, CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END AS n_files FROM conversations WHERE conv_id = 3 ORDER BY id LIMIT 200")
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: a conversation's messages; unreadable file lists are empty."""
    return store.messages_of(_messages(spark, sf_dir), 3).select("id", "role", F.size("files").alias("n_files"))


@query(f"WITH {_CONV}, l AS (SELECT conv_id, max(turn * 3.0::DOUBLE) AS last FROM conversations GROUP BY 1) SELECT id, greatest(updated_at, last) AS updated_at FROM c JOIN l ON id = conv_id")
def conversation_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H6: updated_at follows the last message."""
    return store.touched(_conversations(spark, sf_dir), _messages(spark, sf_dir)).select("id", "updated_at")


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id % 5 <> 0")
def conversation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of messages after conversations were deleted."""
    gone = _conversations(spark, sf_dir).where("id % 5 = 0").select("id")
    return store.without(_messages(spark, sf_dir), gone, "conversation_id", "id").select("id")


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE 'u' || CAST(conv_id % 7 AS VARCHAR) = 'u2'")
def owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of the owner's conversations."""
    return store.owned(_messages(spark, sf_dir), _conversations(spark, sf_dir), "u2").select("id")


@query("WITH x AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, event_type, epoch_us(ts) AS t FROM x")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: the last row of each key in an append log."""
    e = _events(spark, sf_dir).select("user_id", "t", "event_id", "event_type")
    return store.latest(e, "user_id", "t").select("user_id", "event_type", "t")


@query(
    "WITH c AS (SELECT *, length(coalesce(text, '')) AS sz, min(turn) OVER w AS f, max(turn) OVER w AS l, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id)), "
    "b AS (SELECT *, sum(sz) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) + sum(CASE WHEN turn = f THEN sz END) OVER (PARTITION BY conv_id) AS back, sum(sz) OVER (PARTITION BY conv_id) AS tot FROM c), "
    "k AS (SELECT *, max(CASE WHEN turn > f AND turn < l AND role = 'user' AND back > 300 THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM b), "
    "s AS (SELECT *, tot <= 300 OR n <= 2 AS whole, tot <= 300 OR n <= 2 OR turn = f OR cut IS NULL OR turn >= cut AS kept FROM k), "
    "o AS (SELECT *, NOT whole AND sum(CASE WHEN kept THEN sz END) OVER (PARTITION BY conv_id) > 450 AS tail FROM s) "
    "SELECT conv_id, turn FROM o WHERE CASE WHEN tail THEN turn IN (f, l) ELSE kept END"
)
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories cut to a budget of 300 characters."""
    return store.trimmed(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 300).select("conv_id", "turn")


@query("SELECT CAST(user_id AS VARCHAR) AS user_key, epoch_us(ts) / 1000000.0::DOUBLE AS ts, CAST(event_id AS VARCHAR) AS file, value AS f0 FROM events WHERE user_id = 8 ORDER BY ts, file LIMIT 500")
def trends_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, H9: a user's oldest measurements."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_key"), (F.col("t") / F.lit(1e6)).alias("ts"), F.col("event_id").cast("string").alias("file"), F.col("value").alias("f0"))
    return store.measurements_of(e, "8")


@query(
    "WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '-5' WHEN 2 THEN 'soon' ELSE CAST(1700000000 + event_id AS VARCHAR) END AS ts, CASE event_id % 7 WHEN 3 THEN 'true' ELSE CAST(value AS VARCHAR) END AS f0 FROM events), "
    "n AS (SELECT event_id, CASE WHEN ts IS NULL THEN 1700005000 ELSE try_cast(ts AS DOUBLE) END AS t, ts, try_cast(f0 AS DOUBLE) AS f FROM m) SELECT event_id, coalesce(t > 0 AND t <= 1700005300, false) AND f IS NOT NULL AS ok FROM n"
)
def trend_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with their verdict; refused rows stay to be reported."""
    k = F.col("event_id") % 5
    ts = F.when(k == 1, "-5").when(k == 2, "soon").when(k != 0, (F.col("event_id") + 1700000000).cast("string"))
    m = _table(spark, sf_dir, "events").select("event_id", ts.alias("ts"), F.when(F.col("event_id") % 7 == 3, "true").otherwise(F.col("value").cast("string")).alias("f0"))
    return store.checked(m, 1700005000.0, ["f0"]).select("event_id", "ok")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the trailing window, whether or not they were let through."""
    e = _events(spark, sf_dir).withColumn("s", F.floor(F.col("t") / 1_000_000))
    return store.in_window(e, ["user_id"], "s", 36000).select("event_id", "in_window")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), "
    "w AS (SELECT user_id, k, s, true AS ok, [s] AS held FROM e WHERE k = 1 UNION ALL "
    "SELECT user_id, k, s, len(h) < 8, CASE WHEN len(h) < 8 THEN list_append(h, s) ELSE h END FROM (SELECT e.*, list_filter(w.held, lambda x: e.s - x <= 36000) AS h FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)) "
    "SELECT user_id, s, ok FROM w"
)
def rate_limit_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight calls in ten hours, where refused calls do not count."""
    e = _events(spark, sf_dir).withColumn("s", F.col("t") / F.lit(1e6))
    return store.accepted(e, ["user_id"], "s", 8, 36000.0)


@query("SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 50000 AS within FROM documents")
def quota_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has used so far, against a quota."""
    return store.running(_table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 50000).select("doc_id", "used", "within")


@query(
    "WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), "
    "w AS (SELECT source, doc_id, n_chars, k, n_chars <= 50000 AS taken, CASE WHEN n_chars <= 50000 THEN n_chars ELSE 0 END AS used FROM d WHERE k = 1 UNION ALL "
    "SELECT d.source, d.doc_id, d.n_chars, d.k, w.used + d.n_chars <= 50000, w.used + CASE WHEN w.used + d.n_chars <= 50000 THEN d.n_chars ELSE 0 END FROM w JOIN d ON d.source = w.source AND d.k = w.k + 1) "
    "SELECT source, doc_id, CAST(n_chars AS BIGINT) AS n_chars, taken FROM w"
)
def quota_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents each source may upload under a quota; refused ones do not count."""
    return store.uploads(_table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 50000)


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content."""
    return store.distinct_content(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT user_id, max(epoch_us(ts)) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 64")
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 sessions used last."""
    return store.most_recent(_events(spark, sf_dir), "user_id", "t")


@query(
    "WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS new, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, CAST(min(n) AS INT) AS first, CAST(max(n) AS INT) AS last, count(*) AS n FROM r GROUP BY conv_id, run"
)
def turn_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: runs of turns by one speaker."""
    return segments.runs(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@query(
    "WITH e AS (SELECT vec_id // 100 AS rec, vec_id, label, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS n FROM embeddings), "
    "c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR n = 1 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY rec ORDER BY vec_id)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS run FROM c), "
    "t AS (SELECT rec, run, any_value(label) AS speaker, (min(n) - 1) * 0.1::DOUBLE AS s, max(n) * 0.1::DOUBLE AS e FROM r GROUP BY 1, 2), "
    "a AS (SELECT *, sum(CASE WHEN run = 1 OR e - s >= 0.4::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY run ROWS UNBOUNDED PRECEDING) AS g FROM t), "
    "b AS (SELECT rec, g, arg_min(speaker, run) AS speaker, min(s) AS s, arg_max(e, run) AS e FROM a GROUP BY 1, 2), "
    "d AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY rec ORDER BY g) THEN 1 ELSE 0 END AS new FROM b), "
    "f AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY g ROWS UNBOUNDED PRECEDING) AS h FROM d) "
    "SELECT rec, CAST(h - 1 AS INT) AS turn, any_value(speaker) AS speaker, round(min(s), 6) AS start, round(max(e), 6) AS \"end\" FROM f GROUP BY rec, h"
)
def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: label runs as turns, those under 0.4 s absorbed, neighbours merged."""
    e = _table(spark, sf_dir, "embeddings").withColumn("rec", F.floor(F.col("vec_id") / 100))
    runs = segments.runs(e, ["rec"], ["vec_id"], "label")
    turns = runs.select("rec", "run", F.col("label").alias("speaker"), ((F.col("first") - 1) * F.lit(0.1)).alias("start"), (F.col("last") * F.lit(0.1)).alias("end"))
    return _r(segments.merged_turns(turns, ["rec"], "run", 0.4), "start", "end")


@query("SELECT label, round(count(*) * 0.01::DOUBLE, 1) AS speaking_s FROM embeddings GROUP BY label")
def speaker_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: time by label."""
    return _r(_table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count(F.lit(1)) * F.lit(0.01)).alias("speaking_s")), "speaking_s", places=1)


@query(
    f"WITH {_UNNEST}, c AS (SELECT rec, i, x - avg(x) OVER (PARTITION BY rec) AS x FROM v), u AS (SELECT rec, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY rec)), 1e-10) AS x FROM c), "
    "l AS (SELECT u.*, label FROM u JOIN embeddings ON rec = vec_id), m AS (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY 1), "
    "d AS (SELECT l.rec, l.label AS own, m.label AS other, 1 - sum(l.x * m.x) / any_value(n.z) AS dist FROM l JOIN m ON l.i = m.i JOIN n ON n.label = m.label GROUP BY 1, 2, 3), "
    "s AS (SELECT rec, max(CASE WHEN own = other THEN dist END) AS a, min(CASE WHEN own <> other THEN dist END) AS b FROM d GROUP BY rec) SELECT rec, round(a, 5) AS own, round(b, 5) AS other, round((b - a) / greatest(a, b, 1e-10), 5) AS silhouette FROM s"
)
def cosine_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: unit vectors against the centroids of the labels, and each one's silhouette."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("raw"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    e = scalar.computed_once(e, m=F.aggregate("raw", F.lit(0.0), lambda s, v: s + v) / F.size("raw"))
    e = scalar.computed_once(e, c=F.transform("raw", lambda v: v - F.col("m")))
    e = scalar.computed_once(e, z=F.greatest(F.sqrt(dot(F.col("c"), F.col("c"))), F.lit(1e-10)))
    e = scalar.computed_once(e, x=F.transform("c", lambda v: v / F.col("z"))).select("vec_id", "label", "x")
    means = e.select("label", F.posexplode("x")).groupBy("label", "pos").agg(F.avg("col").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda p: p["c"]).alias("c"))
    means = means.select("label", "c", F.sqrt(dot(F.col("c"), F.col("c"))).alias("z"))
    # Every vector meets the centroids as arrays of some thousand at most, whatever their number.
    blocks = -(-means.count() // LABELS) or 1
    every = means.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("label", "c", "z")).alias("all")).drop("block")
    d = scalar.computed_once(e.crossJoin(F.broadcast(every) if blocks == 1 else every), d=F.transform("all", lambda k: F.struct(k["label"].alias("l"), (1 - dot(F.col("x"), k["c"]) / k["z"]).alias("d"))))
    own = F.element_at(F.filter("d", lambda k: k["l"] == F.col("label")), 1)["d"]
    other = F.array_min(F.transform(F.filter("d", lambda k: k["l"] != F.col("label")), lambda k: k["d"]))
    out = scalar.computed_once(d, own=own, other=other).select(F.col("vec_id").alias("rec"), "own", "other")
    if blocks > 1:
        out = out.groupBy("rec").agg(F.max("own").alias("own"), F.min("other").alias("other"))
    return _r(out.withColumn("silhouette", (F.col("other") - F.col("own")) / F.greatest("other", "own", F.lit(1e-10))), "own", "other", "silhouette", places=5)


@query(
    "WITH p AS (SELECT page_id, url || '/my clip \"' || CAST(page_id AS VARCHAR) || '\".wav' AS path FROM pages), b AS (SELECT page_id, regexp_extract(path, '[^/]*$') AS base FROM p) "
    "SELECT page_id, substr(regexp_replace(base, '[\\r\\n\"]', '_', 'g'), 1, 80) AS header, regexp_replace(base, '[^A-Za-z0-9._-]', '_', 'g') AS stored, '…/' || base AS shown FROM b"
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for headers, for storage and for display."""
    path = F.concat("url", F.lit('/my clip "'), F.col("page_id").cast("string"), F.lit('".wav'))
    base = F.substring_index(path, "/", -1)
    return _table(spark, sf_dir, "pages").select("page_id", scalar.safe_name(path).alias("header"), scalar.storage_name(base).alias("stored"), scalar.redacted_path(path).alias("shown"))


_BEAT = "abs(sin(3.141592653589793::DOUBLE * 4 / 16000 * i)) * 0.5::DOUBLE * sin(6.283185307179586::DOUBLE * 150 / 16000 * i)"


@query(
    f"WITH RECURSIVE s AS (SELECT i, {_BEAT} AS x FROM (SELECT CAST(range AS INT) AS i FROM range(48000))), "
    + _FRAMES.format(n=48000)
    + f""", g AS (SELECT frame_idx AS i, {_DB.format('power')} AS db FROM f),
h AS (SELECT i, power(10, db / 20) AS x, db > (SELECT max(db) FROM g) - 32 AS speech FROM g),
k AS (SELECT d, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (d + 2) / 4)) / 2 AS k FROM (SELECT unnest(range(-2, 3)) AS d)),
y AS (SELECT a.i, any_value(a.speech) AS speech, sum(b.x * k) AS x FROM h a JOIN k ON true JOIN h b ON b.i = a.i + d GROUP BY a.i),
m AS (SELECT *, lag(x) OVER (ORDER BY i) AS before, lead(x) OVER (ORDER BY i) AS after, max(x) OVER () AS top,
  min(x) OVER (ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS l, min(x) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS r FROM y),
z AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM m WHERE speech AND x > 0.25::DOUBLE * top AND x >= before AND x > after AND (x - greatest(l, r)) / x >= 0.5::DOUBLE),
w AS (SELECT n, i AS last, 1 AS found FROM z WHERE n = 1 UNION ALL SELECT z.n, CASE WHEN z.i - w.last >= 12 THEN z.i ELSE w.last END, w.found + CASE WHEN z.i - w.last >= 12 THEN 1 ELSE 0 END FROM w JOIN z ON z.n = w.n + 1),
c AS (SELECT coalesce((SELECT max(found) FROM w), 0) AS found, sum(CAST(speech AS INT)) * 0.01::DOUBLE AS speech_s FROM h)
SELECT CAST(0 AS INT) AS rec, CAST(found AS INT) AS syllable_est, CASE WHEN speech_s > 0.2::DOUBLE THEN round(found / speech_s, 2) END AS articulation_rate_syl_per_s FROM c"""
)
def syllable_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7, Q8: peaks of the smoothed envelope, 0.12 s apart, and the articulation rate, of a tone that
    swells four times a second."""
    beat = F.abs(F.sin(F.lit(3.141592653589793 * 4 / 16000) * F.col("i")))
    power = signal.frame_power(signal.framed(_tone(spark, 48000, beat * _sine(0.5, 150.0)), 48000, 400, 160)).withColumn("db", scalar.db(F.col("power")))
    g = power.withColumn("speech", F.col("db") > F.max("db").over(Window.partitionBy("rec")) - 32)
    g = g.select("rec", F.col("frame").alias("i"), F.pow(F.lit(10.0), F.col("db") / 20).alias("x"), "speech")
    s = signal.hann_smoothed(g, 5).drop("x").withColumnRenamed("y", "x")
    w = Window.partitionBy("rec").orderBy("i")
    s = signal.prominence(s).withColumn("before", F.lag("x").over(w)).withColumn("after", F.lead("x").over(w)).withColumn("top", F.max("x").over(Window.partitionBy("rec")))
    peak = F.col("speech") & (F.col("x") > 0.25 * F.col("top")) & (F.col("x") >= F.col("before")) & (F.col("x") > F.col("after")) & (F.col("prominence") >= 0.5)
    found = s.groupBy("rec").agg(F.array_sort(F.collect_list(F.when(peak, F.col("i")))).alias("at"), (F.sum(F.col("speech").cast("int")) * 0.01).alias("speech_s"))
    n = segments.spaced(F.col("at"), 12)
    return found.select("rec", n.alias("syllable_est"), F.when(F.col("speech_s") > 0.2, F.round(n / F.col("speech_s"), 2)).alias("articulation_rate_syl_per_s"))
