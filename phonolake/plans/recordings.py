"""Queries over synthetic recordings: what SQL cannot say, held by tests against closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.engine import AcousticEngine
from phonolake.operators import segments, statistics
from phonolake.plans.queries import QUERIES, _r, query
from phonolake.sources import audio, synthetic

#: Recordings that the queries make: so many, and one more for every so many suppliers.
VOICES, SUPPLIERS = 16, 10


def _voices(spark: SparkSession, sf_dir: str) -> tuple[AcousticEngine, DataFrame]:
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return AcousticEngine(spark), synthetic.voices(spark, VOICES + n // SUPPLIERS)


@query()
def analyze_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: one flat line for each recording."""
    engine, v = _voices(spark, sf_dir)
    return engine.batch_rows(engine.analyze(v))


@query()
def pitch_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch frames."""
    engine, v = _voices(spark, sf_dir)
    return engine.pitch_frames(v)


@query()
def pitch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced segments from the frame table."""
    engine, v = _voices(spark, sf_dir)
    return segments.islands(engine.pitch_frames(v).where("voiced"), ["path"], "t_s", 0.1, ["frame"], 0.3)


@query()
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: glottal periods."""
    engine, v = _voices(spark, sf_dir)
    return engine.periods(v)


@query()
def perturbation_by_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3 over the table of periods."""
    engine, v = _voices(spark, sf_dir)
    p = engine.periods(v)
    return statistics.jitter(p, ["path"], ["k"], "period_s").join(statistics.shimmer(p, ["path"], ["k"], "amp"), "path")


@query()
def segment_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: perturbation and harmonicity of each recording's longest voiced stretch, or of all of it."""
    engine, v = _voices(spark, sf_dir)
    return engine.analyze(v).select("path", "voice_quality_segment_s.*", "voice_quality.*", "hnr_db")


@query()
def lpc_formants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formant medians from the frame table."""
    engine, v = _voices(spark, sf_dir)
    half = statistics.energetic_half(engine.formant_frames(v).where("voiced"), ["path"], "energy", ["frame"], bounded=True)
    return statistics.formant_summary(half, ["path"], ["F1", "F2", "F3"], bounded=True)


@query()
def formant_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formants along each recording, thinned for a plot."""
    engine, v = _voices(spark, sf_dir)
    return engine.formant_track(engine.formant_frames(v), 20)


@query()
def log_band_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band levels by frame."""
    engine, v = _voices(spark, sf_dir)
    return engine.log_bands(v)


@query()
def spectrogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: pooled levels by frequency and time."""
    engine, v = _voices(spark, sf_dir)
    return engine.spectrograms(v)


@query()
def diarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to K6: turns by speaker."""
    engine, v = _voices(spark, sf_dir)
    return engine.diarize(v).select("path", "n_speakers", F.explode("turns").alias("turn")).select("path", "n_speakers", "turn.*")


@query()
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as WAVE bytes, read back at 11 kHz."""
    engine, v = _voices(spark, sf_dir)
    files = audio.encoded(v)
    back = engine.decoded(files, 11000).select("path", "sample_rate", F.size("samples").alias("n_samples"), "error")
    return back.join(audio.file_info(files).select("path", "duration_s"), "path")


@query()
def condition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker on clean recordings against itself under noise and resampling."""
    engine, v = _voices(spark, sf_dir)
    v = v.where("sample_rate = 16000")
    jobs = spark.createDataFrame([("22k", 11, 8, None), ("snr10db", 1, 1, 10.0)], "condition string, up int, down int, snr_db double")
    clean, changed = engine.pitch_frames(v), engine.pitch_frames(synthetic.conditions(v, jobs))
    # Changed recordings are known by condition and path, and so is what each is held against.
    clean = clean.withColumn("path", F.explode(F.array(*[F.concat(F.lit(f"{c}_"), "path") for c in ("22k", "snr10db")])))
    found = engine.f0_agreement(changed, clean)
    return found.withColumn("condition", F.substring_index("path", "_", 1)).withColumn("path", F.regexp_replace("path", "^[^_]*_", ""))


@query()
def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings side by side, with Welch's test over their contours."""
    engine, v = _voices(spark, sf_dir)
    reports = engine.analyze(v.where(F.col("path").rlike("voice_0000[04]_")), contour=True)
    return engine.compare(reports.where(F.col("path").contains("00000")), reports.where(F.col("path").contains("00004"))).drop("error")


@query(
    "WITH s AS (SELECT o_orderpriority AS g, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, median(o_totalprice) AS med, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1 HAVING count(o_totalprice) >= 5), "
    "w AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS df, (b.med - a.med) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2) AS effect FROM s a JOIN s b ON a.g < b.g), "
    # Simpson's rule over the density of Student's t from 0 to |t|, 2000 steps.
    "i AS (SELECT group_a, group_b, sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(abs(t) * k / 2000, 2) / df, -(df + 1) / 2)) * abs(any_value(t)) / 6000 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(any_value(df) * pi()) AS area FROM w, (SELECT unnest(range(2001)) AS k) GROUP BY group_a, group_b) "
    "SELECT group_a, group_b, n_a, n_b, round(t, 6) AS t, round(df, 4) AS df, round(effect, 6) AS effect, round(1 - 2 * area, 6) AS p, 1 - 2 * area < 0.05 AS significant FROM w JOIN i USING (group_a, group_b)"
)
def welch_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities for every pair of groups."""
    engine = AcousticEngine(spark)
    tested = engine.with_probability(statistics.welch(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_totalprice"))
    return _r(_r(tested, "t", "effect", "p"), "df", places=4)


__all__ = ["QUERIES"]
