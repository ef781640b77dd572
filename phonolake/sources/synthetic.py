"""Voices made from formulas, for tests and for queries without audio at hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.kernels.audio import add_noise, resample, to_rate
from phonolake.sources.audio import RECORDINGS

CONDITIONS = ("clean", "breathy", "8 kHz", "muffled")


def resonator(x: np.ndarray, hz: float, width: float, rate: int) -> np.ndarray:
    """x through a two-pole resonance."""
    r = np.exp(-np.pi * width / rate)
    a, b = 2 * r * np.cos(2 * np.pi * hz / rate), -r * r
    y, p, q = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x):
        p, q = v + a * p + b * q, p
        y[i] = p
    return y


def vowel(f0: float, formants: list[float], seconds: float = 1.0, rate: int = 16000, jitter: float = 0.0, shimmer: float = 0.0, breath: float = 0.0, seed: int = 0) -> np.ndarray:
    """Pulses through a tilt and a cascade of resonances, each stage brought to full scale."""
    rng = np.random.default_rng(seed)
    x, at = np.zeros(int(seconds * rate)), 0.0
    while at < len(x):
        x[int(at)] = 1 + shimmer * rng.standard_normal()
        at += rate / f0 * (1 + jitter * rng.standard_normal())
    tilt, last = np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        last = v + 0.97 * last
        tilt[i] = last
    x = tilt
    for k, hz in enumerate(formants):
        x = resonator(x, hz, 60.0 + 50.0 * k, rate)
        x /= np.abs(x).max() or 1.0
    return 0.8 * (x + breath * rng.standard_normal(len(x)) * np.std(x))


def drawn(i: int, seed: int) -> tuple[int, np.ndarray]:
    """Voice number i: pitch, formants, perturbation and condition drawn from the seed and the number."""
    rng = np.random.default_rng([seed, i])
    f0, f1, f2, f3 = rng.uniform((90, 300, 900, 2200), (280, 800, 2200, 3000))
    jitter, shimmer = rng.uniform((0, 0), (0.01, 0.05))
    x = vowel(f0, [f1, f2, f3], 1.0, 16000, jitter, shimmer, 0.15 if i % 4 == 1 else 0.0, seed + i)
    if i % 4 == 2:
        return 8000, resample(x, 1, 2)
    if i % 4 == 3:
        y = resample(resample(x, 3, 4), 4, 3)[: len(x)]
        return 16000, y + 0.05 * np.std(y) * rng.standard_normal(len(y))
    return 16000, x


def voices(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n recordings, the same whatever the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rate, x = drawn(i, seed)
                yield pa.RecordBatch.from_arrays([pa.array([f"voice_{i:05d}_{CONDITIONS[i % 4]}.wav"]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float64())), pa.array([None], pa.string())], names=["path", "sample_rate", "samples", "error"])

    return spark.range(n).mapInArrow(run, RECORDINGS)


def conditions(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each recording under each job (condition, up, down, snr_db): resampled, or with noise."""
    # A handful of conditions go to the recordings, whose size Spark cannot tell.
    crossed = recordings.where("error IS NULL").crossJoin(F.broadcast(jobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, x, name, up, down, snr in zip(*(batch.column(i) for i in range(7)), strict=True):
                y = resample(x.values.to_numpy(zero_copy_only=False), up.as_py(), down.as_py())
                if snr.is_valid:
                    y = add_noise(y, snr.as_py(), sum(path.as_py().encode()))
                yield pa.RecordBatch.from_arrays([pa.array([f"{name.as_py()}_{path.as_py()}"]), pa.array([rate.as_py() * up.as_py() // down.as_py()], pa.int32()), pa.array([y], pa.list_(pa.float64())), pa.array([None], pa.string())], names=["path", "sample_rate", "samples", "error"])

    return crossed.select("path", "sample_rate", "samples", "condition", "up", "down", "snr_db").mapInArrow(run, RECORDINGS)


#: The recordings made from a read corpus, fixed values: speakers, the utterances kept as they are,
#: (speaker, utterance, rate) to resample, (speaker, utterance, decibels) to add noise to, and the
#: telephone band's speakers, utterances and rate.
SPEAKERS = ("bdl", "rms", "slt", "clb")
CLEAN = range(1, 21)
RESAMPLED = (
    ("bdl", 21, 44100), ("bdl", 22, 44100), ("slt", 21, 44100), ("slt", 22, 44100), ("rms", 21, 44100),
    ("clb", 21, 22050), ("clb", 22, 22050), ("slt", 23, 22050), ("bdl", 23, 22050), ("rms", 22, 22050),
)
NOISY = (
    ("bdl", 24, 20.0), ("slt", 24, 20.0), ("rms", 24, 15.0), ("clb", 24, 15.0), ("bdl", 25, 10.0),
    ("slt", 25, 10.0), ("rms", 25, 5.0), ("clb", 25, 5.0), ("rms", 23, 0.0), ("clb", 23, 0.0),
)
TELEPHONE = (("bdl", "slt"), range(1, 6), 8000)
#: Recordings that each set must come to.
EXPECTED = {"main": 100, "telephony": 10}


def jobs(spark: SparkSession) -> DataFrame:
    """(speaker, utterance, part, tag, rate, snr_db): what is to be made of which recording."""
    made = [(s, n, "main", "", None, None) for s in SPEAKERS for n in CLEAN]
    made += [(s, n, "main", f"_sr{r // 1000}k", r, None) for s, n, r in RESAMPLED]
    made += [(s, n, "main", f"_snr{int(d)}db", None, d) for s, n, d in NOISY]
    made += [(s, n, "telephony", f"_sr{TELEPHONE[2] // 1000}k", TELEPHONE[2], None) for s in TELEPHONE[0] for n in TELEPHONE[1]]
    return spark.createDataFrame(made, "speaker string, utterance int, part string, tag string, rate int, snr_db double")


def derived(recordings: DataFrame) -> DataFrame:
    """The recordings of `jobs`, made from those whose names hold speaker and utterance (bdl_.._a0001.wav),
    with their part. A job without its recording makes none; `complete` tells."""
    name = F.substring_index("path", "/", -1)
    named = recordings.where("error IS NULL").select(
        F.regexp_extract(name, r"^([a-z]+)_", 1).alias("speaker"),
        F.regexp_extract(name, r"a(\d{4})\.wav$", 1).try_cast("int").alias("utterance"),
        F.col("sample_rate").alias("own_rate"),
        "samples",
    )
    joined = named.join(F.broadcast(jobs(recordings.sparkSession)), ["speaker", "utterance"])  # 110 jobs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for speaker, utterance, own, x, part, tag, rate, snr in zip(*(batch.column(i) for i in range(8)), strict=True):
                target = rate.as_py() or own.as_py()
                y = to_rate(x.values.to_numpy(zero_copy_only=False), own.as_py(), target)
                path = f"{speaker}_a{utterance.as_py():04d}{tag}.wav"
                if snr.is_valid:
                    y = add_noise(y, snr.as_py(), sum(path.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([target], pa.int32()), pa.array([y], pa.list_(pa.float64())), pa.array([None], pa.string()), pa.array([part.as_py()])], names=["path", "sample_rate", "samples", "error", "part"])

    slim = joined.select("speaker", "utterance", "own_rate", "samples", "part", "tag", "rate", "snr_db")
    return slim.mapInArrow(run, f"{RECORDINGS}, part string")


def complete(made: DataFrame) -> DataFrame:
    """made, if each part has as many recordings as it must."""
    found = {r.part: r["count"] for r in made.groupBy("part").count().collect()}  # two parts
    if found != EXPECTED:
        raise ValueError(f"recordings by part: {found}, expected {EXPECTED}")
    return made
