"""The acoustic engine: recordings in, fact tables and reports out.

Python runs once for each recording, pitch is found once, and what comes out are
typed rows; grouping, ranking, joining and comparing them is left to Spark.
"""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolake.functions.scalar import db, ratio
from phonolake.kernels import audio, frames, pitch, speakers, stats, structure, voice
from phonolake.operators import statistics
from phonolake.sources.audio import decoded, recordings

FORMANT_CEILING = 5500.0
#: Metrics that two reports are compared by, and their units.
COMPARED = {"f0_median_hz": "Hz", "jitter_percent": "%", "shimmer_db": "dB", "hnr_db": "dB"}
_D, _I, _S, _B = pa.float64(), pa.int64(), pa.string(), pa.bool_()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: send it along unless PYTHONPATH already has it."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    made = Path(tempfile.mkdtemp(prefix="phonolake-")) / "phonolake_core.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((root / "phonolake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(made))
    _shipped.add(context.applicationId)


def _struct(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))


_SPAN = _struct(start_s=_D, end_s=_D)
#: The report of one recording, field by field; what was not measured is null.
REPORT = _struct(
    path=_S,
    duration_s=_D,
    sample_rate_hz=pa.int32(),
    n_samples=_I,
    backend=_S,
    pitch=_struct(voiced_ratio=_D, n_voiced_frames=_I, f0_mean_hz=_D, f0_median_hz=_D, f0_std_hz=_D, f0_min_hz=_D, f0_max_hz=_D),
    voice_quality=_struct(jitter_local_percent=_D, shimmer_local_db=_D, n_periods=_I),
    voice_quality_segment_s=_SPAN,
    hnr_db=_D,
    formants=_struct(F1_hz=_D, F2_hz=_D, F3_hz=_D, n_frames=_I, F1_iqr_hz=_D, F2_iqr_hz=_D, F3_iqr_hz=_D, confidence=_struct(F1=_D, F2=_D, F3=_D)),
    recording_quality=_struct(peak_dbfs=_D, clipping_ratio=_D, snr_db=_D, issues=pa.list_(_S)),
    voiced_segments=pa.list_(_SPAN),
    pause_stats=_struct(speech_s=_D, silence_ratio=_D, n_pauses=_I, pause_total_s=_D, pause_mean_s=_D, pause_max_s=_D, syllable_est=_I, articulation_rate_syl_per_s=_D),
    pitch_contour=_struct(times_s=pa.list_(_D), f0_hz=pa.list_(_D)),
    formant_track=_struct(times_s=pa.list_(_D), F1_hz=pa.list_(_D), F2_hz=pa.list_(_D), F3_hz=pa.list_(_D)),
    spectrogram=_struct(t_max=_D, times_s=pa.list_(_D), freqs_hz=pa.list_(_D), values_db=pa.list_(pa.list_(_D))),
    error=_S,
)


def _known(x: float | None, places: int | None = None) -> float | None:
    """x, rounded if asked for; None for NaN."""
    if x is None or not math.isfinite(x):
        return None
    return round(float(x), places) if places is not None else float(x)


def _pitch(t: pitch.Track) -> dict:
    f = t.f0[t.voiced]
    out = {"voiced_ratio": float(t.voiced.mean()) if len(t.voiced) else 0.0, "n_voiced_frames": len(f)}
    if len(f):
        out |= {"f0_mean_hz": f.mean(), "f0_median_hz": np.median(f), "f0_std_hz": f.std(), "f0_min_hz": f.min(), "f0_max_hz": f.max()}
    return out


def formant_rows(x: np.ndarray, rate: int, t: pitch.Track, ceiling: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(times, energies, voiced, F1 to F3 by frame, NaN where not found) at twice the ceiling's rate."""
    up, down = audio.formant_rate(rate, ceiling)
    y, low = audio.resample(x, up, down), rate * up // down
    length, hop = frames.lengths(low)
    cut = frames.frames(y, length, hop)
    voiced = np.zeros(len(cut), bool)
    n = min(len(cut), len(t.voiced))
    voiced[:n] = t.voiced[:n]
    found = np.full((len(cut), 3), np.nan)
    for i in np.flatnonzero(voiced):
        f = voice.formants(cut[i], low)[:3]
        found[i, : len(f)] = f
    energy = np.sqrt(np.square(cut).mean(axis=1) + 1e-12) if len(cut) else np.empty(0)
    return frames.times(len(cut), length, hop, low), energy, voiced, found


def _formants(energy: np.ndarray, voiced: np.ndarray, found: np.ndarray) -> dict | None:
    rows = found[voice.energetic(energy, voiced)]
    full = rows[~np.isnan(rows).any(axis=1)]
    if not len(full):
        return None
    low, mid, high = np.percentile(full, [25, 50, 75], axis=0)
    trust = (~np.isnan(rows)).mean(axis=0) * np.clip(1 - (high - low) / (0.2 * np.maximum(mid, 1.0)), 0, 1)
    names = ("F1", "F2", "F3")
    return {f"{n}_hz": m for n, m in zip(names, mid, strict=True)} | {f"{n}_iqr_hz": round(float(q), 1) for n, q in zip(names, high - low, strict=True)} | {"n_frames": len(full), "confidence": {n: round(float(c), 2) for n, c in zip(names, trust, strict=True)}}


def measure(path: str | None, x: np.ndarray, rate: int, contour: bool, ceiling: float) -> dict:
    """One recording's report."""
    t = pitch.track(x, rate) if len(x) else pitch.Track(*(np.empty(0) for _ in range(2)), np.empty(0, bool))
    spans = structure.voiced_segments(t)
    best = max(spans, key=lambda s: s[1] - s[0]) if spans else None
    part, sub = (x[int(best[0] * rate) : int(best[1] * rate) + 1], t.between(*best)) if best else (x, t)
    jitter, shimmer, n = voice.perturbation(part, rate, sub)
    times, energy, voiced, found = formant_rows(x, rate, t, ceiling) if len(x) else (np.empty(0), np.empty(0), np.empty(0, bool), np.empty((0, 3)))
    report = {
        "path": path, "duration_s": round(len(x) / rate, 3), "sample_rate_hz": rate, "n_samples": len(x), "backend": "native",
        "pitch": _pitch(t),
        "voice_quality": {"jitter_local_percent": _known(jitter), "shimmer_local_db": _known(shimmer), "n_periods": n},
        "voice_quality_segment_s": dict(zip(("start_s", "end_s"), best, strict=True)) if best else None,
        "hnr_db": _known(voice.harmonicity(part, rate, sub), 2) if len(part) else None,
        "formants": _formants(energy, voiced, found),
        "recording_quality": structure.quality(x, rate),
        "voiced_segments": [{"start_s": a, "end_s": b} for a, b in spans],
        "pause_stats": structure.pauses(x, rate),
    }
    if contour:
        at = np.arange(0, len(t.t), max(1, len(t.t) // 400))
        step = np.arange(0, len(times), max(1, len(times) // 200))
        report["pitch_contour"] = {"times_s": t.t[at].round(3).tolist(), "f0_hz": [round(float(f), 1) if v else None for f, v in zip(t.f0[at], t.voiced[at], strict=True)]}
        report["formant_track"] = {"times_s": times[step].round(3).tolist()} | {f"F{k + 1}_hz": [_known(v, 1) for v in found[step, k]] for k in range(3)}
        report["spectrogram"] = frames.spectrogram(x, rate)
    return report


def _rows(recs: DataFrame, kind: pa.StructType, make: Callable[[str, np.ndarray, int], list[dict]]) -> DataFrame:
    """Rows of make(path, samples, rate) for every readable recording, one recording at a time."""
    from pyspark.sql.pandas.types import from_arrow_schema

    ship(recs.sparkSession)
    schema = pa.schema(list(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                made = make(path.as_py(), x.values.to_numpy(zero_copy_only=False).astype(float), rate.as_py())
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema)

    good = recs.where("samples IS NOT NULL AND sample_rate > 0").select("path", "sample_rate", F.expr("filter(samples, x -> x IS NOT NULL)").alias("samples"))
    return good.mapInArrow(run, from_arrow_schema(schema))


#: A backend measures one recording: (path, samples, rate, contour, ceiling) to a dict of REPORT's fields.
Backend = Callable[[str | None, np.ndarray, int, bool, float], dict]
BACKENDS: dict[str, Backend] = {"native": measure}


def register_backend(name: str, backend: Backend) -> None:
    """Let `analyze` measure with another engine under that name, which its reports then carry."""
    BACKENDS[name] = backend


class AcousticEngine:
    """Queries over recordings: (path, sample_rate, samples, error)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        ship(spark)

    def recordings(self, root: str, target_rate: int | None = None) -> DataFrame:
        return recordings(self.spark, root, target_rate)

    def decoded(self, files: DataFrame, target_rate: int | None = None) -> DataFrame:
        return decoded(files, target_rate)

    def analyze(self, recs: DataFrame, contour: bool = False, ceiling: float = FORMANT_CEILING, backend: str = "native") -> DataFrame:
        """One report a recording. Those that could not be read, or measured, have an error and nulls."""
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend: {backend}; there are {', '.join(sorted(BACKENDS))}")
        measured = BACKENDS[backend]

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            try:
                return [measured(path, x, rate, contour, ceiling) | {"path": path, "backend": backend}]
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                return [{"path": path, "sample_rate_hz": rate, "backend": backend, "error": str(e)}]

        good = _rows(recs, REPORT, make)
        bad = recs.where("samples IS NULL").select("path", F.coalesce("error", F.lit("no samples")).alias("error"))
        return good.unionByName(bad, allowMissingColumns=True)

    def pitch_frames(self, recs: DataFrame) -> DataFrame:
        """(path, frame, t_s, f0_hz, voiced)."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            t = pitch.track(x, rate)
            return [{"path": path, "frame": i, "t_s": a, "f0_hz": b, "voiced": bool(v)} for i, (a, b, v) in enumerate(zip(t.t.tolist(), t.f0.tolist(), t.voiced, strict=True))]

        return _rows(recs, _struct(path=_S, frame=pa.int32(), t_s=_D, f0_hz=_D, voiced=_B), make)

    def periods(self, recs: DataFrame) -> DataFrame:
        """(path, k, period_s, amp) between glottal pulses."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            t = pitch.track(x, rate)
            places, amps = voice.epochs(x, rate, t.f0[t.voiced])
            return [{"path": path, "k": k, "epoch": int(places[k]), "period_s": (places[k + 1] - places[k]) / rate, "amp": float(a)} for k, a in enumerate(amps)]

        return _rows(recs, _struct(path=_S, k=pa.int32(), epoch=_I, period_s=_D, amp=_D), make)

    def formant_frames(self, recs: DataFrame, ceiling: float = FORMANT_CEILING) -> DataFrame:
        """(path, frame, t_s, energy, voiced, F1, F2, F3) at the formant rate."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            rows = zip(*formant_rows(x, rate, pitch.track(x, rate), ceiling), strict=True)
            return [{"path": path, "frame": i, "t_s": float(t), "energy": float(e), "voiced": bool(v)} | {f"F{k + 1}": _known(f[k]) for k in range(3)} for i, (t, e, v, f) in enumerate(rows)]

        return _rows(recs, _struct(path=_S, frame=pa.int32(), t_s=_D, energy=_D, voiced=_B, F1=_D, F2=_D, F3=_D), make)

    def formant_track(self, frames_: DataFrame, points: int = 200) -> DataFrame:
        """Every n-th formant frame of a recording, so that about `points` stay; unvoiced ones are null."""
        n = F.count(F.lit(1)).over(Window.partitionBy("path"))
        kept = frames_.withColumn("__step", F.greatest(F.lit(1), F.floor(n / points))).where(F.col("frame") % F.col("__step") == 0)
        return kept.select("path", F.round("t_s", 3).alias("t_s"), *[F.when(F.col("voiced"), F.round(f, 1)).alias(f) for f in ("F1", "F2", "F3")])

    def log_bands(self, recs: DataFrame) -> DataFrame:
        """(path, frame, bands): log amplitudes in 20 geometric bands."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            return [{"path": path, "frame": i, "bands": b} for i, b in enumerate(frames.log_bands(x, rate).tolist())]

        return _rows(recs, _struct(path=_S, frame=pa.int32(), bands=pa.list_(_D)), make)

    def diarize(self, recs: DataFrame, n_speakers: int = 2, max_speakers: int = 4, min_turn_s: float = 0.4) -> DataFrame:
        """(path, n_speakers, turns, speaking_time_s, note)."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            d = speakers.diarize(x, rate, n_speakers, max_speakers, min_turn_s)
            return [{"path": path, "n_speakers": d["n_speakers"], "note": d["note"], "speaking_time_s": list(d["speaking_time_s"].items()), "turns": [dict(zip(("speaker", "start_s", "end_s"), t, strict=True)) for t in d["turns"]]}]

        return _rows(recs, _struct(path=_S, n_speakers=pa.int32(), note=_S, speaking_time_s=pa.map_(pa.int32(), _D), turns=pa.list_(_struct(speaker=pa.int32(), start_s=_D, end_s=_D))), make)

    def spectrograms(self, recs: DataFrame) -> DataFrame:
        """(path, f_bin, t_bin, freq_hz, time_s, level_db), pooled."""

        def make(path: str, x: np.ndarray, rate: int) -> list[dict]:
            s = frames.spectrogram(x, rate)
            return [{"path": path, "f_bin": i, "t_bin": j, "freq_hz": s["freqs_hz"][i], "time_s": s["times_s"][j], "level_db": v} for i, row in enumerate(s["values_db"]) for j, v in enumerate(row)]

        return _rows(recs, _struct(path=_S, f_bin=pa.int32(), t_bin=pa.int32(), freq_hz=_D, time_s=_D, level_db=_D), make)

    def compare(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two one-row reports: the metrics both have, their difference, and for pitch the effect size by
        medians and, where both have contours, Welch's t with its probability. Reports without a metric in
        common give one row that says so in `error`."""
        flat = lambda r: r.select(F.col("pitch.f0_median_hz").alias("f0_median_hz"), F.col("voice_quality.jitter_local_percent").alias("jitter_percent"), F.col("voice_quality.shimmer_local_db").alias("shimmer_db"), "hnr_db")
        rows = statistics.metric_differences(flat(a), flat(b), COMPARED)
        sd = a.select(F.col("pitch.f0_std_hz").alias("sa")).crossJoin(b.select(F.col("pitch.f0_std_hz").alias("sb")))  # one row each
        pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
        effect = F.when((F.col("metric") == "f0_median_hz") & (F.col("sa") != 0) & (F.col("sb") != 0) & (pooled > 1e-9), F.col("diff_b_minus_a") / pooled)
        rows = rows.crossJoin(sd).withColumn("cohens_d", effect).drop("sa", "sb")
        contour = lambda r, g: r.select(F.lit(g).alias("g"), F.explode("pitch_contour.f0_hz").alias("f0")).where("f0 IS NOT NULL")
        welch = self.with_probability(statistics.welch(contour(a, "a").union(contour(b, "b")), "g", "f0")).select(F.lit("f0_median_hz").alias("metric"), "t", "df", "p", "n_a", "n_b")
        found = rows.join(welch, "metric", "left")
        # At most a row for each of COMPARED: the one row of range(1) stays where there is none.
        whole = self.spark.range(1).select().join(found, F.lit(True), "left")
        return whole.withColumn("error", F.when(F.col("metric").isNull(), "no metric in common"))

    def with_probability(self, tests: DataFrame, level: float = 0.05) -> DataFrame:
        """tests (t, df) with the two-sided p and whether it is under the level."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t, df = batch.column("t").to_pylist(), batch.column("df").to_pylist()
                p = [stats.t_two_sided(x, y) if x is not None and y else None for x, y in zip(t, df, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, _D), pa.array([x is not None and x < level for x in p])], names=[*batch.schema.names, "p", "significant"])

        return tests.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema) + ", p double, significant boolean")

    def f0_agreement(self, a: DataFrame, b: DataFrame, within: float = 0.005) -> DataFrame:
        """Pitch frames of two trackers: each voiced frame of a against the frame of b nearest in time.
        An unvoiced nearest frame voids the pair. Errors in Hz and cents by recording."""
        left = a.where("voiced AND f0_hz > 0").select("path", "t_s", "f0_hz")
        pairs = statistics.nearest(left, b.select("path", "t_s", "f0_hz"), ["path"], "t_s", within + 1e-9).where("b_f0_hz > 0")
        x, y = F.col("f0_hz"), F.col("b_f0_hz")
        enough = lambda c: F.when(F.count(F.lit(1)) >= 3, c)
        return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("n_frames"), enough(F.avg(F.abs(x - y))).alias("mae_hz"), enough(F.avg(F.abs(1200 * F.log2(x / y)))).alias("mae_cents"), enough(F.median(x - y)).alias("median_diff_hz"), enough(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("r"))

    def batch_rows(self, reports: DataFrame) -> DataFrame:
        """Reports flattened to one line each, issues joined, for a CSV sink."""
        r = F.round
        return reports.where("error IS NULL").select(
            "path", "duration_s", "sample_rate_hz", "backend",
            *[r(f"pitch.{c}", 3 if c == "voiced_ratio" else 1).alias(c) for c in ("voiced_ratio", "f0_mean_hz", "f0_median_hz", "f0_std_hz")],
            *[r(f"voice_quality.{c}", 3).alias(c) for c in ("jitter_local_percent", "shimmer_local_db")],
            "hnr_db",
            *[r(f"formants.F{k}_hz", 0).alias(f"F{k}_hz") for k in (1, 2, 3)],
            *[F.col(f"recording_quality.{c}").alias(c) for c in ("peak_dbfs", "clipping_ratio", "snr_db")],
            *[F.col(f"pause_stats.{c}").alias(c) for c in ("silence_ratio", "n_pauses", "articulation_rate_syl_per_s")],
            F.size("voiced_segments").alias("n_segments"),
            F.concat_ws("; ", "recording_quality.issues").alias("issues"),
        )


__all__ = ["AcousticEngine", "REPORT", "db", "measure"]
