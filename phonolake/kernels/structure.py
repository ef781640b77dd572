"""Segments, pauses and recording checks of one signal."""

from __future__ import annotations

import numpy as np

from phonolake.kernels.frames import level, lengths, power
from phonolake.kernels.pitch import Track
from phonolake.kernels.voice import smooth


def voiced_segments(pitch: Track, least: float = 0.3, gap: float = 0.1) -> list[tuple[float, float]]:
    """Stretches of voiced frames never more than gap apart, `least` seconds long at least."""
    t = pitch.t[pitch.voiced]
    if not len(t):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(t) > gap)))
    last = np.append(first[1:], len(t)) - 1
    return [(round(float(a), 3), round(float(b), 3)) for a, b in zip(t[first], t[last], strict=True) if b - a >= least]


def run_edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of True, and the places after their ends."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def quality(x: np.ndarray, rate: int) -> dict:
    """Peak, clipping, signal-to-noise by percentiles, and what they warn of."""
    if not len(x):
        return {"peak_dbfs": -120.0, "clipping_ratio": 0.0, "snr_db": None, "issues": ["empty file"]}
    peak = float(level(np.abs(x).max() ** 2)) if np.abs(x).max() > 0 else -120.0
    start, end = run_edges(np.abs(x) >= 0.999)
    clipped = int((end - start)[end - start >= 3].sum())
    db = level(power(x, *lengths(rate)))
    low, high = np.percentile(db, [10, 90]) if len(db) else (0.0, 0.0)
    snr = round(float(high - low), 1) if high - low >= 6.0 else None
    checks = ((clipped > 0, "clipping"), (peak < -30.0, "too quiet"), (snr is not None and snr < 20.0, "low SNR"))
    return {"peak_dbfs": round(peak, 1), "clipping_ratio": round(clipped / len(x), 5), "snr_db": snr, "issues": [text for bad, text in checks if bad]}


def prominences(y: np.ndarray, look: int = 12) -> np.ndarray:
    """How far each value stands over the higher valley on its sides, in parts of itself."""
    padded = np.pad(y, look, constant_values=np.inf)
    windows = np.lib.stride_tricks.sliding_window_view(padded, look + 1).min(axis=1)
    valley = np.maximum(windows[: len(y)], windows[look : look + len(y)])
    return np.where(y > 0, (y - valley) / np.where(y > 0, y, 1), 0.0) if len(y) >= 3 else np.zeros(len(y))


def pauses(x: np.ndarray, rate: int, least: float = 0.2, below: float = 32.0) -> dict | None:
    """Speech time, pauses between speech, and syllables as peaks of the envelope; None under a quarter second."""
    if len(x) < rate // 4:
        return None
    hop = lengths(rate)[1]
    step = hop / rate
    db = level(power(x, *lengths(rate)))
    speech = db > db.max() - below
    start, end = run_edges(~speech)
    inner = (start > 0) & (end < len(db))
    found = [round(float(n * step), 3) for n in (end - start)[inner] if n * step >= least]
    seconds = float(speech.sum() * step)
    y = smooth(10 ** (db / 20), max(3, round(0.05 / step) | 1))
    peaks = np.flatnonzero((y[1:-1] >= y[:-2]) & (y[1:-1] > y[2:])) + 1
    peaks = peaks[speech[peaks] & (y[peaks] > 0.25 * y.max()) & (prominences(y)[peaks] >= 0.5)]
    apart, count, last = max(1, round(0.12 / step)), 0, -(10**9)
    for p in peaks:
        if p - last >= apart:
            count, last = count + 1, p
    return {
        "speech_s": round(seconds, 2),
        "silence_ratio": round(1.0 - float(speech.mean()), 3),
        "n_pauses": len(found),
        "pause_total_s": round(sum(found), 2),
        "pause_mean_s": round(sum(found) / len(found), 3) if found else 0.0,
        "pause_max_s": max(found, default=0.0),
        "syllable_est": count,
        "articulation_rate_syl_per_s": round(count / seconds, 2) if seconds > 0.2 else None,
    }
