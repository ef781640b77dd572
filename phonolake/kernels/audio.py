"""RIFF/WAVE bytes to samples and back, and rational resampling."""

from __future__ import annotations

import math
import struct

import numpy as np

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class BadAudio(ValueError):
    """Bytes that are not a WAVE file this module reads."""


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(format tag, channels, rate, bits, first byte of the samples, their number of bytes)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise BadAudio("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            if len(data) < at + 24:
                raise BadAudio("a cut header")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag == EXTENSIBLE and size >= 26 and len(data) >= at + 34:
                tag = struct.unpack_from("<H", data, at + 32)[0]
            fmt = tag, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise BadAudio("samples before their format")
            return *fmt, at + 8, min(size, len(data) - at - 8)
        at += 8 + size + (size & 1)
    raise BadAudio("no samples")


def pcm(raw: bytes, bits: int, tag: int = PCM) -> np.ndarray:
    """Samples in [-1, 1]: 8 bits unsigned, 16 to 32 signed little-endian, floats as they are."""
    if tag == FLOAT and bits in (32, 64):
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    if tag != PCM:
        raise BadAudio(f"compressed audio (format {tag})")
    if bits == 8:
        return np.frombuffer(raw, np.uint8) / 128.0 - 1.0
    if bits in (16, 32):
        return np.frombuffer(raw, f"<i{bits // 8}") / float(1 << bits - 1)
    if bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return wide.view("<i4").ravel() / float(1 << 31)  # the low byte is empty
    raise BadAudio(f"{bits}-bit samples")


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples): channels are averaged."""
    tag, channels, rate, bits, at, size = header(data)
    if not channels or not rate:
        raise BadAudio("no channel or no rate")
    frame = channels * (bits // 8)
    if not frame:
        raise BadAudio(f"{bits}-bit samples")
    x = pcm(data[at : at + size // frame * frame], bits, tag)
    return rate, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def encode(x: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAVE file of samples clipped to [-1, 1]."""
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate, through a Kaiser-windowed sinc."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return np.asarray(x, dtype=np.float64)
    most = max(up, down)
    half = 10 * most
    taps = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, 5.0)
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    return _convolve(spread, taps * (up / taps.sum()))[half::down][: -(-len(x) * up // down)]


def to_rate(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    return resample(x, target, rate)


def formant_rate(rate: int, ceiling: float) -> tuple[int, int]:
    """(up, down) that bring a rate to twice the ceiling: exactly where that is cheap, else by whole
    decimation to at most 2 % above; (1, 1) if the rate is not higher."""
    target = 2.0 * ceiling
    if rate <= target:
        return 1, 1
    g = math.gcd(rate, round(target))
    up, down = round(target) // g, rate // g
    if up <= 64:
        return up, down
    return 1, next(d for d in range(max(1, round(rate / target)), rate + 1) if rate / d <= 1.02 * target)


def add_noise(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """x with Gaussian noise at that signal-to-noise ratio."""
    rms = math.sqrt(float(np.mean(np.square(x)))) if len(x) else 0.0
    return x + np.random.default_rng(seed).normal(0.0, rms / 10 ** (snr_db / 20), len(x))
