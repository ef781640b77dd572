"""Numerics against closed forms."""

import math

import numpy as np
import pytest

from phonolake.kernels import audio, frames, pitch, speakers, stats, structure, voice
from phonolake.sources.synthetic import resonator, vowel

RATE = 16000
T = np.arange(RATE) / RATE


def tone(hz, amp=0.5, seconds=1.0, rate=RATE):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("hz", [85, 120, 220, 330])
def test_tone_pitch(hz):
    t = pitch.track(tone(hz), RATE)
    assert np.median(t.f0[t.voiced]) == pytest.approx(hz, rel=0.03)


def test_noise_is_unvoiced():
    assert pitch.track(np.random.default_rng(7).normal(0, 0.3, RATE), RATE).voiced.mean() < 0.15


def test_silence_and_short_input():
    assert not pitch.track(np.zeros(RATE), RATE).voiced.any()
    assert structure.pauses(np.zeros(100), RATE) is None
    assert structure.quality(np.empty(0), RATE)["issues"] == ["empty file"]


def test_pitch_of_alternating_pulses_is_the_subharmonic():
    x = np.zeros(RATE)
    x[::133] = np.resize([1.0, 2.0], len(x[::133]))
    t = pitch.track(resonator(x, 730, 80, RATE), RATE)
    assert np.median(t.f0[t.voiced]) < 80


def test_vowel_pitch_and_first_formants():
    x = vowel(140, [500, 1500, 2500])
    t = pitch.track(x, RATE)
    assert np.median(t.f0[t.voiced]) == pytest.approx(140, rel=0.05)
    jitter, shimmer, n = voice.perturbation(x, RATE, t)
    assert 0 <= jitter < 2 and 0 <= shimmer < 1 and n > 100


def test_perturbation_follows_the_signal():
    read = lambda **k: voice.perturbation(x := vowel(120, [700, 1200, 2500], seed=3, **k), RATE, pitch.track(x, RATE))
    steady, shaky, loud = read(), read(jitter=0.02), read(shimmer=0.15)
    assert shaky[0] > steady[0] + 0.5
    assert loud[1] > steady[1] + 0.5


def test_shimmer_takes_sizes_before_averaging():
    assert voice.shimmer_db(np.tile([1.0, 2.0], 10), None) == pytest.approx(6.0206, abs=0.01)
    assert math.isnan(voice.shimmer_db(np.tile([1.0, 2.0], 10)))
    assert voice.shimmer_db(np.linspace(0.5, 1.0, 100)) < 0.5


def test_jitter_ignores_unsteady_pairs():
    assert math.isnan(voice.jitter_percent(np.array([1.0, 2.0, 1.0])))
    assert voice.jitter_percent(np.array([1.0, 1.1, 1.0])) == pytest.approx(100 * 0.1 / np.mean([1.0, 1.1, 1.0]))


def test_tone_is_harmonic():
    x = tone(200)
    assert voice.harmonicity(x, RATE, pitch.track(x, RATE)) > 15


@pytest.mark.parametrize("poles", [[500.0, 1500.0], [730.0, 1090.0, 2440.0]])
def test_predictor_finds_poles(poles):
    rng = np.random.default_rng(1)
    x = 0.1 * rng.standard_normal(RATE)
    a = np.array([1.0])
    for hz in poles:
        a = np.convolve(a, [1.0, -2 * 0.97 * np.cos(2 * np.pi * hz / RATE), 0.97**2])
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = x[i] - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    roots = np.roots(np.concatenate(([1.0], voice.predictor(y[1600:] * np.hanning(len(y) - 1600), 2 * len(poles)))))
    found = np.sort(np.angle(roots[roots.imag > 0]) * RATE / (2 * np.pi))
    assert found == pytest.approx(poles, rel=0.03)
    assert np.abs(roots).max() == pytest.approx(0.97, abs=0.03)


@pytest.mark.parametrize("rate", [8000, 16000, 22050, 44100, 48000])
def test_formant_rates(rate):
    up, down = audio.formant_rate(rate, 5500)
    assert rate * up // down == {8000: 8000, 16000: 11000, 22050: 11025, 44100: 11025, 48000: 11000}[rate]


def test_resampling_keeps_a_tone():
    y = audio.resample(np.sin(2 * np.pi * 4000 * np.arange(48000) / 48000), 11, 48)
    assert len(y) == 11000
    assert y[1000:-1000].std() * math.sqrt(2) == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize(("bits", "tag"), [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
def test_sample_formats(bits, tag):
    import struct

    x = tone(200)
    if tag == 3:
        body = x.astype("<f4").tobytes()
    elif bits == 8:
        body = np.round(x * 128 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = np.round(x * (1 << 23)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.round(x * ((1 << bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    two = np.frombuffer(body, np.uint8).reshape(len(x), -1).repeat(2, axis=0).tobytes()  # the same on both channels
    data = b"RIFF" + struct.pack("<I", 36 + len(two)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 2, RATE, 0, 0, bits) + b"data" + struct.pack("<I", len(two)) + two
    rate, y = audio.decode(data)
    assert rate == RATE and np.abs(y - x).max() < 1 / (1 << min(bits, 24) - 2)


@pytest.mark.parametrize("data", [b"", b"RIFFxxxxWAVE", b"ID3 not a wave", audio.encode(np.zeros(4), 8000)[:30]])
def test_bad_files(data):
    with pytest.raises(audio.BadAudio):
        audio.decode(data)


def test_frames_are_centred_and_counted():
    assert frames.frames(np.arange(1000.0), 400, 160).shape == (1 + 1000 // 160, 400)
    assert frames.frames(np.ones(5), 400, 160).shape == (1, 400)
    assert frames.level(np.array([0.0, 1.0, 10.0])).tolist() == [-120, 0, 10]
    assert frames.lengths(44100) == (1102, 441) and frames.lengths(22050) == (551, 220)


def test_segments_merge_short_gaps():
    mask = np.ones(200, bool)
    mask[100:105] = False
    t = pitch.Track(np.arange(200) * 0.01, np.full(200, 100.0), mask)
    assert len(structure.voiced_segments(t)) == 1
    short = np.zeros(200, bool)
    short[10:20] = True
    assert structure.voiced_segments(pitch.Track(t.t, t.f0, short)) == []


def test_clipping_needs_a_run():
    x = tone(200)
    assert structure.quality(np.where(np.arange(RATE) == 5, 1.0, x), RATE)["clipping_ratio"] == 0
    x[100:110] = 1.0
    assert structure.quality(x, RATE)["clipping_ratio"] == pytest.approx(10 / RATE, abs=1e-5)


def test_bursts_have_two_pauses():
    x = np.zeros(3 * RATE)
    for s in (0.0, 0.8, 1.7):
        n = int(0.3 * RATE)
        x[int(s * RATE) : int(s * RATE) + n] = np.hanning(n) * tone(150, 1.0, 0.3)
    p = structure.pauses(x, RATE)
    assert p["n_pauses"] == 2 and p["silence_ratio"] > 0.4 and p["syllable_est"] >= 3


def test_energetic_frames():
    assert sorted(voice.energetic(np.arange(20.0), np.ones(20, bool))) == list(range(10, 20))
    assert sorted(voice.energetic(np.arange(7.0), np.ones(7, bool))) == [2, 3, 4, 5, 6]
    assert len(voice.energetic(np.arange(7.0), np.zeros(7, bool))) == 0


def test_linkage_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((24, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[i] for i in range(24)]
    while len(groups) > 3:
        _, a, b = min((d[np.ix_(g, h)].mean(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    label = speakers.cut(speakers.average_linkage(d), 24, 3)
    assert sorted(map(sorted, groups)) == sorted(np.flatnonzero(label == k).tolist() for k in range(3))


def test_two_voices():
    a, b = tone(150) + tone(2500, 0.2), tone(300) + tone(900, 0.4)
    d = speakers.diarize(np.concatenate([a, b]), RATE)
    assert d["n_speakers"] == 2 and [t[0] for t in d["turns"]] == [0, 1]
    assert speakers.diarize(np.zeros(100), RATE)["note"]


@pytest.mark.parametrize("n", [2, 30, 150])
def test_linkage_of_vectors_is_that_of_their_distances(n):
    x = np.random.default_rng(n).standard_normal((n, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = speakers.average_linkage(1 - x @ x.T), speakers.cosine_linkage(x)
    assert np.allclose(np.sort(a[:, 2]), np.sort(b[:, 2]))
    assert all((speakers.cut(a, n, k) == speakers.cut(b, n, k)).all() for k in range(1, min(n, 6)))


def test_long_recordings_have_speakers():
    voice = lambda *tones: np.sum([tone(f, a, 35.0) for f, a in tones], axis=0)
    x = np.concatenate([voice((150, 0.5), (2500, 0.2)), voice((300, 0.5), (900, 0.4))])
    x += 0.01 * np.random.default_rng(0).standard_normal(len(x))
    d = speakers.diarize(x, RATE)
    assert d["note"] is None and d["n_speakers"] == 2
    assert [t[0] for t in d["turns"]] == [0, 1] and d["turns"][1][1] == pytest.approx(35, abs=0.2)


def test_student_t():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(0, 5) == 1
