"""Recordings through files, reports, comparisons, and a stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.engine import AcousticEngine
from phonolake.kernels import audio
from phonolake.operators import segments, store
from phonolake.sources import audio as sources
from phonolake.sources.synthetic import vowel
from phonolake.streaming import ingest

RATE = 16000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("clips")
    (root / "a").mkdir()
    (root / "a" / "one.wav").write_bytes(audio.encode(vowel(140, [500, 1500, 2500]), RATE))
    (root / "two.WAV").write_bytes(audio.encode(0.5 * np.sin(2 * np.pi * 220 * np.arange(RATE) / RATE), RATE))
    (root / "bad.wav").write_bytes(b"not audio")
    (root / "empty.wav").write_bytes(audio.encode(np.empty(0), RATE))
    (root / "notes.txt").write_text("no audio")
    return str(root)


def test_files_and_reports(spark, folder):
    engine = AcousticEngine(spark)
    assert sources.find_audio(spark, folder).count() == 4
    got = {r.path.rpartition("/")[2]: r for r in engine.analyze(engine.recordings(folder)).collect()}
    assert got["one.wav"].pitch.f0_median_hz == pytest.approx(140, rel=0.05)
    assert got["two.WAV"].pitch.f0_median_hz == pytest.approx(220, rel=0.03)
    assert got["bad.wav"].error and got["bad.wav"].pitch is None
    assert got["empty.wav"].n_samples == 0 and got["empty.wav"].formants is None
    assert got["one.wav"].backend == "native"
    with pytest.raises(ValueError):
        engine.analyze(engine.recordings(folder), backend="other")


def test_sinks(spark, folder, tmp_path):
    engine = AcousticEngine(spark)
    reports = engine.analyze(engine.recordings(folder), contour=True)
    sources.write_csv(engine.batch_rows(reports), str(tmp_path / "csv"))
    lines = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert lines.count() == 3 and "issues" in lines.columns
    sources.write_json(reports, str(tmp_path / "json"))
    for f in (tmp_path / "json").glob("*.json"):
        for line in f.read_text().splitlines():
            json.loads(line, parse_constant=lambda c: pytest.fail(c))


def test_rows_do_not_depend_on_partitions(spark, folder):
    engine = AcousticEngine(spark)
    recs = engine.recordings(folder)
    a, b = (sorted(map(tuple, engine.pitch_frames(r).collect())) for r in (recs.coalesce(1), recs.repartition(3)))
    assert a == b


def test_compare(spark, folder):
    engine = AcousticEngine(spark)
    r = engine.analyze(engine.recordings(folder), contour=True)
    rows = {x.metric: x for x in engine.compare(r.where(F.col("path").contains("one")), r.where(F.col("path").contains("two"))).collect()}
    f0 = rows["f0_median_hz"]
    assert f0.diff_b_minus_a == pytest.approx(80, abs=8) and f0.p < 0.05
    assert rows["hnr_db"].unit == "dB" and rows["hnr_db"].p is None


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        ingest.write(ingest.reports(spark, folder + "/*"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("path").distinct().count() > 0


def test_calls_in_sliding_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.calls(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "at", "user_id", 3600, 1800)
    q = stream.writeStream.format("memory").queryName("calls").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.window("at", "3600 seconds", "1800 seconds"), "user_id").count()
    assert sorted((r.window.start, r.user_id, r.calls) for r in spark.table("calls").collect()) == sorted((r.window.start, r.user_id, r["count"]) for r in want.collect())


def test_greedy_limit_ignores_refused_calls(spark):
    calls = spark.createDataFrame([("u", float(t)) for t in (0, 1, 2, 3, 60, 61, 62)], "k string, t double")
    got = sorted(store.accepted(calls, ["k"], "t", 2, 60.0).collect(), key=lambda r: r.t)
    assert [r.ok for r in got] == [True, True, False, False, False, True, True]


def test_turns_fold(spark):
    t = spark.sql("SELECT array(named_struct('speaker', 1, 'start', 0.0D, 'end', 1.0D), named_struct('speaker', 2, 'start', 1.0D, 'end', 1.2D), named_struct('speaker', 1, 'start', 1.2D, 'end', 3.0D)) AS t")
    (row,) = t.select(segments.folded_turns(F.col("t"), 0.4).alias("t")).collect()
    assert [tuple(x) for x in row.t] == [(1, 0.0, 3.0)]


def test_bad_file_lists_are_empty(spark):
    m = spark.createDataFrame([(2, "c", "[\"a\"]"), (1, "c", "{oops"), (3, "d", None)], "id long, conversation_id string, files string")
    assert [(r.id, r.files) for r in store.messages_of(m, "c").collect()] == [(1, []), (2, ["a"])]


def test_ownership_needs_a_user(spark):
    c = spark.createDataFrame([("c", "u")], "id string, user_key string")
    m = spark.createDataFrame([("c", 1)], "conversation_id string, n long")
    assert store.owned(m, c, "u").count() == 1 and store.owned(m, c, None).count() == 0 and store.owned(m, c, "v").count() == 0


def test_sql_functions(spark):
    from phonolake.functions.sql import register
    from phonolake.sources.synthetic import voices

    register(spark)
    voices(spark, 3).createOrReplaceTempView("recs")
    rows = spark.sql("SELECT path, analyze_report(samples, sample_rate) AS r, speaker_turns(samples, sample_rate, 2) AS t, analyze_report(NULL, 8000) AS none FROM recs").collect()
    assert len(rows) == 3 and all(90 * 0.9 < r.r.pitch.f0_median_hz < 280 * 1.1 and r.t and r.none is None for r in rows)
    assert spark.sql("SELECT * FROM norms WHERE metric = 'snr_db'").count() == 1


def test_another_backend_can_be_registered(spark, folder):
    from phonolake import engine as module

    def loudest(path, x, rate, contour, ceiling):
        return {"n_samples": len(x), "sample_rate_hz": rate, "hnr_db": float(np.abs(x).max()) if len(x) else None}

    module.register_backend("loudest", loudest)
    try:
        e = AcousticEngine(spark)
        got = {r.path.rpartition("/")[2]: r for r in e.analyze(e.recordings(folder), backend="loudest").collect()}
    finally:
        del module.BACKENDS["loudest"]
    assert got["two.WAV"].backend == "loudest" and got["two.WAV"].hnr_db == pytest.approx(0.5, abs=0.01) and got["two.WAV"].pitch is None


def test_reports_without_a_common_metric_say_so(spark, folder):
    e = AcousticEngine(spark)
    reports = e.analyze(e.recordings(folder), contour=True)
    pick = lambda name: reports.where(F.col("path").endswith(name))
    (row,) = e.compare(pick("one.wav"), pick("empty.wav")).collect()
    assert row.metric is None and row.error
    rows = e.compare(pick("one.wav"), pick("two.WAV")).collect()
    assert len(rows) > 1 and not any(r.error for r in rows)


def test_recordings_are_compared_in_sql(spark):
    from phonolake.functions.sql import register

    register(spark)
    tone = lambda hz: (0.5 * np.sin(2 * np.pi * hz * np.arange(RATE) / RATE)).tolist()
    spark.createDataFrame([(tone(150), RATE, tone(200), RATE), (None, RATE, tone(200), RATE)], "a array<double>, ra int, b array<double>, rb int").createOrReplaceTempView("couples")
    rows = [r.c for r in spark.sql("SELECT compare_recordings(a, ra, b, rb) AS c FROM couples ORDER BY a IS NULL").collect()]
    by = {m.metric: m for m in rows[0]}
    assert by["f0_median_hz"].diff_b_minus_a == pytest.approx(50, abs=3) and by["f0_median_hz"].unit == "Hz" and rows[1] is None


def test_summaries_are_written_as_json_and_markdown(spark, tmp_path):
    table = spark.createDataFrame([("f0", 3, 1.23456, None), ("hnr", 5, -2.0, 0.5)], "metric string, n long, bias double, r double")
    sources.write_summary(table, str(tmp_path / "s"), "Trackers")
    lines = [r.value for r in spark.read.text(str(tmp_path / "s" / "markdown")).collect()]
    assert lines == ["# Trackers", "", "| metric | n | bias | r |", "|-|-|-|-|", "| f0 | 3 | 1.235 | – |", "| hnr | 5 | -2.000 | 0.500 |"]
    assert {r.metric: r.bias for r in spark.read.json(str(tmp_path / "s" / "json")).collect()} == {"f0": 1.23456, "hnr": -2.0}


def test_conditions_come_to_their_numbers(spark):
    from phonolake.sources import synthetic

    rows = [(f"x/{s}_read_a{n:04d}.wav", RATE, (0.3 * np.sin(np.arange(1600) / (5 + n))).tolist(), None) for s in synthetic.SPEAKERS for n in range(1, 26)]
    recs = spark.createDataFrame(rows, sources.RECORDINGS).repartition(4)
    made = synthetic.complete(synthetic.derived(recs)).select("path", "sample_rate", "part", F.size("samples").alias("n")).collect()
    kinds = lambda tag: [r for r in made if tag in r.path]
    assert (len(made), len({r.path for r in made})) == (110, 110)
    assert (len(kinds("sr44k")), len(kinds("sr22k")), len(kinds("snr")), len(kinds("sr8k"))) == (5, 5, 10, 10)
    assert all(r.sample_rate == 8000 and r.n == 800 and r.part == "telephony" for r in kinds("sr8k")) and all(r.n == 4410 for r in kinds("sr44k"))
    with pytest.raises(ValueError, match="expected"):
        synthetic.complete(synthetic.derived(recs.limit(50)))


def test_turns_fold_alike_as_arrays_and_as_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for rec in range(30):
        t = 0.0
        for k in range(int(rng.integers(1, 12))):
            length = float(rng.integers(1, 10)) / 10
            rows.append((rec, k, int(rng.integers(0, 3)), round(t, 1), round(t + length, 1)))
            t += length
    turns = spark.createDataFrame(rows, "rec int, k int, speaker int, start double, end double")
    want = []
    for rec in range(30):
        kept = []
        for _, _, s, a, b in (r for r in rows if r[0] == rec):
            if kept and b - a < 0.4:
                kept[-1][2] = b
            else:
                kept.append([s, a, b])
        merged = []
        for s, a, b in kept:
            if merged and merged[-1][0] == s:
                merged[-1][2] = b
            else:
                merged.append([s, a, b])
        want += [(rec, i, *m) for i, m in enumerate(merged)]
    assert sorted(map(tuple, segments.merged_turns(turns, ["rec"], "k", 0.4).collect())) == want
    arrays = turns.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("speaker", "start", "end").alias("t")))).alias("x"))
    folded = arrays.select("rec", F.posexplode(segments.folded_turns(F.col("x.t"), 0.4)).alias("turn", "t")).select("rec", "turn", "t.*")
    assert sorted(map(tuple, folded.collect())) == want


def test_nearest_keeps_repeated_rows(spark):
    from phonolake.operators.statistics import nearest

    a = spark.createDataFrame([("p", 1.0, None), ("p", 1.0, None), ("p", 9.0, 3), ("q", 1.0, 1)], "path string, t double, x int")
    b = spark.createDataFrame([("p", 0.8, 1), ("p", 1.2, 2), ("p", 1.2, 2), ("q", 1.4, 7)], "path string, t double, y int")
    got = sorted(nearest(a, b, ["path"], "t", 0.5).collect())
    assert [(r.path, r.t, r.b_t, r.b_y) for r in got] == [("p", 1.0, 1.2, 2), ("p", 1.0, 1.2, 2), ("q", 1.0, 1.4, 7)]


def test_bands_of_a_spectrum_are_the_kernels(spark):
    from phonolake.kernels import frames
    from phonolake.operators import signal

    x = vowel(140, [500, 1500, 2500], seconds=0.025)
    length = frames.lengths(RATE)[0]
    power = np.square(np.abs(np.fft.rfft(frames.frames(x, *frames.lengths(RATE))[0] * np.hanning(length))))
    table = spark.createDataFrame([(0, k, float(p)) for k, p in enumerate(power)], "rec int, bin int, power double")
    got = [r.level for r in signal.log_bands(table, RATE, length).orderBy("band").collect()]
    assert got == pytest.approx(frames.log_bands(x, RATE)[0].tolist())
