"""The engine's tools as SQL functions and views."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from phonolake import engine
from phonolake.kernels import speakers
from phonolake.operators import statistics

_TURNS = pa.list_(pa.struct([("speaker", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


_COMPARED = pa.list_(pa.struct([("metric", pa.string()), ("a", pa.float64()), ("b", pa.float64()), ("diff_b_minus_a", pa.float64()), ("unit", pa.string())]))


def _metrics(report: dict) -> dict[str, float | None]:
    quality = report["voice_quality"]
    return dict(zip(engine.COMPARED, (report["pitch"].get("f0_median_hz"), quality["jitter_local_percent"], quality["shimmer_local_db"], report["hnr_db"]), strict=True))


def register(spark: SparkSession) -> None:
    """analyze_report(samples, rate), compare_recordings(samples, rate, samples, rate),
    speaker_turns(samples, rate, speakers), and the view norms."""
    engine.ship(spark)

    def report(x: pa.Array, rate: pa.Array) -> pa.Array:
        made = [engine.measure(None, v.values.to_numpy(zero_copy_only=False).astype(float), r.as_py(), False, engine.FORMANT_CEILING) if v.is_valid and r.is_valid else None for v, r in zip(x, rate, strict=True)]
        return pa.array(made, engine.REPORT)

    def compared(x: pa.Array, rx: pa.Array, y: pa.Array, ry: pa.Array) -> pa.Array:
        made = []
        for pair in zip(x, rx, y, ry, strict=True):
            if not all(v.is_valid for v in pair):
                made.append(None)
                continue
            one, two = (_metrics(engine.measure(None, v.values.to_numpy(zero_copy_only=False).astype(float), r.as_py(), False, engine.FORMANT_CEILING)) for v, r in (pair[:2], pair[2:]))
            made.append([{"metric": m, "a": one[m], "b": two[m], "diff_b_minus_a": two[m] - one[m], "unit": unit} for m, unit in engine.COMPARED.items() if one[m] is not None and two[m] is not None])
        return pa.array(made, _COMPARED)

    def turns(x: pa.Array, rate: pa.Array, n: pa.Array) -> pa.Array:
        made = []
        for v, r, k in zip(x, rate, n, strict=True):
            found = speakers.diarize(v.values.to_numpy(zero_copy_only=False).astype(float), r.as_py(), k.as_py() or 0)["turns"] if v.is_valid and r.is_valid else None
            made.append(found and [dict(zip(("speaker", "start_s", "end_s"), t, strict=True)) for t in found])
        return pa.array(made, _TURNS)

    spark.udf.register("analyze_report", F.arrow_udf(report, from_arrow_type(engine.REPORT)))
    spark.udf.register("compare_recordings", F.arrow_udf(compared, from_arrow_type(_COMPARED)))
    spark.udf.register("speaker_turns", F.arrow_udf(turns, from_arrow_type(_TURNS)))
    statistics.norms(spark).createOrReplaceTempView("norms")
