"""Recordings as DataFrames: WAVE files in, reports and tables out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.kernels import audio

#: File name endings that count as audio. Fixed values.
EXTENSIONS = ("wav", "wave", "flac", "mp3", "ogg")
RECORDINGS = "path string, sample_rate int, samples array<double>, error string"


def find_audio(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, length) of audio files under root, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS)).orderBy("path")
    return files.limit(limit) if limit else files


def recordings(spark: SparkSession, root: str, target_rate: int | None = None) -> DataFrame:
    """Every audio file under root, decoded to mono; what cannot be read has an error instead of samples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS))
    return decoded(files.select("path", "content"), target_rate)


def decoded(files: DataFrame, target_rate: int | None = None) -> DataFrame:
    """Recordings of files (path, content)."""

    def one(path: str, content: bytes | None) -> tuple:
        try:
            rate, x = audio.decode(content or b"")
            if target_rate and target_rate != rate:
                rate, x = target_rate, audio.to_rate(x, rate, target_rate)
            return path, rate, x, None
        except audio.BadAudio as e:
            return path, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one recording at a time
                row = one(path, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.list_(pa.float64())), pa.array([row[3]], pa.string())], names=["path", "sample_rate", "samples", "error"])

    return files.mapInArrow(run, RECORDINGS)


def file_info(files: DataFrame) -> DataFrame:
    """(path, duration_s, sample_rate, n_samples, error) from headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    _, channels, rate, bits, _, size = audio.header(content)
                    n = size // max(1, channels * bits // 8)
                    rows.append((path, n / rate, rate, n, None))
                except audio.BadAudio as e:
                    rows.append((path, None, None, None, str(e)))
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "duration_s", "sample_rate", "n_samples", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, duration_s double, sample_rate int, n_samples long, error string")


def encoded(signals: DataFrame) -> DataFrame:
    """(path, content): recordings as 16-bit WAVE files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                made = audio.encode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0), rate.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([made], pa.binary())], names=["path", "content"])

    return signals.select("path", "sample_rate", "samples").mapInArrow(run, "path string, content binary")


def write_csv(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").option("header", True).csv(path)


def write_json(reports: DataFrame, path: str) -> None:
    """One JSON object a line; undefined values are null."""
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(summary: DataFrame, path: str, title: str = "Agreement") -> None:
    """A table of few rows (one for each metric) as JSON lines under path/json and as a Markdown table
    under path/markdown; undefined values are dashes there."""
    write_json(summary.coalesce(1), f"{path}/json")
    shown = [F.coalesce(F.format_number(f.name, 3) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string"), F.lit("–")) for f in summary.schema]
    head = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    lines = summary.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "at int, value string")
    rows = summary.select(F.lit(len(head)).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("value"))
    lines.unionByName(rows).coalesce(1).sortWithinPartitions("at", "value").select("value").write.mode("overwrite").text(f"{path}/markdown")
