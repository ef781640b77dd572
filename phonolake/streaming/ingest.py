"""New recordings as they arrive: a file stream into reports, and sliding counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phonolake.engine import AcousticEngine
from phonolake.sources.audio import decoded

_FILES = "path string, modificationTime timestamp, length long, content binary"


def reports(spark: SparkSession, root: str, per_trigger: int = 64) -> DataFrame:
    """A stream of reports on the files that appear under root."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.wav").load(root)
    return AcousticEngine(spark).analyze(decoded(files.select("path", "content")))


def write(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, each file once, across restarts too."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def calls(events: DataFrame, at: str, by: str, seconds: int = 60, slide: int = 10, late: int = 60) -> DataFrame:
    """Calls of each key in sliding windows, with a watermark for late rows."""
    window = F.window(at, f"{seconds} seconds", f"{slide} seconds")
    return events.withWatermark(at, f"{late} seconds").groupBy(window.alias("window"), by).agg(F.count(F.lit(1)).alias("calls"))
