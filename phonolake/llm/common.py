"""Shared pieces: table access, lineage cuts in the shared folder, safe column names."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, in Java and RE2 syntax.
SPACE = r"[\x20\x09-\x0D]"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if driver and tasks are
    one process, as in tests; elsewhere executors would not see each other's files, so it is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="phonolake-")
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files live until the session's process ends; a lost executor costs at
    most the tasks of the step at hand, never this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phonolake/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


#: Rows that go to Python at once where they are whole texts.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python BATCH_ROWS rows at a time at most: an executor holds a batch
    several times over, and a Python worker keeps the room of its largest."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def release(made: DataFrame) -> None:
    """Delete a table that `materialize` wrote, once all that reads it is written itself."""
    spark, path = made.sparkSession, made._written_to
    _delete(spark, path)
    _written.remove((spark, path))


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written already."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/phonolake/{uuid.uuid4().hex}/{tag}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch space
            return


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: send it along unless PYTHONPATH already has it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    made = Path(tempfile.mkdtemp(prefix="phonolake-")) / f"{__name__.partition('.')[0]}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((root / "phonolake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(made))
    _shipped.add(context.applicationId)


def column(df: DataFrame, name: str) -> Column:
    """df's column of that name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


#: Rows that one step of `repeated` makes at most.
SPREAD = 10_000


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column n says, without n; no long array is ever built."""
    steps = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SPREAD))).alias("__step"))
    some = F.least(F.lit(SPREAD).cast("long"), F.col(n) - F.col("__step") * SPREAD)
    return steps.select("*", F.explode(F.sequence(F.lit(1).cast("long"), some)).alias("__one")).drop(n, "__step", "__one")


def text_key(text: Column) -> Column:
    """64-bit content key of a text; with doc_id it names a row, and repeated rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))))
