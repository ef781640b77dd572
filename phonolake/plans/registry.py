"""Queries of the acoustic engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.operators import segments, statistics
from phonolake.plans import queries, recordings

QUERIES = queries.QUERIES | recordings.QUERIES
ORACLE_SQL = queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: the longest, the variability of the values, and its grade."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    longest = segments.longest(segments.islands(events, ["user_id"], "t", 3_600_000_000, ["t", "event_id"], 0), ["user_id"])
    shimmer = statistics.shimmer(events, ["user_id"], ["t", "event_id"], "value")
    graded = statistics.graded(shimmer.withColumn("metric", F.lit("shimmer_db")), statistics.norms(events.sparkSession), "metric", "shimmer_local_db")
    return longest.join(graded.drop("metric"), "user_id", "left").orderBy("user_id")
