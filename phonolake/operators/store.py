"""Conversations, messages and measurements as append-only tables with views.

Updates are later rows, deletions are tombstones; a view is a latest-row
aggregation or an anti join.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.operators import ranks


def new_id() -> Column:
    """Twelve hexadecimal digits."""
    return F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12)


def created(rows: DataFrame, at: Column) -> DataFrame:
    """Conversation rows to append from (user_key, title)."""
    return rows.select(new_id().alias("id"), "user_key", F.substring("title", 1, 80).alias("title"), at.alias("created_at"), at.alias("updated_at"))


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last version of each key."""
    others = [c for c in log.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at])).alias("v")
    return log.groupBy(key).agg(best).select(key, *[F.col(f"v.{c}").alias(c) for c in others])


def touched(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations whose updated_at follows their last message."""
    last = messages.groupBy(F.col("conversation_id").alias("__id")).agg(F.max("created_at").alias("__last"))
    joined = conversations.join(last, F.col("id") == F.col("__id"), "left")
    return joined.withColumn("updated_at", F.greatest("updated_at", "__last")).drop("__id", "__last")


def listed(conversations: DataFrame, user: str, limit: int = 30) -> DataFrame:
    return conversations.where(F.col("user_key") == user).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def owned(rows: DataFrame, conversations: DataFrame, user: str | None) -> DataFrame:
    """Rows of conversations that the user owns; none without a user."""
    own = conversations.where(F.col("user_key") == F.lit(user)).select(F.col("id").alias("__id"))
    return rows.join(own, F.col("conversation_id") == F.col("__id"), "left_semi")


def messages_of(messages: DataFrame, conversation: str, limit: int = 200) -> DataFrame:
    """The first messages, files as an array; unreadable JSON is no files."""
    files = F.coalesce(F.from_json("files", "array<string>"), F.array().cast("array<string>"))
    return messages.where(F.col("conversation_id") == conversation).withColumn("files", files).orderBy("id").limit(limit)


def without(rows: DataFrame, deleted: DataFrame, key: str, gone: str) -> DataFrame:
    """Rows whose key has no tombstone."""
    return rows.join(deleted.select(F.col(gone).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def measurements_of(rows: DataFrame, user: str, limit: int = 500) -> DataFrame:
    """The user's oldest measurements."""
    return rows.where(F.col("user_key") == user).orderBy("ts", "file").limit(limit)


def checked(rows: DataFrame, now: float, fields: list[str]) -> DataFrame:
    """Measurement rows of strings with `ok`: fields are numbers or absent, and ts lies in (0, now + 300];
    a missing ts is now."""
    ts = F.col("ts").try_cast("double")
    stamped = F.when(F.col("ts").isNull(), F.lit(now)).otherwise(ts)
    good = stamped.isNotNull() & ~F.isnan(stamped) & (stamped > 0) & (stamped <= now + 300)
    for f in fields:
        good = good & (F.col(f).isNull() | (F.col(f).try_cast("double").isNotNull() & ~F.isnan(F.col(f).try_cast("double"))))
    out = rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("ts", stamped)
    for f in fields:
        out = out.withColumn(f, F.col(f).try_cast("double"))
    return out


def trimmed(history: DataFrame, by: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """History cut to a budget of characters. The first message stays. The rest is kept from the latest
    user turn (not the last message) at which the sum from the end, with the first message, passes the
    budget; if what stays is over one and a half budgets, only the first and the last message do.
    Histories within the budget, or of two messages, stay whole."""
    w = Window.partitionBy(by)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = history.withColumn("__size", size).withColumn("__head", F.col(turn) == F.min(turn).over(w)).withColumn("__last", F.max(turn).over(w))
    back = F.sum("__size").over(w.orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__back", back + F.sum(F.when(F.col("__head"), F.col("__size"))).over(w))
    over = ~F.col("__head") & (F.col("__back") > budget) & (F.col(role) == "user") & (F.col(turn) < F.col("__last"))
    rows = rows.withColumn("__cut", F.max(F.when(over, F.col(turn))).over(w))
    rows = rows.withColumn("__whole", (F.sum("__size").over(w) <= budget) | (F.count(F.lit(1)).over(w) <= 2))
    rows = rows.withColumn("__kept", F.col("__whole") | F.col("__head") | F.col("__cut").isNull() | (F.col(turn) >= F.col("__cut")))
    tail = ~F.col("__whole") & (F.sum(F.when(F.col("__kept"), F.col("__size"))).over(w) > 1.5 * budget)
    rows = rows.withColumn("__tail", tail)
    return rows.where(F.when(F.col("__tail"), F.col("__head") | (F.col(turn) == F.col("__last"))).otherwise(F.col("__kept"))).select(*history.columns)


def in_window(events: DataFrame, by: list[str], at: str, seconds: float) -> DataFrame:
    """events with the number in the trailing window, themselves included; older than it is out."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-int(seconds), 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


def accepted(events: DataFrame, by: list[str], at: str, limit: int, seconds: float) -> DataFrame:
    """Which events a limiter lets pass when refused ones do not count: by, at, ok. Each verdict depends
    on those before it, so keys stream through in order; what is held is a window's accepted times."""
    keyed = events.select(*by, F.col(at).cast("double").alias(at))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, deque()
        for batch in batches:
            verdicts = []
            for *own, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, held = own, deque()
                while held and t - held[0] > seconds:
                    held.popleft()
                verdicts.append(len(held) < limit)
                if verdicts[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.bool_())], names=[*batch.schema.names, "ok"])

    return keyed.repartition(*by).sortWithinPartitions(*by, at).mapInArrow(run, f"{kinds}, ok boolean")


def running(rows: DataFrame, by: list[str], order: list[str], size: str, quota: int) -> DataFrame:
    """rows with what their group has used up to them, and whether that is within the quota."""
    return ranks.running_sum(rows, by, order, size, "used").withColumn("within", F.col("used") <= quota)


def uploads(rows: DataFrame, by: list[str], order: list[str], size: str, quota: int) -> DataFrame:
    """rows (by, order, size) with `taken`: an upload that would pass the quota is refused and does not
    count. Each verdict depends on those before it, so keys stream through in order."""
    keyed = rows.select(*by, *order, F.col(size).cast("long").alias(size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, 0
        for batch in batches:
            verdicts = []
            for *own, n in zip(*(batch.column(i).to_pylist() for i in (*range(len(by)), batch.num_columns - 1)), strict=True):
                if own != key:
                    key, used = own, 0
                verdicts.append(used + (n or 0) <= quota)
                used += (n or 0) if verdicts[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.bool_())], names=[*batch.schema.names, "taken"])

    return keyed.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{kinds}, taken boolean")


def distinct_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each content: its digest, the smallest key, and how many rows have it."""
    return rows.groupBy(F.md5(F.col(content).cast("binary")).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def most_recent(sessions: DataFrame, key: str, at: str, limit: int = 64) -> DataFrame:
    """The sessions that stay when only `limit` may: a top-k, not a global window."""
    last = sessions.groupBy(key).agg(F.max(at).alias("last_used"))
    return last.orderBy(F.col("last_used").desc(), key).limit(limit)
