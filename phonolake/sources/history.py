"""A history of conversations and measurements kept as append-only Parquet tables.

Every change is a row with the time it was logged; nothing is rewritten. Views
take the latest version of a key and leave out what a later tombstone covers.
Rows lie in BUCKETS folders by a hash of their key, so what is asked of one key
reads one folder. Writers append batches; readers see whole files only.

Many small appends leave many small files: `compact` writes what a table still
says as a new generation, a file for each bucket, which readers take once it is
complete. Appends made meanwhile go to the generation before and would be lost,
so a table has no other writer while it is compacted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.operators import store

SCHEMAS = {
    "conversations": "id string, user_key string, title string, created_at double, updated_at double, deleted boolean, logged long",
    "messages": "id long, conversation_id string, role string, content string, files string, created_at double, logged long",
    "measurements": "user_key string, ts double, file string, f0 double, jitter double, shimmer double, hnr double, cleared boolean, logged long",
}
#: The column that a table's rows are dealt by.
KEYS = {"conversations": "id", "messages": "conversation_id", "measurements": "user_key"}
BUCKETS = 16


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class History:
    """The tables under root, and the operations on them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for name in SCHEMAS:
            if not self._generations(name):
                self._write(self.spark.createDataFrame([], SCHEMAS[name]), name, f"{self.root}/{name}/generation=0")

    def _generations(self, name: str) -> list[int]:
        """Numbers of the complete generations, in order."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/generation=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])

    def _place(self, name: str) -> str:
        return f"{self.root}/{name}/generation={self._generations(name)[-1]}"

    def _write(self, rows: DataFrame, name: str, path: str) -> None:
        rows.withColumn("bucket", bucket(F.col(KEYS[name]))).write.mode("append").partitionBy("bucket").parquet(path)

    def _append(self, name: str, rows: Iterable[tuple]) -> None:
        made = self.spark.createDataFrame([(*r, time.time_ns()) for r in rows], SCHEMAS[name])
        self._write(made.coalesce(1), name, self._place(name))

    def log(self, name: str, key: str | None = None) -> DataFrame:
        """A table's rows, or those of one key from the folder that has them."""
        every = self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(self._place(name))
        if key is not None:
            every = every.where((F.col("bucket") == bucket(F.lit(key))) & (F.col(KEYS[name]) == key))
        return every.drop("bucket")

    def compact(self, name: str) -> None:
        """Write what the table still says as its next generation, a file for each bucket."""
        log = self.log(name)
        if name == "conversations":
            log = store.latest(log, "id", "logged").select(log.columns)  # tombstones stay: messages ask for them
        elif name == "messages":
            log = self._of_live(log)
        else:
            log = self._uncleared(log).select(log.columns)
        rows = log.repartition(BUCKETS, bucket(F.col(KEYS[name])))
        self._write(rows, name, f"{self.root}/{name}/generation={self._generations(name)[-1] + 1}")

    def _of_live(self, messages: DataFrame) -> DataFrame:
        live = store.latest(self.log("conversations"), "id", "logged").where("NOT deleted").select(F.col("id").alias("__live"))
        return messages.join(live, F.col("conversation_id") == F.col("__live"), "left_semi")

    def _uncleared(self, log: DataFrame) -> DataFrame:
        cleared = log.where("cleared").groupBy(F.col("user_key").alias("__user")).agg(F.max("logged").alias("__at"))
        kept = log.where("NOT cleared").join(cleared, F.col("user_key") == F.col("__user"), "left")
        return kept.where("__at IS NULL OR logged > __at").drop("__user", "__at")

    def conversations(self) -> DataFrame:
        """Live conversations; updated_at follows their messages."""
        live = store.latest(self.log("conversations"), "id", "logged").where("NOT deleted").drop("deleted", "logged")
        return store.touched(live, self.log("messages"))

    def messages(self) -> DataFrame:
        """Messages of live conversations."""
        return self._of_live(self.log("messages")).drop("logged")

    def measurements(self) -> DataFrame:
        """Measurements logged after their user last cleared them."""
        return self._uncleared(self.log("measurements")).drop("cleared", "logged")

    def create(self, user: str, title: str, at: float | None = None) -> str:
        name, now = uuid.uuid4().hex[:12], time.time() if at is None else at
        self._append("conversations", [(name, user, title[:80], now, now, False)])
        return name

    def _current(self, conversation: str):
        return store.latest(self.log("conversations", conversation), "id", "logged").where("NOT deleted").first()

    def owner(self, conversation: str) -> str | None:
        found = self._current(conversation)
        return found.user_key if found else None

    def touch(self, conversation: str, title: str | None = None, at: float | None = None) -> bool:
        """Set updated_at, and the title if one is given; False if there is no such conversation."""
        found = self._current(conversation)
        if found:
            self._append("conversations", [(conversation, found.user_key, (title or found.title)[:80], found.created_at, time.time() if at is None else at, False)])
        return bool(found)

    def delete(self, conversation: str) -> None:
        """The conversation and its messages."""
        found = self._current(conversation)
        if found:
            self._append("conversations", [(conversation, found.user_key, found.title, found.created_at, found.updated_at, True)])

    def listed(self, user: str, limit: int = 30) -> DataFrame:
        return store.listed(self.conversations(), user, limit)

    def add_messages(self, conversation: str, messages: Iterable[tuple[str, str, list[str]]], at: float | None = None) -> None:
        """Append (role, content, files) in order."""
        now = time.time() if at is None else at
        self._append("messages", [(time.time_ns() + k, conversation, role, content, json.dumps(files), now) for k, (role, content, files) in enumerate(messages)])

    def messages_of(self, conversation: str, limit: int = 200) -> DataFrame:
        if self._current(conversation) is None:
            return store.messages_of(self.log("messages", conversation).drop("logged").limit(0), conversation, limit)
        return store.messages_of(self.log("messages", conversation).drop("logged"), conversation, limit)

    def exchange(self, user: str, conversation: str | None, question: str, answer: str, files: list[str] = ()) -> str:
        """Append a question and its answer, to a new conversation if this one is not the user's."""
        if not conversation or self.owner(conversation) != user:
            conversation = self.create(user, question)
        self.add_messages(conversation, [("user", question, list(files)), ("assistant", answer, [])])
        return conversation

    def measure(self, rows: DataFrame, now: float | None = None) -> DataFrame:
        """Append the good ones of string rows (user_key, ts, file, f0, jitter, shimmer, hnr); the others come back."""
        judged = store.checked(rows, time.time() if now is None else now, ["f0", "jitter", "shimmer", "hnr"])
        good = judged.where("ok").select("user_key", "ts", F.substring("file", 1, 200).alias("file"), "f0", "jitter", "shimmer", "hnr", F.lit(False).alias("cleared"), F.lit(time.time_ns()).alias("logged"))
        self._write(good, "measurements", self._place("measurements"))
        return judged.where("NOT ok")

    def measurements_of(self, user: str, limit: int = 500) -> DataFrame:
        mine = self._uncleared(self.log("measurements", user)).drop("cleared", "logged")
        return store.measurements_of(mine, user, limit)

    def clear(self, user: str) -> None:
        self._append("measurements", [(user, None, None, None, None, None, None, True)])
