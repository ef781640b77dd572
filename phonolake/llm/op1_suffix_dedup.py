"""Exact substring dedup by per-shard suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts elsewhere.
Where strings can be equal is settled first, over all texts: a text's windows
fall into blocks by their anchors (see suffixes.py), only block digests travel,
and a block whose anchor hash stands alone cannot repeat. Of the rest, a block
that occurs whole twice repeats in all its windows. Distinct blocks under one
anchor go, once each, to shards of about SHARD_BYTES, where a suffix array and
its common prefixes show the windows that two blocks share. An anchor with more
than SPLIT distinct blocks is dealt over several shards; each then hands on one
digest for every window it holds, sorted, and the shards' runs are merged by
binary search, so that windows shared across shards are found too.

A row is known by hashes of its key and its text, 128 bits together. Blocks and
windows compare by digests of 128 bits (an anchor's 64 and a block's 64, or
XXH3-128); strings inside a shard compare byte by byte.

Defined results: a null text is empty; texts under `length` bytes are kept
whole; repeated rows are other rows, so equal texts of `length` bytes or more
lose all; an empty table gives an empty result; columns other than the key and
the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import op9_paragraphs
from phonolake.llm.common import column, materialize, release, ship, table, text_key
from phonolake.llm.suffixes import BATCH_BYTES, common_prefixes, packed, suffix_array, texts_of, window_blocks

LENGTH = 400
#: Words of the passages that the query tells of beside what it removes.
WORDS = 51
SHARD_BYTES = 1 << 20
#: Distinct blocks of an anchor in one shard.
SPLIT = 2048
#: A block's place and number of windows share a long; blocks have at most `length` windows.
_COUNT_BITS = 10


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """(r1, r2, anchor, digest, place) of every window block of rows (r1, r2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2):
            ends = np.cumsum([len(t) for t in texts])
            starts, count, anchor, digest = window_blocks(np.frombuffer(b"".join(texts), np.uint8), ends, length)
            row = np.searchsorted(ends, starts, "right")
            place = (starts - np.concatenate(([0], ends))[row]) << _COUNT_BITS | count
            ids = [part.column(i).take(pa.array(row)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (anchor, digest, place))], names=["r1", "r2", "anchor", "digest", "place"])

    return rows.mapInArrow(run, "r1 long, r2 long, anchor long, digest long, place long")


class Shard:
    """Distinct blocks of whole (anchor, deal) groups, and the windows that they share."""

    def __init__(self, length: int) -> None:
        self.length, self.size = length, 0
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[-1]) + 1

    def shared(self) -> tuple[np.ndarray, ...]:
        """For every window: its block's number, its place in the block, its group's number, the
        group's size. Windows of one group are equal."""
        texts = [r[-1] for r in self.rows]
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 2
        ends = np.cumsum([len(t) + 1 for t in texts])
        symbols[ends - 1] = 1
        key, depth = packed(symbols, 9)
        sa = suffix_array(key, depth)
        lcp = common_prefixes(symbols, key, depth, sa)
        block = np.searchsorted(ends, sa, "right")
        inside = sa - (ends[block] - np.array([len(t) + 1 for t in texts])[block])
        whole = sa + self.length < ends[block]  # the window ends before the block does
        at = np.flatnonzero(whole)
        if not len(at):
            return at, at, at, at
        least = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))  # over the suffixes between windows
        new = least < self.length
        new[0] = True
        group = np.cumsum(new) - 1
        return block[at], inside[at], group, np.bincount(group)[group]

    def rows_out(self) -> Iterator[dict]:
        """Runs of repeated windows in blocks that occur once; for dealt anchors, runs of one window of
        each group with the windows' digests."""
        block, inside, group, size = self.shared()
        if not len(block):
            return
        once = np.array([r[6] == 1 for r in self.rows])
        dealt = np.array([r[7] > 1 for r in self.rows])
        own = np.flatnonzero(once[block] & (size > 1))
        for b, start, count in _runs(block[own], inside[own]):
            yield self._span(b, start, count, None, True)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sure = np.logical_or.reduceat(~once[block] | (size > 1), first)
        for known in (False, True):
            at = first[(sure == known) & dealt[block[first]]]
            for b, start, count in _runs(block[at], inside[at]):
                text = self.rows[b][-1]
                digests = b"".join(xxhash.xxh3_128_digest(text[i : i + self.length]) for i in range(start, start + count))
                yield self._span(b, start, count, digests, known)

    def _span(self, b: int, start: int, count: int, windows: bytes | None, sure: bool) -> dict:
        _, _, r1, r2, place = self.rows[b][:5]
        return {"r1": r1, "r2": r2, "start": (place >> _COUNT_BITS) + start, "count": count, "windows": windows, "sure": sure}


def _runs(block: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, first place, number) of neighbouring windows."""
    if not len(block):
        return
    order = np.lexsort((inside, block))
    block, inside = block[order], inside[order]
    new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (inside[1:] != inside[:-1] + 1))))
    yield from zip(block[new].tolist(), inside[new].tolist(), np.diff(np.append(new, len(block))).tolist(), strict=True)


_SHARED = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("windows", pa.binary()), ("sure", pa.bool_())])


def shared_windows(held: DataFrame, length: int) -> DataFrame:
    """Shards over held (anchor, deal, r1, r2, place, digest, n, deals, text), which comes grouped by (anchor, deal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(length), None

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(shard.rows_out()) if shard.rows else []
            for low in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_pylist(out[low : low + 100_000], _SHARED)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last and shard.size >= SHARD_BYTES:
                    yield from flush()
                    shard = Shard(length)
                last = row[:2]
                shard.add(row)
        yield from flush()

    return held.mapInArrow(run, "r1 long, r2 long, start long, count long, windows binary, sure boolean")


def merged(digests: DataFrame) -> DataFrame:
    """(r1, r2, start, count) of windows, not sure yet, whose digest another shard has too.

    Each task holds a range of digests from all shards' sorted runs; a window's
    fellows are found by binary search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            w = np.array(t["window"].to_pylist(), dtype="S16")
            cut = int(np.searchsorted(w, w[-1], "left"))  # the last digest may go on
            yield from search(t.slice(0, cut), w[:cut])
            carry = t.slice(cut)
        if carry is not None:
            yield from search(carry, np.array(carry["window"].to_pylist(), dtype="S16"))

    def search(t: pa.Table, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        fellows = np.searchsorted(w, w, "right") - np.searchsorted(w, w, "left")
        found = t.filter(pa.array((fellows > 1) & ~np.array(t["sure"], dtype=bool))) if len(w) else t
        yield from found.select(["r1", "r2", "start", "count"]).combine_chunks().to_batches()

    spread = digests.repartition(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = F.transform(F.sequence(F.lit(0), F.col("count").cast("int") - 1), lambda i: F.substring(F.col("windows"), i * 16 + 1, F.lit(16)))
    each = spread.select("r1", "r2", "start", "sure", F.posexplode(each).alias("i", "window"))
    each = each.select("r1", "r2", (F.col("start") + F.col("i")).alias("start"), F.lit(1).cast("long").alias("count"), "window", "sure")
    return each.repartition("window").sortWithinPartitions("window").mapInArrow(run, "r1 long, r2 long, start long, count long")


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(r1, r2, start, count): runs of windows of docs (r1, r2, text) that occur elsewhere too."""
    every = materialize(blocks(docs, length), "blocks")
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1")
    # A table of its own, so that the join below may split a crowded anchor.
    shared = materialize(shared.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    found = materialize(every.join(shared, "anchor"), "shared")
    release(every)
    counts = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "place")).alias("at"), F.first("mixed").alias("mixed"))
    counts = materialize(counts, "counts")
    again = found.select("r1", "r2", "place", "anchor", "digest").join(counts.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    windows = lambda p: ((F.shiftright(p, _COUNT_BITS)).alias("start"), p.bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)).cast("long").alias("count"))
    sure = again.select("r1", "r2", *windows(F.col("place")))
    # Anchors whose blocks differ, and of which some block is not known to repeat yet.
    mixed = materialize(counts.where("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("least = 1"), "mixed")
    wanted = counts.join(mixed, "anchor").select("anchor", "digest", "n", F.ceil(F.col("kinds") / SPLIT).alias("deals"), "at.*")
    wanted = wanted.select("r1", "r2", F.struct("place", "anchor", "digest", "n", "deals").alias("block")).groupBy("r1", "r2").agg(F.collect_set("block").alias("blocks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "deal", "r1", "r2", "place", "digest", "n", "deals", "text"]
        for batch in batches:
            rows, size = [], 0
            for r1, r2, text, held in zip(*batch.select(["r1", "r2", "text", "blocks"]).columns, strict=True):
                data, r1, r2 = text.as_buffer().to_pybytes(), r1.as_py(), r2.as_py()
                for b in held.as_py():
                    start, count = b["place"] >> _COUNT_BITS, b["place"] & ((1 << _COUNT_BITS) - 1)
                    rows.append((b["anchor"], b["digest"] % b["deals"], r1, r2, b["place"], b["digest"], b["n"], b["deals"], data[start : start + count + length - 1]))
                    size += len(rows[-1][-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)

    kinds = pa.schema([*((n, pa.int64()) for n in ("anchor", "deal", "r1", "r2", "place", "digest", "n", "deals")), ("text", pa.binary())])
    held = docs.join(wanted, ["r1", "r2"]).select("r1", "r2", "text", "blocks").mapInArrow(cut, "anchor long, deal long, r1 long, r2 long, place long, digest long, n long, deals long, text binary")
    held = held.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal", "digest")
    shards = materialize(shared_windows(held, length), "windows")
    inside = shards.where("windows IS NULL").select("r1", "r2", "start", "count")
    return sure.union(materialize(inside.union(merged(shards.where("windows IS NOT NULL"))), "inside"))


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, r2 (its text's key), n_bytes, the removed spans (start, end) in bytes, and the
    kept bytes' SHA-256."""
    ship(docs.sparkSession)
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), F.xxhash64(column(docs, key)).alias("r1"), text_key(t).alias("r2"), t.alias("text"))
    runs = repeats(rows.select("r1", "r2", "text"), length)
    runs = runs.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 1):
            made = [_kept(data, held.as_py() or [], length) for data, held in zip(texts, part.column(2), strict=True)]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), sizes, pa.array([m[0] for m in made], spans), pa.array([m[1] for m in made], pa.string())], names=["doc_id", "r2", "n_bytes", "spans", "kept_sha256"])

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    joined = rows.join(runs, ["r1", "r2"], "left").select("doc_id", "text", "runs", "r2")
    return joined.mapInArrow(run, f"doc_id {kind}, r2 long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def _kept(data: bytes, runs: list[dict], length: int) -> tuple[list[dict], str]:
    """The removed spans, and the digest of what stays."""
    spans: list[dict] = []
    for a, b in sorted((r["start"], r["start"] + r["count"] + length - 1) for r in runs):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b})
    digest, at = hashlib.sha256(), 0
    for s in spans:
        digest.update(data[at : s["start"]])
        at = s["end"]
    digest.update(data[at:])
    return spans, digest.hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal at 400 bytes; and, as that is 60 words or more in most languages, how many windows a
    document has that tell of passages of WORDS words in other rows, however few bytes these are."""
    docs = table(spark, sf_dir, "documents")
    shared = op9_paragraphs.windows_shared(docs, WORDS).select(F.col("doc_id").alias("key1"), F.col("r2").alias("key2"), "n")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    found = dedup(docs).join(shared, F.col("doc_id").eqNullSafe(F.col("key1")) & (F.col("r2") == F.col("key2")), "left")
    windows = F.coalesce("n", F.lit(0)).cast("long").alias("n_shared_windows")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", windows)
