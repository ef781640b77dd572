"""Substring dedup: MinHash banding over paragraph windows.

Repeated passages stand inside lines as often as on lines of their own, so the
paragraphs compared are windows of PARAGRAPH words, wherever they begin; two are
alike from SIMILARITY on, the Jaccard similarity of their sets of five-word
shingles. No window is laid out or handed on by itself:

Bands. A band is the least shingle hash of a run of neighbouring shingles, the
run's MinHash. Alike windows share so many of their 21 shingles (19 at 0.8) that a
changed word can only stand among their outermost ones; so they share a run of
that many neighbouring shingles (`common_run`; this holds for windows that repeat
no three words), and the run's least shingle is its band in both. With a band for
every run, then, all alike windows collide: the bands' recall is 1, and
neighbouring runs mostly have the same least shingle, so that a text has about one
band in ten words. A similarity that lets a word inside change is refused.

Join. Only bands that two rows have go on. What stands around a band's shingle as
far as such runs reach is the band's context; equal contexts collapse to one row
before anything meets, and bands with two different contexts have these fetched
from the texts, once for each context.

Verification. Two contexts are alike if some run around the band's shingle is the
same in both, word by word (128-bit digests of the words): then windows around it
share 19 of at most 23 shingles. That takes a sort of the runs, not a comparison
of pairs, so a crowded band costs in proportion to its contexts. A band with over
SPLIT different contexts is not brought together at all: its runs are grouped
across the cluster and `components` follows them.

Components of alike contexts are the classes; the smallest key of a class keeps
its passage, all others lose it. A passage's span is the union of its shared runs.

Defined results: a null text is empty; texts under PARAGRAPH words have no
window; all windows of equal texts repeat; repeated rows (key and text) are one
row, whose passages are listed once; a null key comes last; an empty table gives an empty result; texts of any length are taken whole;
columns other than the key and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import column, drop_shuffles, materialize, release, ship, small_batches, table, text_key
from phonolake.llm.graph import components
from phonolake.llm.op2_simhash import join
from phonolake.llm.suffixes import mixed, sliding_min, span_hashes, texts_of, word_hashes

PARAGRAPH = 25
SHINGLE = 5
SIMILARITY = 0.8
#: Different contexts of a band that one task compares.
SPLIT = 1 << 14
#: Words among which bands are looked for at once.
CHUNK = 1 << 20
#: Bytes of text, or of contexts, handled at once: their runs take some ten times that.
BATCH_BYTES = 1 << 20
_HALF = 32


def common_run(similarity: float) -> int:
    """Neighbouring shingles that two alike windows share at least."""
    own = PARAGRAPH - SHINGLE + 1
    shared = math.ceil(2 * similarity * own / (1 + similarity) - 1e-9)
    if own - shared >= SHINGLE:
        raise ValueError(f"at similarity {similarity} a word inside a window may differ")
    return shared


def _anchors(shingles: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Places of shingles that hash least, leftmost on ties, among some `run` neighbours of their
    text. doc has each word's text."""
    found, bits = [np.empty(0, np.int64)], np.uint64(21)
    for low in range(0, len(shingles) - run + 1, CHUNK):
        part = shingles[low : low + CHUNK + run - 1]
        keyed = part >> bits << bits | np.arange(len(part), dtype=np.uint64)
        first = np.arange(low, low + len(part) - run + 1)
        inside = doc[first] == doc[first + run + SHINGLE - 2]
        place = sliding_min(keyed, run)[inside] & np.uint64((1 << 21) - 1)
        found.append(np.unique(place).astype(np.int64) + low)
    return np.unique(np.concatenate(found))


def bands(data: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end, a line end after each, ending at ends: the bands' texts (by number),
    first bytes in the whole, bytes of context before and from there on, hashes, and contexts' digests."""
    start, stop, words = word_hashes(data)
    doc = np.searchsorted(ends, start, "right")
    first, last = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    n = max(0, len(words) - SHINGLE + 1)
    at = np.arange(n)
    shingles = span_hashes(words, at, at + SHINGLE)
    at = _anchors(shingles, doc, run)
    at = at[last[at] - first[at] >= PARAGRAPH]
    left, right = np.maximum(first[at], at - (run - 1)), np.minimum(last[at], at + run - 1 + SHINGLE)
    gaps = mixed(np.append(start[1:] - stop[:-1], 0).astype(np.uint64) + np.uint64(1))
    # Equal contexts are so to the byte, but for letter case and the kind of white space.
    digest = mixed(span_hashes(words, left, right) ^ mixed(span_hashes(gaps, left, right - 1) + (at - left).astype(np.uint64)))
    return doc[at], start[at], start[at] - start[left], stop[right - 1] - start[at], shingles[at].view(np.int64), digest.view(np.int64)


def banded(rows: DataFrame, run: int) -> DataFrame:
    """(doc_id, r2, place, span, band, ctx) of every band of rows (doc_id, r2, text): place is the first
    byte, span the bytes of context before and from there on, a half each, ctx the context's digest."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2, BATCH_BYTES):
            ends = np.cumsum([len(t) + 1 for t in texts])
            doc, first, before, after, band, ctx = bands(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), ends, run)
            place = first - np.concatenate(([0], ends))[doc]
            ids = [part.column(i).take(pa.array(doc)) for i in (0, 1)]
            made = [pa.array(np.ascontiguousarray(c)) for c in (place, before << _HALF | after, band, ctx)]
            yield pa.RecordBatch.from_arrays([*ids, *made], names=["doc_id", "r2", "place", "span", "band", "ctx"])

    return rows.mapInArrow(work, f"doc_id {kind}, r2 long, place long, span long, band long, ctx long")


def _runs(texts: list[bytes], offs: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """For contexts and the places of their bands' shingles: every run around these, as the context's
    number, the run's shingles before the band's, two digests, and first and end bytes from there."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, stop, words = word_hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    doc = np.searchsorted(ends, start, "right")
    own = np.arange(len(texts))
    low, high = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
    anchor = np.searchsorted(start, ends - [len(t) + 1 for t in texts] + offs)
    size = run + SHINGLE - 1
    who, back = np.repeat(own, run), np.tile(np.arange(run), len(texts))
    first = anchor[who] - back
    inside = (first >= low[who]) & (first + size <= high[who])
    who, back, first = who[inside], back[inside], first[inside]
    digests = [span_hashes(w, first, first + size).view(np.int64) for w in (words, mixed(words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))]
    zero = start[anchor[who]]
    return who, back, *digests, start[first] - zero, stop[first + size - 1] - zero


def _linked(band: np.ndarray, ctx: np.ndarray, own: np.ndarray, offs: np.ndarray, texts: list[bytes], run: int) -> tuple[np.ndarray, ...]:
    """For contexts of whole bands, sorted by ctx in each: those that repeat (own) or are alike others,
    with the ctx of their component's first, and first and end bytes of what is shared."""
    who, back, d1, d2, low, high = _runs(texts, offs, run)
    order = np.lexsort((who, d2, d1, back, band[who]))
    who, back, d1, d2, low, high = (c[order] for c in (who, back, d1, d2, low, high))
    same = (band[who[1:]] == band[who[:-1]]) & (back[1:] == back[:-1]) & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
    head = join(np.arange(len(ctx)), who[:-1][same], who[1:][same])
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    first, end = np.where(own, -offs, 0), np.where(own, np.array([len(t) for t in texts]) - offs, 0)
    np.minimum.at(first, who[shared], low[shared])
    np.maximum.at(end, who[shared], high[shared])
    some = own.copy()
    some[who[shared]] = True
    return band[some], ctx[some], ctx[head[some]], first[some], end[some]


def _batched(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """band, ctx, own, offs, texts of some rows at a time, each context once; whole bands if asked for."""
    rows, size, last = [], 0, None

    def packed() -> tuple:
        band, ctx, own, offs, texts = zip(*rows, strict=True)
        return np.array(band, np.int64), np.array(ctx, np.int64), np.array(own, bool), np.array(offs, np.int64), list(texts)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] == last:  # repeated rows hand in a context twice
                continue
            if rows and size >= BATCH_BYTES and (not whole or row[0] != last[0]):
                yield packed()
                rows, size = [], 0
            last = row[:2]
            rows.append(row)
            size += len(row[4])
    if rows:
        yield packed()


def alike(held: DataFrame, run: int) -> DataFrame:
    """(band, ctx, class_id, first, end) of the contexts in held (band, ctx, own, off, text, n) that
    repeat or are alike others of their band."""
    names = ["band", "ctx", "head", "first", "end"]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batched(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _linked(*group, run)], names=names)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, ctx, _, offs, texts in _batched(batches, False):
            who, *made = _runs(texts, offs, run)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (band[who], ctx[who], *made)], names=["band", "ctx", "back", "d1", "d2", "first", "end"])

    slim = held.select("band", "ctx", "own", "off", "text")
    placed = slim.where(F.col("n") <= SPLIT).repartition("band").sortWithinPartitions("band", "ctx")
    found = placed.mapInArrow(small, "band long, ctx long, head long, first long, end long")
    found = found.select("band", "ctx", F.xxhash64("band", "head").alias("class_id"), "first", "end")
    crowded = held.where(F.col("n") > SPLIT)
    if not crowded.limit(1).count():
        return found
    runs = materialize(crowded.select(slim.columns).sortWithinPartitions("band", "ctx").mapInArrow(large, "band long, ctx long, back long, d1 long, d2 long, first long, end long"), "runs")
    by = ["band", "back", "d1", "d2"]
    again = materialize(runs.groupBy(*by).agg(F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("low <> high").drop("high"), "again")
    shared = materialize(runs.join(again, by).select("band", "ctx", "low", "first", "end"), "shared_runs")
    node = F.xxhash64("band", "ctx")
    label = components(shared.select(node.alias("a"), F.xxhash64("band", "low").alias("b")))
    whole = crowded.where("own").select("band", "ctx", (-F.col("off")).alias("first"), (F.octet_length("text") - F.col("off")).alias("end"))
    parts = shared.select("band", "ctx", "first", "end").unionByName(whole).groupBy("band", "ctx").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    far = parts.join(label, node == F.col("node"), "left").select("band", "ctx", F.coalesce("label", node).alias("class_id"), "first", "end")
    return found.unionByName(far)


def _contexts(rows: DataFrame, wanted: DataFrame, run: int) -> DataFrame:
    """(band, ctx, own, off, text, n) of wanted contexts (r1, r2, place, band, ctx, own, n)."""
    grouped = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("place", "span", "band", "ctx", "own", "n")).alias("held"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 0, BATCH_BYTES):
            out = []
            for data, held in zip(texts, part.column(1).to_pylist(), strict=True):
                for w in held:
                    before, after = w["span"] >> _HALF, w["span"] & (1 << _HALF) - 1
                    out.append((w["band"], w["ctx"], w["own"], before, data[w["place"] - before : w["place"] + after], w["n"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["band", "ctx", "own", "off", "text", "n"])

    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64())
    return rows.join(grouped, ["r1", "r2"]).select("text", "held").mapInArrow(cut, "band long, ctx long, own boolean, off long, text binary, n long")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, r2, held) for each row with a passage that another row has too: held lists
    (start, end, class_id, kept_in), in bytes; r2 is the text's key."""
    spark, run = docs.sparkSession, common_run(similarity)
    ship(spark)
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), text_key(t).alias("r2"), t.alias("text"))
    r1 = F.xxhash64("doc_id")
    row = F.xxhash64(r1, "r2")
    # Tables of their own, so that the joins with them may split a crowded band, context or class.
    with small_batches(spark):
        every = materialize(banded(rows, run), "bands")
    again = every.groupBy("band").agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low <> high").select("band")
    again = materialize(again, "repeated")
    drop_shuffles(spark)
    shared = materialize(every.join(again, "band"), "shared")
    release(every)
    drop_shuffles(spark)
    found = shared.groupBy("band", "ctx").agg(F.min(F.struct(r1.alias("r1"), "r2", "place", "span")).alias("at"), F.min(row).alias("low"), F.max(row).alias("high"), F.min("doc_id").alias("kept_in"))
    found = materialize(found.select("band", "ctx", "at.*", "low", "high", "kept_in"), "contexts")
    drop_shuffles(spark)
    kinds = materialize(found.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "kinds")
    before, after = F.shiftright("span", _HALF), F.col("span").bitwiseAND(F.lit((1 << _HALF) - 1))
    # A band's only context is in two rows at least; of several, those that are alike are to be found.
    single = found.join(kinds.where("n = 1").select("band"), "band")
    single = single.select("band", "ctx", F.xxhash64("band", "ctx").alias("class_id"), (-before).alias("first"), after.alias("end"), "kept_in")
    wanted = found.join(kinds.where("n > 1"), "band").select("r1", "r2", "place", "span", "band", "ctx", (F.col("low") != F.col("high")).alias("own"), "n")
    with small_batches(spark):
        held = materialize(_contexts(rows.select(r1.alias("r1"), "r2", "text"), wanted, run), "held")
    drop_shuffles(spark)
    linked = materialize(alike(held, run), "linked")
    release(held)
    drop_shuffles(spark)
    named = materialize(linked.join(found.select("band", "ctx", "low", "high", "kept_in"), ["band", "ctx"]), "named")
    kept = named.groupBy("class_id").agg(F.min("kept_in").alias("kept_in"), F.min("low").alias("low"), F.max("high").alias("high"))
    kept = materialize(kept.where("low <> high").select("class_id", "kept_in"), "classes")
    named = named.drop("kept_in").join(kept, "class_id").select(single.columns)
    labels = materialize(single.unionByName(named), "labels")
    release(found)
    drop_shuffles(spark)
    placed = shared.select("doc_id", "r2", "place", "band", "ctx").join(labels, ["band", "ctx"])
    span = F.struct((F.col("place") + F.col("first")).alias("start"), (F.col("place") + F.col("end")).alias("end"), "class_id", "kept_in")
    out = materialize(placed.groupBy("doc_id", "r2").agg(F.sort_array(F.collect_set(span)).alias("held")), "passages")
    release(shared)
    release(labels)
    drop_shuffles(spark)
    return out


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Passages that occur in more than one row: doc_id, r2 (the text's key), start and end in bytes,
    class_id, kept_in (the key that keeps the class), removed."""
    held = passages(docs, key, text, similarity)
    return held.select("doc_id", "r2", F.inline("held")).withColumn("removed", ~F.col("doc_id").eqNullSafe(F.col("kept_in")))


def windows_shared(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, r2, n) of the rows that share windows with others: windows of (words + 6) / 2 words, laid
    where the least shingle of any `words` words begins and where it ends, and told apart by 64-bit
    digests. Whatever rows share a passage of `words` words share such a window."""
    ship(docs.sparkSession)
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), text_key(t).alias("r2"), t.alias("text"))
    kind, size = rows.schema["doc_id"].dataType.simpleString(), (words + SHINGLE + 1) // 2

    def laid(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, _, found = word_hashes(data)
        doc = np.searchsorted(ends, start, "right")
        at = np.arange(max(0, len(found) - SHINGLE + 1))
        at = _anchors(span_hashes(found, at, at + SHINGLE), doc, words - SHINGLE + 1)
        left = np.unique(np.concatenate((at, at + SHINGLE - size)))
        left = left[(left >= 0) & (left + size <= len(found))]
        left = left[doc[left] == doc[left + size - 1]]
        return doc[left], span_hashes(found, left, left + size).view(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2):
            doc, digest = laid(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.cumsum([len(t) + 1 for t in texts]))
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(doc)) for i in (0, 1)), pa.array(digest)], names=["doc_id", "r2", "digest"])

    every = materialize(rows.mapInArrow(work, f"doc_id {kind}, r2 long, digest long"), "windows")
    row = F.xxhash64("doc_id", "r2")
    # A table of its own, so that the join with it may split a crowded window.
    again = materialize(every.groupBy("digest").agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low <> high").select("digest"), "again")
    found = materialize(every.join(again, "digest").groupBy("doc_id", "r2").agg(F.count(F.lit(1)).alias("n")), "windows_shared")
    release(every)
    drop_shuffles(docs.sparkSession)
    return found


def covered(spans: str) -> Column:
    """Bytes under sorted spans (start, end), overlaps once."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n")),
        lambda acc: acc["n"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(table(spark, sf_dir, "documents"))


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: how many passages and bytes repeat, how many passages go, its
    smallest class, all its classes, and the documents that keep its passages. Documents without
    repeated passages have zeros, no smallest class and empty lists."""
    found = passages(docs, key, text, similarity)
    gone = F.size(F.filter("held", lambda h: ~h["kept_in"].eqNullSafe(F.col("doc_id"))))
    found = found.select(
        F.col("doc_id").alias("key1"),
        F.col("r2").alias("key2"),
        F.size("held").alias("n"),
        gone.alias("gone"),
        covered("held").alias("bytes"),
        F.array_sort(F.array_distinct("held.class_id")).alias("classes"),
        F.array_sort(F.array_compact(F.array_distinct("held.kept_in"))).alias("keepers"),
    )
    every = docs.select(column(docs, key).alias("doc_id"), text_key(column(docs, text)).alias("r2"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("key1")) & (F.col("r2") == F.col("key2")), "left")
    count = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    listed = lambda c, name: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)).alias(name)
    return joined.select(
        "doc_id",
        count("n", "n_windows"),
        count("gone", "n_removed"),
        count("bytes", "repeated_bytes"),
        F.array_min("classes").alias("class_id"),
        listed("classes", "class_ids"),
        listed("keepers", "kept_in"),
    )
