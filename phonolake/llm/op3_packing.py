"""Best-fit packing of tokenised documents, with certified bin counts.

Texts are tokenised once, where they lie; only the lengths of pieces travel.
Within a partition all that matters for packing is how many pieces there are of
each length, at most `capacity` numbers, so best-fit decreasing runs on that
histogram and yields classes of equal sequences. Dual feasible functions bound
the number of sequences from below and certify a partition's count; where it is missed, exact
filling by subset sums is tried too. Sequences with a gap give their pieces back:
FAN partitions pool them, and best-fit decreasing runs again over the pool, level
by level, until one pool is left. Should the pieces of all partitions, as one
histogram, take fewer sequences, all of them go to that last pool.

A piece is named by (partition, length, rank), so each level's decision is one
row for a (pool, length), and pieces find their places by joins on that row.

Defined results: a null text is the empty text, which still has its end token;
repeated rows are packed one by one; an empty table gives an empty result;
columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolake.llm import tokens
from phonolake.llm.common import column, materialize, ship, table

CAPACITY = 1024
END = 2
#: Partitions, and then pools, that exchange their unfilled sequences in one step.
FAN = 64

Runs = dict[int, list[tuple[int, int, int, int, int]]]


def token_ids(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """The tokenizer's ids. The same vocabulary as ranks gives the same ids several
    times faster; texts that hold a special token's string, or that its engine
    refuses, go to the tokenizer itself."""
    if not any(s in text for s in tokens.special_strings(vocabulary)):
        try:
            return tokens.byte_bpe(ranks).encode_to_numpy(text, disallowed_special=())
        except BaseException as e:
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
    return np.array(tokens.tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but, maybe, the first."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, key: str, text: str, vocabulary: str, ranks: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's name: part and rank among its length."""
    ship(docs.sparkSession)
    slim = docs.select(column(docs, key).alias("doc_id"), column(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            row: list[int] = []
            made: list[tuple] = []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(token_ids(t.as_py() or "", vocabulary, ranks), END).astype("<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    made.append((p, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if made else []
            if cols:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long")


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Classes of equal bins, as (copies by length, number of bins); what item by item gives, class by class."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {capacity: [({}, sum(counts.values()))]}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            space = min(s for s in open_ if s >= size)
            held, bins = open_[space].pop()
            fit = space // size
            copies, used = (fit, min(bins, left // fit)) if left >= fit else (left, 1)
            if bins > used:
                open_[space].append((held, bins - used))
            if not open_[space]:
                del open_[space]
            open_.setdefault(space - copies * size, []).append((held | {size: copies}, used))
            left -= copies * used
    return [(held, bins) for space in sorted(open_) for held, bins in open_[space] if held]


def fill_exactly(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Classes of bins as best_fit_decreasing gives them, each begun by the longest piece left and
    filled with those that come nearest to its space, long ones first: a subset sum over the lengths
    left, as a row of bits. A way to fill is used as often as its pieces last."""
    left, sizes, classes = dict(counts), sorted(counts, reverse=True), []
    while sizes:
        space = capacity - sizes[0]
        held, sums, used = {sizes[0]: 1}, [1], []
        for size in (s for s in sizes if s <= space):
            more, copies, step = sums[-1], min(left[size] - (size == sizes[0]), space // size), 1
            while copies > 0:  # doubling steps reach every number of copies
                step = min(step, copies)
                more |= more << size * step & (1 << space + 1) - 1
                copies, step = copies - step, 2 * step
            used.append(size)
            sums.append(more)
            if more >> space & 1:
                break
        at = sums[-1].bit_length() - 1
        for size, before in zip(reversed(used), reversed(sums[:-1]), strict=True):
            while not before >> at & 1:
                held[size] = held.get(size, 0) + 1
                at -= size
        bins = min(left[s] // c for s, c in held.items())
        for s, c in held.items():
            left[s] -= c * bins
        sizes = [s for s in sizes if left[s]]
        classes.append((held, bins))
    return classes


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The most bins that any of these dual feasible functions asks for.

    Rounding by a threshold: lengths over capacity - t weigh a whole bin, those
    under t nothing. Rounding by a factor: (k + 1) x / capacity is cut to whole
    k-ths of a bin, unless it is whole already.
    """
    if not counts:
        return 0
    x, n = np.array(list(counts)), np.array(list(counts.values()))
    t = np.arange(0, capacity // 2 + 1)[:, None]
    weighed = (np.where(x > capacity - t, capacity, np.where(x < t, 0, x)) * n).sum(1)
    best = -(-int(weighed.max()) // capacity)
    for k in range(1, 33):
        scaled = (k + 1) * x
        units = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((units * n).sum()) // (capacity * k)))
    return best


def total(classes: list[tuple[dict[int, int], int]]) -> int:
    return sum(bins for _, bins in classes)


def fewest(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The classes of best fit or, where it misses the bound and that has fewer bins, of exact
    filling; and the bound."""
    classes, bound = best_fit_decreasing(counts, capacity), lower_bound(counts, capacity)
    return classes if total(classes) <= bound else min(classes, fill_exactly(counts, capacity), key=total), bound


def pack_pool(counts: dict[int, int], capacity: int, last: bool) -> tuple[dict[int, int], Runs, int, int]:
    """Pieces kept by length, their runs (first rank, copies, bins, first bin, offset), and the
    numbers of bins kept and of the bound. Only the last pool keeps bins with a gap."""
    classes, bound = fewest(counts, capacity)
    kept, runs, at = dict.fromkeys(counts, 0), {s: [] for s in counts}, 0
    for held, bins in classes:
        if last or sum(s * c for s, c in held.items()) == capacity:
            offset = 0
            for size, copies in held.items():
                runs[size].append((kept[size], copies, bins, at, offset))
                kept[size] += copies * bins
                offset += size * copies
            at += bins
    return kept, runs, at, bound


_LEVEL = "pool long, length long, kept long, released long, bins long, bound long, runs array<struct<first:long,copies:long,bins:long,bin:long,offset:long>>"


def _level(counts: DataFrame, capacity: int, last: bool, hold: bool) -> DataFrame:
    """One row for each (pool, length) of counts (pool, length, n). Without hold, only the last pool
    keeps anything."""

    def run(group: pa.Table) -> pa.Table:
        have = dict(zip(group["length"].to_pylist(), group["n"].to_pylist(), strict=True))
        kept, runs, bins, bound = pack_pool(have, capacity, last) if last or hold else (dict.fromkeys(have, 0), {s: [] for s in have}, 0, 0)
        pool = group["pool"][0].as_py()
        rows = [{"pool": pool, "length": s, "kept": kept[s], "released": have[s] - kept[s], "bins": bins, "bound": bound, "runs": [dict(zip(("first", "copies", "bins", "bin", "offset"), r, strict=True)) for r in runs[s]]} for s in have]
        one = pa.struct([(n, pa.int64()) for n in ("first", "copies", "bins", "bin", "offset")])
        return pa.Table.from_pylist(rows, pa.schema([*((n, pa.int64()) for n in ("pool", "length", "kept", "released", "bins", "bound")), ("runs", pa.list_(one))]))

    return counts.groupBy("pool").applyInArrow(run, _LEVEL)


def plan(named: DataFrame, capacity: int = CAPACITY) -> list[DataFrame]:
    """The levels' decisions over pieces (part, length, rank), lowest level first. If all pieces in
    one pool, at most `capacity` numbers, take fewer sequences, the levels below hand on everything."""
    levels = _levels(named, capacity, True)
    if len(levels) > 1:
        made = sum(level.groupBy("pool").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0 for level in levels)
        counts = {r.length: r.n for r in named.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        classes, _ = fewest(counts, capacity)
        if total(classes) < made:
            return _levels(named, capacity, False)
    return levels


def _levels(named: DataFrame, capacity: int, hold: bool) -> list[DataFrame]:
    top = named.agg(F.max("part")).first()[0]
    pools = (top if top is not None else 0) + 1
    counts = named.groupBy(F.col("part").alias("pool"), "length").agg((F.max("rank") + 1).alias("n"))
    levels = []
    while True:
        made = _level(counts, capacity, pools == 1, hold)
        before = Window.partitionBy("parent", "length").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)
        made = made.withColumn("parent", F.floor(F.col("pool") / FAN)).withColumn("start", F.coalesce(F.sum("released").over(before), F.lit(0)))
        made = materialize(made, f"level{len(levels)}")
        levels.append(made)
        if pools == 1:
            return levels
        counts = made.where("released > 0").groupBy(F.col("parent").alias("pool"), "length").agg(F.sum("released").alias("n"))
        pools = -(-pools // FAN)


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = f"{tokens.FOLDER}/byte_bpe_50k.json", ranks: str = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Every piece of docs with its sequence and its offset there."""
    named = materialize(pieces(docs, capacity, key, text, vocabulary, ranks), "pieces")
    levels = plan(named, capacity)
    at = named.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("part").alias("pool"), F.col("rank").alias("idx"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    for k, level in enumerate(levels):
        rows = level.select("pool", "length", "kept", F.col("start").alias("shift"), "runs")
        if k == len(levels) - 1:
            rows = F.broadcast(rows)  # one pool: at most `capacity` rows
        run = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("idx")) & (F.col("idx") < r["first"] + r["copies"] * r["bins"])), F.lit(0))
        here = F.col("sequence_id").isNull() & (F.col("idx") < F.col("kept"))
        since = F.col("idx") - F.col("run.first")
        at = at.join(rows, ["pool", "length"], "left").withColumn("run", F.when(here, run))
        at = at.select(
            *("doc_id", "piece", "start", "length", "ids_crc32"),
            F.floor(F.col("pool") / FAN).alias("pool"),
            (F.col("shift") + F.col("idx") - F.col("kept")).alias("idx"),
            F.coalesce("sequence_id", F.lit(k << 58) + F.col("pool") * F.lit(1 << 36) + F.col("run.bin") + F.floor(since / F.col("run.copies"))).alias("sequence_id"),
            F.coalesce("offset", F.col("run.offset") + since % F.col("run.copies") * F.col("length")).alias("offset"),
        )
    return at.drop("pool", "idx")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
