"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint's bit is the majority of that bit over the 64-bit hashes of a
text's word shingles. Equal fingerprints collapse first. The index's top level
holds masked bit patterns: 64 bits fall into radius + 2 blocks, and two
fingerprints within the radius agree in two whole blocks at least, so every
pair meets under some pattern of two blocks. Beneath a pattern, members are
sorted by Gray rank; runs of FANOUT neighbours share a masked pattern that moves
into their upper node, level by level, and a search adds up differences on the
way down, dropping a whole group as soon as the sum passes the radius, or when
the group is already known to be in the searcher's component. Patterns with
more than HOT members are factored once more by a block of the rest, which
loses no pair either.

`keep_one` links texts whose shingle sets are similar from a stated Jaccard
similarity on. Such pairs differ in a good tenth of their bits, too many for whole
blocks, so fingerprints are longer and the top level's masks are drawn bits, as
many masks as a stated recall asks for. There, components are candidates only:
inside each, the sets of shingles (by 64-bit hash) are compared, and only pairs
from the stated similarity on are links. A component with over SPLIT texts, or
SPLIT_BYTES of them, is dealt, and every two deals are compared in a task of their
own.

What leaves a pattern is a spanning forest, never all pairs; components of the
forests are found across the cluster.

Defined results: a null or empty text has fingerprint zero and links like any
other; texts under the shingle's length are one shingle; equal and repeated
rows share a component; a component's id is its smallest key that is not null
(null if it has none); an empty table gives an empty result; columns other than
the key and the text are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolake.llm.common import column, materialize, ship, table, text_key, unused
from phonolake.llm.graph import components

SEED = 42
RADIUS = 3
#: Children of an index node; also the largest pattern that is compared pair by pair.
FANOUT = 16
#: Members above which a pattern is factored by a third block.
HOT = 50_000
#: Distinct texts of a candidate component that one deal holds, and their bytes, about; a task compares two deals.
SPLIT = 2048
SPLIT_BYTES = 1 << 23


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 of each word shingle; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, words_in_shingle: int, width: int = 1, repeats: bool = True) -> np.ndarray:
    """The bit majorities, 64 * width of them, as signed longs. The first 64 are of the
    shingles' XXH64; further ones are of that hash mixed anew. Without repeats, equal
    shingles count once."""
    hashes = shingle_hashes(text, words_in_shingle)
    if not len(hashes):
        return np.zeros(width, np.int64)
    hashes = hashes if repeats else np.unique(hashes)
    out = np.empty(width, "<i8")
    for i in range(width):
        mixed = hashes
        if i:
            mixed = (hashes + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
        ones = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]
    return out


def _fields(width: int) -> list[str]:
    return [f"f{i}" for i in range(width)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = 3, width: int = 1, repeats: bool = True) -> DataFrame:
    """(key, r1, r2, size, f0 ..) of each row; r1 and r2 are hashes of its key and its text, size the text's bytes."""
    ship(docs.sparkSession)
    own, t = column(docs, key), column(docs, text)
    slim = docs.select(own.alias("key"), F.xxhash64(own).alias("r1"), text_key(t).alias("r2"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("size"), t.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words_in_shingle, width, repeats) for t in batch.column(4)], np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=["key", "r1", "r2", "size", *_fields(width)])

    kinds = ", ".join(f"{f} long" for f in _fields(width))
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, r1 long, r2 long, size long, {kinds}")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Each code's place in the Gray sequence, as words from the highest; codes is (n, words)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    # A word's lowest rank bit is its parity; odd words above turn the words below around.
    odd = np.bitwise_xor.accumulate(rank & np.uint64(1), axis=1)
    rank[:, 1:] ^= -odd[:, :-1]
    return rank


def apart(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Differing bits of codes (n, words), under a mask if given."""
    x = a ^ b
    return np.bitwise_count(x if mask is None else x & mask).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """The hierarchy under one pattern: levels of (mask, pattern), the members at the bottom.

    A node's mask has the bits that all its members share and its parent does not fix.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.lexsort(gray_rank(codes).T[::-1])]
        ones, zeros = self.codes, ~self.codes  # bits set in all, bits clear in all
        self.levels = [(~np.zeros_like(ones), ones)]
        while len(ones) > FANOUT:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            shared = ones | zeros
            mask, pattern = self.levels[-1]
            self.levels[-1] = (mask & ~np.repeat(shared, FANOUT, axis=0)[: len(mask)], pattern)
            self.levels.append((shared, ones))

    def forest(self, radius: int) -> np.ndarray:
        """For each of self.codes, the place of the first member of its component by links within the radius."""
        n = len(self.codes)
        label = np.arange(n)
        near = np.flatnonzero(apart(self.codes[1:], self.codes[:-1]) <= radius)
        label = join(label, near, near + 1)
        step = int(np.clip(2_000_000 // n, 1, 1024))
        for first in range(0, n, step):
            who = np.arange(first, min(first + step, n))
            low, high = self._ranges(label)
            top = len(self.levels) - 1
            nodes = np.arange(len(self.levels[top][0]))
            q, node, sum_ = np.repeat(who, len(nodes)), np.tile(nodes, len(who)), np.zeros(len(who) * len(nodes), np.int64)
            for level in range(top, -1, -1):
                if level < top:
                    q, sum_ = np.repeat(q, FANOUT), np.repeat(sum_, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < len(self.levels[level][0])
                    q, node, sum_ = q[there], node[there], sum_[there]
                mask, pattern = self.levels[level]
                other = (low[level][node] != label[q]) | (high[level][node] != label[q])
                q, node, sum_ = q[other], node[other], sum_[other]
                sum_ = sum_ + apart(self.codes[q], pattern[node], mask[node])
                close = sum_ <= radius
                q, node, sum_ = q[close], node[close], sum_[close]
            label = join(label, q, node)
        return label

    def _ranges(self, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        low, high = [label], [label]
        for mask, _ in self.levels[1:]:
            at = np.arange(0, len(low[-1]), FANOUT)[: len(mask)]
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        return low, high


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the smallest label of each component, by hooking and jumping."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


@dataclass(frozen=True)
class Patterns:
    """The masks of the top level, and for each the masks that factor it where it is crowded.
    A mask has one integer for each word of a fingerprint."""

    radius: int
    width: int
    masks: list[tuple[int, ...]]
    finer: list[list[tuple[int, ...]]]


def block_patterns(radius: int = RADIUS) -> Patterns:
    """For 64 bits: every two of radius + 2 blocks, and then one of radius + 1 parts of the rest.
    No pair within the radius is lost."""
    n = radius + 2
    edge = [64 * i // n for i in range(n + 1)]
    masks, finer = [], []
    for pair in combinations(range(n), 2):
        rest = [bit for i in range(n) if i not in pair for bit in range(edge[i], edge[i + 1])]
        masks.append((sum(1 << bit for i in pair for bit in range(edge[i], edge[i + 1])),))
        finer.append([(sum(1 << bit for bit in rest[len(rest) * j // (radius + 1) : len(rest) * (j + 1) // (radius + 1)]),) for j in range(radius + 1)])
    return Patterns(radius, 1, masks, finer)


def differing(similarity: float) -> float:
    """The share of bits in which texts of that Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Bits under a drawn mask at least: by chance, 1 of 65536 fingerprints meets another there.
MASK_BITS = 16


def sampled_patterns(rows: int, similarity: float, width: int = 4, recall: float = 0.99) -> Patterns:
    """For 64 * width bits and far pairs: masks of MASK_BITS drawn bits, or of as many as tell `rows`
    fingerprints apart if that is more, and as many masks as meet a pair at the similarity with that
    probability: a number that grows as rows to the power of 0.23. The radius is three standard deviations
    above the mean distance of such pairs: those under the similarity are told apart later."""
    share, bits = differing(similarity), 64 * width
    draw = random.Random(42)

    def masks(chosen: int, missing: float) -> list[tuple[int, ...]]:
        count = math.ceil(math.log(missing) / math.log1p(-((1 - share) ** chosen)))
        made = []
        for _ in range(count):
            picked = draw.sample(range(bits), chosen)
            made.append(tuple(sum(1 << b % 64 for b in picked if b // 64 == w) for w in range(width)))
        return made

    top = masks(max(MASK_BITS, math.ceil(math.log2(max(rows, 2))) - 2), 1 - recall)
    radius = math.floor(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    return Patterns(radius, width, top, [masks(8, 0.001)] * len(top))


def _keyed(masks: list[tuple[int, ...]]) -> Column:
    """An array of each mask's number and a hash of the bits under it."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(i).alias("mask"), F.xxhash64(*[F.col(f).bitwiseAND(F.lit(signed(m))) for f, m in zip(_fields(len(mask)), mask, strict=True)]).alias("pattern")) for i, mask in enumerate(masks)])


def links(distinct: DataFrame, patterns: Patterns, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between ids that connect distinct (id, f0 ..) just as all links do that meet under a pattern."""
    ship(distinct.sparkSession)
    fields, radius, width = _fields(patterns.width), patterns.radius, patterns.width
    pattern = F.xxhash64("mask", "pattern")  # patterns that clash only meet in one task
    put = distinct.select("id", *fields, F.inline(_keyed(patterns.masks))).withColumn("at", pattern)
    crowded = materialize(put.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n"), "crowded")
    if crowded.limit(1).count():
        finer = [_keyed(masks) for masks in patterns.finer]
        picked = finer[0]
        if any(masks is not patterns.finer[0] for masks in patterns.finer):
            picked = F
            for i, choice in enumerate(finer):
                picked = picked.when(F.col("mask") == i, choice)
        inside = F.transform(picked, lambda p: F.xxhash64("at", p["mask"], p["pattern"]))
        split = put.join(crowded, "at").withColumn("at", F.explode(inside))
        put = put.join(crowded, "at", "left_anti").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.empty((0, width + 2), np.int64)
        for batch in batches:
            rows = np.concatenate([carry, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            new = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            cut = new[-1] if len(new) else 0  # the last pattern may go on in the next batch
            yield from _edges(rows[:cut, 1], rows[:cut, 2:], np.concatenate(([0], new[:-1])) if len(new) else new, radius)
            carry = rows[cut:]
        if len(carry):
            yield from _edges(carry[:, 1], carry[:, 2:], np.array([0]), radius)

    placed = put.select("at", "id", *fields).repartition("at").sortWithinPartitions("at")
    return placed.mapInArrow(run, "a long, b long")


def _edges(ids: np.ndarray, fields: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each run of rows that starts at one of starts."""
    if not len(ids):
        return
    codes = np.ascontiguousarray(fields).view(np.uint64)
    sizes = np.diff(np.append(starts, len(ids)))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes <= FANOUT)[run]
    near = []
    for lag in range(1, int(min(FANOUT, sizes.max()))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
        near.append(i[apart(codes[i], codes[i + lag]) <= radius])
    near = [(i, i + lag) for lag, i in enumerate(near, 1)]
    label = join(np.arange(len(ids)), *(np.concatenate(c) for c in zip(*near, strict=True))) if near else np.arange(len(ids))
    for k in np.flatnonzero(sizes > FANOUT):
        at = slice(starts[k], starts[k] + sizes[k])
        order, index = members(codes[at])
        label[starts[k] + order] = starts[k] + order[index.forest(radius)]
    # A component's smallest id is its head: under most masks it is the same, and so are the links.
    head = ids.copy()
    np.minimum.at(head, label, ids)
    head = head[label]
    if (some := ids != head).any():
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(head[some], pa.int64())], names=["a", "b"])


def members(codes: np.ndarray) -> tuple[np.ndarray, GrayIndex]:
    """The index over codes, and where its members stand in them."""
    return np.lexsort(gray_rank(codes).T[::-1]), GrayIndex(codes)


def groups(fps: DataFrame, patterns: Patterns) -> DataFrame:
    """fps (key, r1, r2, f0 ..) with label, the smallest id of the component: ids are fingerprints
    of one word, or 64-bit hashes of longer ones."""
    fields = _fields(patterns.width)
    named = fps.withColumn("id", F.col("f0") if patterns.width == 1 else F.xxhash64(*fields))
    distinct = materialize(named.groupBy("id").agg(*[F.first(f).alias(f) for f in fields]), "distinct")
    label = components(materialize(links(distinct, patterns), "links"))
    return named.join(label, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node", "id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component) of every row by 64-bit fingerprints; component is the smallest key of its component."""
    fps = materialize(fingerprints(docs, key, text, words_in_shingle), "fingerprints")
    found = materialize(groups(fps, block_patterns(radius)).select("key", F.col("f0").alias("fp"), "label"), "labels")
    # A table of its own, so that the join may split a crowded component.
    smallest = materialize(found.groupBy("label").agg(F.min("key").alias("component")), "smallest")
    return found.join(smallest, "label").select("key", "fp", "component")


#: Texts of a component that a text meets at first; those of components not linked by then come later, in growing numbers.
FIRST = 8


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k] to starts[k] + sizes[k] - 1 of every k, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def components_of(sets: list, similarity: float) -> list[int]:
    """For each set, or array of different integers, the first one of its component, by links of that
    Jaccard similarity.

    A prefix-filtered join: two sets that are alike share one of the rarest few of
    both, so only sets that meet there are compared, each pair once at most, and only
    while they are not in one component already: of each component that a set
    meets, a few are compared first, and the others only if none of these is a link.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    own = np.concatenate([np.fromiter(x, np.uint64, len(x)) for x in sets]) if n else np.empty(0, np.uint64)
    _, member, often = np.unique(own, return_inverse=True, return_counts=True)
    place = np.empty(len(often), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    member, who = place[member], np.repeat(np.arange(n), size)
    member = member[np.lexsort((member, who))]  # each set's members, rarest first
    start = np.cumsum(size) - size
    prefix = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    # Sets that have a member in their prefix, as many as have been seen.
    room = np.bincount(member[_slices(start, prefix)], minlength=len(often))
    first, filled = np.cumsum(room) - room, np.zeros(len(often), np.int64)
    met, label = np.empty(room.sum(), np.int64), np.arange(n)
    mine, seen = np.zeros(len(often), bool), np.zeros(n, bool)
    for i in range(n):
        items, head = member[start[i] : start[i] + size[i]], member[start[i] : start[i] + prefix[i]]
        seen[met[_slices(first[head], filled[head])]] = True
        near = np.flatnonzero(seen[:i])
        seen[near] = False
        met[first[head] + filled[head]] = i
        filled[head] += 1
        near = near[(size[near] >= similarity * size[i]) & (size[i] >= similarity * size[near])]
        near = near[np.argsort(label[near], kind="stable")]
        mine[items] = True
        most = FIRST
        while len(near):
            of = label[near]
            new = np.concatenate(([True], of[1:] != of[:-1]))
            turn = np.arange(len(near)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            now = near[turn < most]
            both = np.add.reduceat(mine[member[_slices(start[now], size[now])]], np.cumsum(size[now]) - size[now], dtype=np.int64)
            linked = np.unique(label[now[both >= similarity * (size[i] + size[now] - both)]])
            near = near[(turn >= most) & ~np.isin(of, linked)]
            if len(linked):
                some = np.append(linked, label[i])
                label[: i + 1][np.isin(label[: i + 1], some)] = some.min()
            most *= 8
        mine[items] = False
    return label.tolist()


def alike(rows: DataFrame, found: DataFrame, words_in_shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between the r2 of rows (r1, r2, text) with one label in found (r1, r2, size, label): a
    text to the head of its component by that Jaccard similarity among the texts of two deals."""
    members = materialize(found.groupBy("label", "r2").agg(F.min("r1").alias("r1"), F.max("size").alias("size")), "members")
    # A table of its own, so that the join below may split a crowded label.
    deals = F.greatest(F.ceil(F.count(F.lit(1)) / SPLIT), F.ceil(F.sum("size") / SPLIT_BYTES))
    sizes = materialize(members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), deals.alias("deals")).where("n > 1"), "sizes")
    wanted = members.join(sizes, "label").select("r1", "r2", "label", F.greatest("deals", F.lit(1)).alias("deals"))
    # The same plan at every size: texts are dealt by their keys, and candidates go to them.
    held = rows.join(materialize(wanted, "wanted").hint("merge"), ["r1", "r2"]).withColumn("deal", F.pmod("r2", "deals"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    # With several deals, each is compared in itself wherever it meets another.
    held = held.where("deals = 1 OR deal <> other").select("label", F.least("deal", "other").alias("low"), F.greatest("deal", "other").alias("high"), "r2", "text")

    def links_of(group: list[tuple[int, str | None]]) -> list[tuple[int, int]]:
        sets = [np.unique(shingle_hashes(t, words_in_shingle)) for _, t in group]
        sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]  # texts without words are equal
        return [(group[i][0], group[h][0]) for i, h in enumerate(components_of(sets, similarity)) if h != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda made: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["a", "b"])
        key, group = None, []
        for batch in batches:
            for label, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, low, high) != key:
                    if made := links_of(group):
                        yield pack(made)
                    key, group = (label, low, high), []
                if not group or group[-1][0] != row[0]:  # repeated rows hand in a text twice
                    group.append(tuple(row))
        if made := links_of(group):
            yield pack(made)

    placed = held.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "r2")
    return placed.mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest key (nulls last).

    Texts are alike from the stated Jaccard similarity of their shingle sets on;
    fingerprints of 64 * width bits find the candidates. Other columns pass through.
    """
    fps = materialize(fingerprints(docs, key, text, words_in_shingle, width, repeats=False), "fingerprints")
    rows = fps.agg(F.approx_count_distinct(F.xxhash64(*_fields(width)), 0.02)).first()[0]
    found = materialize(groups(fps, sampled_patterns(rows, similarity, width)).select("key", "r1", "r2", "size", "label"), "candidates")
    own, t = column(docs, key), column(docs, text)
    texts = docs.select(F.xxhash64(own).alias("r1"), text_key(t).alias("r2"), t.alias("text"))
    label = components(materialize(alike(texts, found, words_in_shingle, similarity), "alike"))
    found = found.drop("label").join(label, F.col("r2") == F.col("node"), "left").withColumn("label", F.coalesce("label", "r2"))
    chosen = found.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "r1", "r2")).alias("best"))
    chosen = materialize(chosen.select(F.col("best.r1").alias("r1"), F.col("best.r2").alias("r2")), "kept")
    a, b, c, d, n = (unused(docs, x) for x in ("r1", "r2", "kept_r1", "kept_r2", "copy"))
    with_key = docs.withColumn(a, F.xxhash64(own)).withColumn(b, text_key(t))
    chosen = chosen.select(F.col("r1").alias(c), F.col("r2").alias(d))
    kept = with_key.join(chosen, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left_semi")
    if fps.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():  # repeated rows: one stays
        kept = kept.withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(a))).where(F.col(n) == 1)
    return kept.select(*[column(kept, c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
