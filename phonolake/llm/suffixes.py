"""Suffix arrays in numpy, and the window blocks that decide which bytes need one.

A window is a string of `length` bytes inside one text. Its anchor is the K-byte
string in it that hashes least, leftmost on ties, so equal windows have equal
anchors at equal places. Consecutive windows with the same anchor occurrence
make a block; the blocks of a text part its windows, and two equal windows lie
in blocks that carry one anchor hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of an anchor.
K = 64
#: Windows handled at once; a block that is cut there is still a block.
CHUNK = 1 << 18
#: Bytes of text handled at once.
BATCH_BYTES = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SYMBOLS = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)


def texts_of(batches: Iterator[pa.RecordBatch], field: int, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with about so many bytes of text, and those texts as bytes."""
    for batch in batches:
        texts = batch.column(field).cast(pa.binary())
        sizes = np.cumsum(np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in texts), np.int64, len(texts)))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low), [x or b"" for x in texts.slice(low, high - low).to_pylist()]
            low = high


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[a:b] for each pair of starts and ends; symbols are 64-bit already."""
    up, down = _POWERS.get(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of data, by its place."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * up[:-1], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs without ASCII white space, A-Z as a-z. Works through
    about CHUNK bytes at a time, cut between words."""
    found, low = [], 0
    while low < len(data):
        high = low + CHUNK
        while high < len(data) and not (gaps := _gap(data[high : high + CHUNK])).any():
            high += CHUNK
        high = high + int(np.argmax(gaps)) if high < len(data) else len(data)
        part = data[low:high]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        gap = np.concatenate(([True], _gap(part), [True]))
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        found.append((starts + low, ends + low, span_hashes(_SYMBOLS[part], starts, ends)))
        low = high
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _gap(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def window_blocks(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end in data, ending at ends: the blocks' first windows (places in
    data), numbers of windows, anchor hashes, and digests of the bytes their windows cover."""
    k, reach = min(K, length), length - min(K, length) + 1
    raw = data.tobytes()
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[low : low + CHUNK + length - 1]
        h = string_hashes(part, k)
        place = np.arange(len(h), dtype=np.uint64)
        bits = np.uint64(20)
        owner = (sliding_min(h >> bits << bits | place, reach) & np.uint64((1 << 20) - 1)).astype(np.int64)
        x = np.arange(low, low + len(owner))
        doc = np.searchsorted(ends, x, "right")
        whole = x + length <= ends[np.minimum(doc, len(ends) - 1)]
        x, owner, doc = x[whole], owner[whole], doc[whole]
        if len(x):
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(x)))
            starts = x[first]
            digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), (starts + count + length - 1).tolist(), strict=True)], dtype=np.uint64)
            out.append((starts, count, h[owner[first]], digest))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def packed(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """For each place, as many symbols from there as fit 63 bits, in order; and their number."""
    n, depth = len(symbols), 63 // bits
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(depth, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key |= padded[j : j + n]
    return key, depth


def suffix_array(key: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array, by Larsson and Sadakane's refinement: the sorted depth doubles, and only
    suffixes in groups that are not yet single are sorted again. No symbol may be zero."""
    n = len(key)
    sa = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots = np.arange(n)
    at, keys = sa, key[sa]
    while True:
        new = np.empty(len(slots), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))  # a group's rank is its first slot
        new[:-1] &= new[1:]  # single: it begins a group, and so does the next
        left = np.flatnonzero(~new) if len(new) else slots
        slots, at = slots[left], at[left]
        if not len(slots):
            return sa
        keys = rank[at] * (n + 1) + (rank[np.minimum(at + depth, n)] + 1)
        order = np.argsort(keys)
        at, keys = at[order], keys[order]
        sa[slots] = at
        depth *= 2


def common_prefixes(symbols: np.ndarray, key: np.ndarray, depth: int, sa: np.ndarray) -> np.ndarray:
    """Kasai's array, lcp[i] for suffixes sa[i - 1] and sa[i] (lcp[0] = 0), for whole columns.

    Kasai's step in text order, that a common prefix is at least the one before it
    less one, is an equality unless the symbols before both suffixes differ. Only
    those irreducible places are compared, `depth` symbols at a time; the rest
    follow by counting down.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    known = np.zeros(n, bool)
    known[1:] = (before[1:] > 0) & (symbols[:-1] == symbols[before[1:] - 1])
    plcp = np.zeros(n, np.int64)
    at = np.flatnonzero(~known & (before >= 0))
    i, j = at, before[at]
    for stride, column in ((depth, key), (1, symbols)):
        waiting = []
        while len(at):
            inside = np.maximum(i, j) < n
            same = np.zeros(len(at), bool)
            same[inside] = column[i[inside]] == column[j[inside]]
            waiting.append((at[~same], i[~same], j[~same]))
            at, i, j = at[same], i[same] + stride, j[same] + stride
        at, i, j = (np.concatenate(c) for c in zip(*waiting, strict=True)) if waiting else (at, i, j)
    plcp[at] = i - at
    places = np.arange(n)
    from_ = np.maximum.accumulate(np.where(known, 0, places))
    return np.where(known, plcp[from_] - (places - from_), plcp)[sa]
