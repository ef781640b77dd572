"""Who speaks when: clusters of spectral shapes."""

from __future__ import annotations

import numpy as np

from phonolake.kernels.frames import lengths, log_bands, power
from phonolake.kernels.pitch import median_filter


def average_linkage(distance: np.ndarray) -> np.ndarray:
    """Merges (a, b, height) by the mean distance between clusters, by chains of nearest neighbours:
    memory is the matrix, time its size. Clusters are named by one of their members."""
    d = distance.copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        merges.append((a, b, d[a, b]))
        mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        mean[[a, b]] = np.inf
        d[a], d[:, a] = mean, mean
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return np.array(merges)


def cosine_linkage(unit: np.ndarray) -> np.ndarray:
    """Merges (a, b, height) by the mean cosine distance between clusters of unit vectors, by chains of
    nearest neighbours. That mean is 1 - (sum_a . sum_b) / (n_a * n_b), so memory is the vectors, time
    their square. Clusters are named by one of their members."""
    n = len(unit)
    total, size, name = unit.astype(float), np.ones(n), np.arange(n)  # the clusters left, packed to the front
    chain, merges, left = [], [], n
    place = np.arange(n)  # of each cluster, by name
    while left > 1:
        if not chain:
            chain = [int(name[:left].min())]
        while True:
            a = place[chain[-1]]
            d = 1 - total[:left] @ total[a] / (size[:left] * size[a])
            d[a] = np.inf
            b = int(np.argmin(d))
            if len(chain) > 1 and d[place[chain[-2]]] <= d[b] + 1e-12:  # rounding must not turn a tie into a ring
                b = int(place[chain[-2]])
                break
            chain.append(int(name[b]))
        del chain[-2:]
        merges.append((int(name[a]), int(name[b]), d[b]))
        total[a] += total[b]
        size[a] += size[b]
        left -= 1
        total[b], size[b], name[b] = total[left], size[left], name[left]
        place[name[b]] = b
    return np.array(merges)


def cut(merges: np.ndarray, n: int, clusters: int) -> np.ndarray:
    """Labels 0 .. by first appearance after all but the highest merges."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges[np.argsort(merges[:, 2], kind="stable")][: n - clusters]:
        parent[root(int(b))] = root(int(a))
    _, first, label = np.unique([root(i) for i in range(n)], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def silhouette(unit: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette against centroids under the cosine distance."""
    k = label.max() + 1
    if k < 2:
        return -1.0
    center = np.stack([unit[label == i].mean(axis=0) for i in range(k)])
    center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-10)
    d = 1 - unit @ center.T
    own = d[np.arange(len(d)), label]
    d[np.arange(len(d)), label] = np.inf
    return float(((d.min(axis=1) - own) / np.maximum(np.maximum(own, d.min(axis=1)), 1e-10)).mean())


def turns(label: np.ndarray, step: float, least: float) -> list[tuple[int, float, float]]:
    """Runs of labels as (speaker, start, end), short ones given to the turn before."""
    first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    runs = zip(label[first], first * step, np.append(first[1:], len(label)) * step, strict=True)
    kept: list[tuple[int, float, float]] = []
    for who, start, end in ((int(w), round(float(a), 2), round(float(b), 2)) for w, a, b in runs):
        if kept and (end - start < least or kept[-1][0] == who):
            kept[-1] = (kept[-1][0], kept[-1][1], end)
        else:
            kept.append((who, start, end))
    return kept


def diarize(x: np.ndarray, rate: int, speakers: int = 2, most: int = 4, least_turn: float = 0.4) -> dict:
    """Speakers, their seconds and turns. Fewer than two speakers asked for means as many as the best
    silhouette says, two at least."""
    shapes = log_bands(x, rate)
    none = lambda note: {"n_speakers": 0, "speaking_time_s": {}, "turns": [], "note": note}
    if len(shapes) < 10:
        return none("recording too short for diarization")
    rms = np.sqrt(power(x, *lengths(rate)))[: len(shapes)]
    at = np.flatnonzero(rms > 0.15 * rms.max())
    if len(at) < 10:
        return none("no sustained speech detected")
    unit = shapes[at] - shapes[at].mean(axis=1, keepdims=True)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-10)
    merges = cosine_linkage(unit)
    counts = [speakers] if speakers > 1 else range(2, most + 1)
    best = max((cut(merges, len(at), k) for k in counts), key=lambda lab: silhouette(unit, lab))
    label = np.zeros(len(shapes), int)
    label[at] = best
    label = median_filter(label, 5).astype(int)
    step = lengths(rate)[1] / rate
    who, frames = np.unique(label, return_counts=True)
    return {"n_speakers": len(who), "speaking_time_s": {int(w): round(float(n * step), 1) for w, n in zip(who, frames, strict=True)}, "turns": turns(label, step, least_turn), "note": None}
