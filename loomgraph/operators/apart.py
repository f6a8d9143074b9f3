"""Graphs that fall apart without a few nodes of many neighbours (hubs): every way from one part to another leads through a hub."""

from __future__ import annotations

import numpy as np

#: Most hubs, parts into which the pieces are put, distance of nodes that no way joins (twice it fits a byte).
HUBS, PARTS, FAR = 64, 16, 120
#: Steps for a batch of sources cost about as much as so many pairs of classes at a hub.
BATCH, PAIRS = 1024, 2000
Graph = tuple[np.ndarray, np.ndarray]


def graph_of(a: np.ndarray, b: np.ndarray, n: int) -> Graph:
    """Where the neighbours of each of n nodes begin, and the neighbours, of the steps from a to b."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def pieces(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that steps join with each."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def from_hubs(first: np.ndarray, to: np.ndarray, hubs: np.ndarray) -> tuple[np.ndarray, bool]:
    """How far every node is from each of up to 64 hubs, FAR if half of it or more; and whether that left any out. All hubs walk at once, a bit each."""
    n = len(first) - 1
    some = np.flatnonzero(np.diff(first))
    seen, come = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    seen[hubs] = np.uint64(1) << np.arange(len(hubs), dtype=np.uint64)
    far = np.full((n, len(hubs)), FAR, np.uint8)
    far[hubs, np.arange(len(hubs))] = 0
    fresh, depth = seen.copy(), 0
    while fresh.any():
        depth += 1
        if depth >= FAR // 2:
            return far, True
        come[some] = np.bitwise_or.reduceat(fresh[to], first[some])
        fresh = come & ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        for h in range(len(hubs)):
            far[rows[(fresh[rows] >> np.uint64(h)) & np.uint64(1) == 1], h] = depth
    return far, False


def parted(first: np.ndarray, to: np.ndarray, size: np.ndarray) -> dict | None:
    """The graph as parts without steps between them, and hubs. None if few hubs do not part it, or so that it saves nothing.

    hubs, far (of all nodes from the hubs), part of every node (-1 a hub); inner: of every part its nodes and its graph, which has the hubs after its nodes. Where
    two hubs are nearer by way of other parts, a row of nodes that long joins them there, so that all distances in a part are those of the graph. Nodes that
    are equally far from all hubs are a class (kinds: their distances, kind of every node, weight of each in every part)."""
    n = len(first) - 1
    degree = np.diff(first)
    a = np.repeat(np.arange(n, dtype=np.int32), degree)
    top = np.argsort(-degree, kind="stable")

    def without(count: int) -> np.ndarray:
        """Of every node that is none of the first count hubs the piece, by its smallest node; of those -1."""
        gone = np.zeros(n, bool)
        gone[top[:count]] = True
        keep = (a < to) & ~gone[a] & ~gone[to]
        return np.where(gone, -1, pieces(a[keep], to[keep], n))

    def parts(count: int) -> bool:
        label = without(count)
        return np.bincount(label[label >= 0], minlength=1).max() * 2 <= n

    few, count = 0, min(HUBS, n - 1)
    if count < 1 or not parts(count):
        return None
    while count - few > 1:  # more hubs never make pieces larger
        middle = (few + count) // 2
        few, count = (few, middle) if parts(middle) else (middle, count)
    label = without(count)
    part = np.where(label < 0, -1, 0)
    heads, where, members = np.unique(label[label >= 0], return_inverse=True, return_counts=True)
    hubs = top[:count]
    load, bins = np.zeros(PARTS), np.arange(len(heads)) % PARTS
    order = np.argsort(-members, kind="stable")
    for k in order[:1024]:  # the largest into what is emptiest
        bins[k] = load.argmin()
        load[bins[k]] += members[k]
    part[part == 0] = bins[where]
    far, more = from_hubs(first, to, hubs)
    if more:
        return None
    inner = []
    for p in np.unique(part[part >= 0]):
        mine = np.flatnonzero(part == p)
        place = np.full(n, -1, np.int32)
        place[mine] = np.arange(len(mine))
        place[hubs] = inside = len(mine) + np.arange(count)
        keep = (place[a] >= 0) & (place[to] >= 0)
        from_, into, nodes = [place[a[keep]]], [place[to[keep]]], len(mine) + count
        here = from_hubs(*graph_of(from_[0], into[0], nodes), inside)[0][inside]
        for i, j in zip(*np.nonzero(np.triu(far[hubs] < here))):
            way = np.array([inside[i], *range(nodes, nodes + int(far[hubs[i], j]) - 1), inside[j]], np.int32)
            nodes += len(way) - 2
            from_ += [way[:-1], way[1:]]
            into += [way[1:], way[:-1]]
        local = np.zeros(nodes)
        local[: len(mine)] = size[mine]
        inner.append((mine, *graph_of(np.concatenate(from_), np.concatenate(into), nodes), local))
    others = part >= 0
    rows = np.ascontiguousarray(far[others]).view(f"V{count}").ravel()
    kinds, of = np.unique(rows, return_inverse=True)
    kind = np.full(n, -1)
    kind[others] = of
    weight = np.bincount(kind[others] * PARTS + part[others], size[others], len(kinds) * PARTS).reshape(-1, PARTS)
    whole, apart = n * len(to), sum(len(x[0]) * len(x[2]) for x in inner)
    if apart / BATCH + len(kinds) ** 2 * count / PAIRS > 0.8 * whole / BATCH:
        return None
    return {"hubs": hubs, "far": far, "part": part, "inner": inner, "kinds": kinds.view(np.uint8).reshape(-1, count), "kind": kind, "weight": weight}


def by_hubs(far: np.ndarray, hubs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of every node how many hubs reach it and how far they are in sum, by their sizes; of a hub, how many nodes. What a hub stands for besides itself is two steps away."""
    sums, own = np.zeros((len(far), 2)), []
    for h, hub in enumerate(hubs):
        d = far[:, h].astype(float)
        d[d == FAR] = 0
        others = d > 0
        sums += size[hub] * np.stack([others, d], axis=1)
        own.append((size @ others, size @ d) + (size[hub] - 1) * others.any() * np.array([1, 2]))
    sums[hubs] = own
    return sums


def across(kinds: np.ndarray, weight: np.ndarray, low: int, high: int, rows: int = 64, columns: int = 4096) -> np.ndarray:
    """Of the kinds from low to high how many nodes of each part there are (by weight) that ways through hubs join with them, and how far these are in sum: [kind, part, 2]."""
    out = np.zeros((high - low, weight.shape[1], 2))
    gaps = bool((kinds == FAR).any())
    turned = np.ascontiguousarray(kinds.T)
    for at in range(low, high, rows):
        some = kinds[at : min(high, at + rows)]
        sums = out[at - low : at - low + len(some)]
        for left in range(0, len(kinds), columns):
            there, w = turned[:, left : left + columns], weight[left : left + columns]
            least = some[:, :1] + there[0]
            for h in range(1, len(turned)):
                np.minimum(least, some[:, h : h + 1] + there[h], out=least)
            if gaps:
                least[least >= FAR] = 0
                sums[:, :, 0] += (least > 0).astype(float) @ w
            else:
                sums[:, :, 0] += w.sum(axis=0)
            sums[:, :, 1] += least.astype(float) @ w
    return out
