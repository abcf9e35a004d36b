"""Structures that one task builds and walks in memory: kd-tree, projection forest, graphs.

Their walks are sequential by nature.  Each shard of a table gets a structure of its own, of
bounded size; a search asks every shard and merges (see sharded.py).  Results are (positions,
scores, cost) with squared L2 scores; rows flagged in ``dead`` are walked and charged, not returned.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np

from .exact import TILE_QUERIES, TILE_ROWS, Nearest, differences


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as bytes; nothing but numbers can be read back from them."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _runs(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers end to end, and where each starts."""
    lists = [np.asarray(x, dtype=np.int32) for x in lists]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    return (np.concatenate(lists) if lists else np.empty(0, dtype=np.int32)), ends


def _lists(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _narrow(v: np.ndarray) -> np.ndarray:
    """Single precision where it loses nothing."""
    small = v.astype(np.float32)
    return small if np.array_equal(small, v) else v


class Structure:
    """What a shard holds; ``arrays`` and ``restored`` carry it over the wire."""

    def arrays(self) -> dict[str, np.ndarray]:
        raise NotImplementedError

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> Structure:
        raise NotImplementedError

    def answers(self, q: np.ndarray, k: int, dead: np.ndarray | None = None, **how) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """search() of each query of a block."""
        for x in q:
            yield self.search(x, k, dead=dead, **how)


def _nearest(v: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = ((v[rows] - q) ** 2).sum(1)
    order = np.lexsort((rows, d))[:k]
    return rows[order], d[order]


class KdTree(Structure):
    """Splits the widest axis at its lower median; prunes by distances to the leaves' boxes."""

    def __init__(self, v: np.ndarray, leaf_size: int = 16):
        self.v, self.leaves = v, []
        stack = [np.arange(len(v))]
        while stack:
            rows = stack.pop()
            spread = v[rows].max(0) - v[rows].min(0)
            axis = int(spread.argmax())
            if len(rows) <= leaf_size or spread[axis] == 0:
                self.leaves.append(rows)
                continue
            line = np.sort(v[rows, axis])[(len(rows) - 1) // 2]
            left = v[rows, axis] <= line
            if left.all():
                left = v[rows, axis] < line
            stack += [rows[~left], rows[left]]
        self._bounds()

    def _bounds(self) -> None:
        self.low = np.stack([self.v[r].min(0) for r in self.leaves])
        self.high = np.stack([self.v[r].max(0) for r in self.leaves])

    def arrays(self) -> dict[str, np.ndarray]:
        flat, ends = _runs(self.leaves)
        return {"v": _narrow(self.v), "leaves": flat, "leaf_ends": ends}

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> KdTree:
        out = cls.__new__(cls)
        out.v, out.leaves = a["v"].astype(np.float64), _lists(a["leaves"].astype(np.int64), a["leaf_ends"])
        out._bounds()
        return out

    def search(self, q: np.ndarray, k: int, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        bound = (gap * gap).sum(1)
        rows, scores, cost = np.empty(0, dtype=int), np.empty(0), 0
        for i in np.argsort(bound, kind="stable"):
            if len(rows) == k and bound[i] > scores[-1]:
                break
            cost += len(self.leaves[i])
            leaf = self.leaves[i] if dead is None else self.leaves[i][~dead[self.leaves[i]]]
            rows, scores = _nearest(self.v, np.concatenate((rows, leaf)), q, k)
        return rows, scores, cost


    def answers(self, q: np.ndarray, k: int, dead: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The same for a block of queries: leaves whose boxes are not beyond what a query's nearest leaves hold meet it in tiles.

        A query's cost is the rows of its own leaves; what it meets beside them in a tile is not charged.
        """
        sizes, live = np.array([len(r) for r in self.leaves]), self.leaves if dead is None else [r[~dead[r]] for r in self.leaves]
        low, high = np.ascontiguousarray(self.low.T), np.ascontiguousarray(self.high.T)
        few = min(len(self.leaves), -(-4 * k // max(1, int(sizes.mean()))))
        tiles = np.searchsorted(np.cumsum(sizes), np.arange(TILE_ROWS, len(self.v) + TILE_ROWS, TILE_ROWS))
        for at in range(0, len(q), TILE_QUERIES):
            x = q[at : at + TILE_QUERIES]
            near, bound = Nearest(x, k), np.zeros((len(x), len(self.leaves)))
            for few_at in range(0, len(x), 32):  # small enough to stay in the cache
                own, sums = x[few_at : few_at + 32], bound[few_at : few_at + 32]
                for d in range(x.shape[1]):
                    gap = np.maximum(low[d] - own[:, d, None], own[:, d, None] - high[d])
                    np.maximum(gap, 0.0, out=gap)
                    gap *= gap
                    sums += gap
            edge = np.full((len(x), 1), np.inf)
            for i, own in enumerate(np.argpartition(bound, few - 1, axis=1)[:, :few]):
                rows = np.concatenate([live[leaf] for leaf in own])
                if len(rows) >= k:
                    edge[i] = np.partition(((self.v[rows] - x[i]) ** 2).sum(1), k - 1)[k - 1]
            opened, first = bound <= edge * (1 + 1e-12), 0
            for last in np.unique(np.append(np.minimum(tiles + 1, len(self.leaves)), len(self.leaves))).tolist():
                some = first + np.flatnonzero(opened[:, first:last].any(0))
                if len(some):
                    rows = np.concatenate([live[leaf] for leaf in some])
                    if len(rows):
                        near.meet(self.v[rows], rows, np.flatnonzero(opened[:, some].any(1)))
                first = last
            costs = opened @ sizes
            for i in range(len(x)):
                yield near.ids[i, : near.many[i]], near.scores[i, : near.many[i]], int(costs[i])


class ProjectionTree:
    """Splits by a random direction at the median or the middle of the projections."""

    def __init__(self, v: np.ndarray, leaf_size: int = 64, seed: int = 0, split_on: str = "median"):
        rng = np.random.default_rng(seed)
        self.nodes: list = []
        self.depth = 0

        stack = [(np.arange(len(v)), 0, None)]
        while stack:
            rows, depth, parent = stack.pop()
            self.depth = max(self.depth, depth)
            node, at = {"rows": rows}, len(self.nodes)
            self.nodes.append(node)
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = at
            if len(rows) <= leaf_size:
                continue
            direction = rng.standard_normal(v.shape[1])
            p = v[rows] @ direction
            line = np.sort(p)[(len(p) - 1) // 2] if split_on == "median" else (p.min() + p.max()) / 2
            left = p <= line
            if left.all() or not left.any():
                continue
            node.update(rows=None, direction=direction, line=line)
            stack += [(rows[~left], depth + 1, (at, "right")), (rows[left], depth + 1, (at, "left"))]

    def descend(self, q: np.ndarray) -> np.ndarray:
        node = self.nodes[0]
        while node["rows"] is None:
            node = self.nodes[node["left" if q @ node["direction"] <= node["line"] else "right"]]
        return node["rows"]

    def places(self, q: np.ndarray) -> np.ndarray:
        """The leaf, as a node's number, of each query of a block."""
        out, stack = np.zeros(len(q), dtype=np.int64), [(0, np.arange(len(q)))]
        while stack:
            at, own = stack.pop()
            node = self.nodes[at]
            if node["rows"] is not None:
                out[own] = at
            elif len(own):
                left = np.array([x @ node["direction"] <= node["line"] for x in q[own]])
                stack += [(node["right"], own[~left]), (node["left"], own[left])]
        return out

    def leaf_sizes(self) -> list[int]:
        return [len(n["rows"]) for n in self.nodes if n["rows"] is not None]

    def arrays(self) -> dict[str, np.ndarray]:
        flat, ends = _runs([[] if n["rows"] is None else n["rows"] for n in self.nodes])
        inner = [n for n in self.nodes if n["rows"] is None]
        return {
            "rows": flat, "ends": ends, "inner": np.array([n["rows"] is None for n in self.nodes]), "depth": np.array([self.depth]),
            "directions": np.array([n["direction"] for n in inner]), "lines": np.array([n["line"] for n in inner], dtype=np.float64),
            "left": np.array([n["left"] for n in inner], dtype=np.int64), "right": np.array([n["right"] for n in inner], dtype=np.int64),
        }

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> ProjectionTree:
        out = cls.__new__(cls)
        out.depth, out.nodes, at = int(a["depth"][0]), [], 0
        for inner, rows in zip(a["inner"], _lists(a["rows"].astype(np.int64), a["ends"]), strict=True):
            if inner:
                out.nodes.append({"rows": None, "direction": a["directions"][at], "line": a["lines"][at], "left": int(a["left"][at]), "right": int(a["right"][at])})
                at += 1
            else:
                out.nodes.append({"rows": rows})
        return out


class Forest(Structure):
    def __init__(self, v: np.ndarray, trees: int = 8, leaf_size: int = 64, split_on: str = "median", seed: int = 0):
        self.v = v
        self.trees = [ProjectionTree(v, leaf_size, seed + t, split_on) for t in range(trees)]

    def candidates(self, q: np.ndarray, trees: int | None = None) -> np.ndarray:
        return np.unique(np.concatenate([t.descend(q) for t in self.trees[:trees]]))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"v": _narrow(self.v)} | {f"{t}/{k}": x for t, tree in enumerate(self.trees) for k, x in tree.arrays().items()}

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> Forest:
        out = cls.__new__(cls)
        out.v, trees = a["v"].astype(np.float64), sorted({int(k.split("/")[0]) for k in a if "/" in k})
        out.trees = [ProjectionTree.restored({k.split("/")[1]: x for k, x in a.items() if k.startswith(f"{t}/")}) for t in trees]
        return out

    def search(self, q: np.ndarray, k: int, trees: int | None = None, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        rows = self.candidates(q, trees)
        return *_nearest(self.v, rows if dead is None else rows[~dead[rows]], q, k), len(rows)


    def answers(self, q: np.ndarray, k: int, dead: np.ndarray | None = None, trees: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Queries that fall into the same leaves of all trees share their candidates and meet them together."""
        leaves = np.stack([t.places(q) for t in self.trees[:trees]], axis=1)
        sets, group = np.unique(leaves, axis=0, return_inverse=True)
        order = np.argsort(group.reshape(-1), kind="stable")
        ends = np.searchsorted(group.reshape(-1)[order], np.arange(len(sets) + 1))
        found: list = [None] * len(q)
        for own, a, z in zip(sets, ends[:-1], ends[1:], strict=True):
            rows = np.unique(np.concatenate([t.nodes[leaf]["rows"] for t, leaf in zip(self.trees[:trees], own, strict=True)]))
            at = order[a:z]
            for i, (ids, scores) in zip(at.tolist(), scanned(self.v, rows if dead is None else rows[~dead[rows]], q[at], k), strict=True):
                found[i] = ids, scores, len(rows)
        yield from found


def diverse(v: np.ndarray, at: int, near: np.ndarray, degree: int, alpha: float) -> list[int]:
    """The nearest candidate, then each that no kept one covers (alpha times nearer to it)."""
    kept: list[int] = []
    d = ((v[near] - v[at]) ** 2).sum(1)
    for i in np.lexsort((near, d)):
        if len(kept) == degree:
            break
        c = near[i]
        if not kept or (alpha * alpha * ((v[kept] - v[c]) ** 2).sum(1) > d[i]).all():
            kept.append(int(c))
    return kept


def pruned(v: np.ndarray, src: np.ndarray, dst: np.ndarray, degree: int, alpha: float) -> list[list[int]]:
    """``diverse`` of all vertices of edges (src, dst), some thousand vertices at once."""
    d = differences(v, v, src, dst)
    order = np.lexsort((dst, d, src))
    src, dst, d = src[order], dst[order], d[order]
    starts = np.searchsorted(src, np.arange(len(v) + 1))
    out: list[list[int]] = []
    step = max(1, 8_000_000 // (degree * v.shape[1]))
    for at in range(0, len(v), step):
        first, last = starts[:-1][at : at + step], starts[1:][at : at + step]
        kept, many = np.zeros((len(first), degree), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        for j in range(int((last - first).max(initial=0))):
            open_ = np.flatnonzero((first + j < last) & (many < degree))
            if not len(open_):
                break
            c, width = dst[first[open_] + j], int(many[open_].max())
            gap = ((v[kept[open_, :width]] - v[c][:, None]) ** 2).sum(2)
            free = np.arange(width)[None] >= many[open_, None]
            good = (free | (alpha * alpha * gap > d[first[open_] + j, None])).all(1)
            kept[open_[good], many[open_[good]]] = c[good]
            many[open_[good]] += 1
        out.extend(kept[i, :n].tolist() for i, n in enumerate(many.tolist()))
    return out


def reached(flat: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """Which vertices a walk from ``start`` can come to, a mask; vertex i has the links flat[ends[i]:ends[i + 1]]."""
    seen = np.zeros(len(ends) - 1, dtype=bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        lengths = ends[front + 1] - ends[front]
        places = np.repeat(ends[front] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        near = np.unique(flat[places])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def joined(v: np.ndarray, links: list[list[int]], entry: int, back: bool = False) -> None:
    """Has the entry lead to every vertex: what it misses is linked from the nearest that it leads to.

    Diversity and capped links leave some vertices without a way in.  With ``back`` every vertex also leads
    to the entry, so a walk may start anywhere.
    """
    flat, ends = _runs(links)
    seen = reached(flat, ends, entry)
    lost, held = np.flatnonzero(~seen), np.flatnonzero(seen)
    for u, (near, _) in zip(lost.tolist(), scanned(v, held, v[lost], 1), strict=True):
        links[near[0]] = [*links[near[0]], u]
    if back:
        flat, ends = _runs(links)
        src, order = np.repeat(np.arange(len(v)), np.diff(ends)), np.argsort(flat, kind="stable")
        seen = reached(src[order], np.searchsorted(flat[order], np.arange(len(v) + 1)), entry)
        lost, held = np.flatnonzero(~seen), np.flatnonzero(seen)
        for u, (near, _) in zip(lost.tolist(), scanned(v, held, v[lost], 1), strict=True):
            links[u] = [*links[u], int(near[0])]


def scanned(v: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, scores): the k nearest of ``rows`` to each query of a block, ties to the smaller row."""
    near = Nearest(q, k)
    for at in range(0, len(rows), 8 * TILE_ROWS):
        own = rows[at : at + 8 * TILE_ROWS]
        near.meet(v[own], own)
    for i, many in enumerate(near.many.tolist()):
        yield near.ids[i, :many], near.scores[i, :many]


def beam(v: np.ndarray, links, start: list[int], q: np.ndarray, width: int, dead: np.ndarray | None = None) -> tuple[list[tuple[float, int]], int]:
    """Best-first walk: ends when the best of the frontier is worse than the worst kept; dead rows lead on but aren't kept."""
    score = lambda rows: ((v[rows] - q) ** 2).sum(1)
    seen = set(start)
    first = score(start)
    frontier = [(d, r) for d, r in zip(first.tolist(), start, strict=True)]
    kept = [(-d, -r) for d, r in frontier if dead is None or not dead[r]]
    heapq.heapify(frontier)
    heapq.heapify(kept)
    cost = len(start)
    while frontier:
        d, r = heapq.heappop(frontier)
        if len(kept) >= width and d > -kept[0][0]:
            break
        new = [x for x in links[r] if x not in seen]
        if not new:
            continue
        seen.update(new)
        cost += len(new)
        for s, x in zip(score(new).tolist(), new, strict=True):
            if len(kept) < width or s < -kept[0][0]:
                heapq.heappush(frontier, (s, x))
                if dead is None or not dead[x]:
                    heapq.heappush(kept, (-s, -x))
                if len(kept) > width:
                    heapq.heappop(kept)
    return sorted((-d, -r) for d, r in kept), cost


def linked(v: np.ndarray, own: int, cap: int) -> list[np.ndarray]:
    """Links of rows that come one after another: each to the ``own`` nearest before it, and these back to it.

    A row keeps the ``cap`` nearest of all that it is ever linked with, nearest first, ties to the smaller row.
    """
    near = Nearest(v, own)
    every = np.arange(len(v))
    for at in range(0, len(v), TILE_QUERIES):
        some, before = every[at : at + TILE_QUERIES], every[: at + TILE_QUERIES]
        near.meet(v[before], before, some, allowed=lambda places, rows, before=before: before[rows][None] < places[:, None])
    later, earlier, d = near.found()
    src, dst, d = np.concatenate((later, earlier)), np.concatenate((earlier, later)), np.concatenate((d, d))
    order = np.lexsort((dst, d, src))
    starts = np.searchsorted(src[order], np.arange(len(v) + 1))
    return [dst[order[a : min(z, a + cap)]] for a, z in zip(starts[:-1], starts[1:], strict=True)]


def touched(v: np.ndarray, links, entry: int, q: np.ndarray, width: int) -> np.ndarray:
    """Every vertex that a walk scores."""
    seen: set[int] = set()

    class Watch:
        def __getitem__(self, r):
            seen.update(links[r])
            return links[r]

    beam(v, Watch(), [entry], q, width)
    return np.array(sorted(seen | {entry}))


class BeamGraph(Structure):
    """Symmetrised exact neighbour graph, pruned for diversity, walked from one entry."""

    def __init__(self, v: np.ndarray, degree: int = 16, build_degree: int = 32, ef: int = 32, alpha: float = 1.0, entry: str = "medoid", seed: int = 0):
        self.v, self.ef = v, ef
        n, width = len(v), min(build_degree, len(v) - 1)
        dst = np.empty(0, dtype=np.int64)
        if width:
            near = Nearest(v, width)
            near.meet(v, np.arange(n), own=np.arange(n))
            dst = near.ids.reshape(-1)
        src = np.repeat(np.arange(n), width)
        both = np.unique(np.concatenate((src * n + dst, dst * n + src)))
        self.links = pruned(v, both // n, both % n, degree, alpha)
        self.entry = {"first": 0, "random": int(np.random.default_rng(seed).integers(n)), "medoid": int(((v - v.mean(0)) ** 2).sum(1).argmin())}[entry]
        joined(v, self.links, self.entry)

    def arrays(self) -> dict[str, np.ndarray]:
        flat, ends = _runs(self.links)
        return {"v": _narrow(self.v), "links": flat, "ends": ends, "entry_ef": np.array([self.entry, self.ef])}

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> BeamGraph:
        out = cls.__new__(cls)
        out.v, out.links = a["v"].astype(np.float64), [x.tolist() for x in _lists(a["links"], a["ends"])]
        out.entry, out.ef = map(int, a["entry_ef"])
        return out

    def answers(self, q: np.ndarray, k: int, dead: np.ndarray | None = None, ef: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """A beam that holds all rows never ends before it has scored all that the entry leads to, so that is scanned."""
        if max(k, ef or self.ef) < len(self.v):
            yield from super().answers(q, k, dead, ef=ef)
            return
        seen = reached(*_runs(self.links), self.entry)
        for rows, scores in scanned(self.v, np.flatnonzero(seen if dead is None else seen & ~dead), q, k):
            yield rows, scores, int(seen.sum())

    def visited(self, q: np.ndarray, ef: int | None = None) -> np.ndarray:
        return touched(self.v, self.links, self.entry, q, ef or self.ef)

    def search(self, q: np.ndarray, k: int, ef: int | None = None, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        kept, cost = beam(self.v, self.links, [self.entry], q, max(k, ef or self.ef), dead)
        return np.array([r for _, r in kept[:k]], dtype=int), np.array([d for d, _ in kept[:k]]), cost


class Hnsw(Structure):
    """Layered graph; levels are geometric, each row is linked both ways with the nearest of those before it.

    Those come from tiles instead of a beam over what is linked so far, so no row waits for the one before;
    ``ef_construction`` only bounds how many they are.
    """

    def __init__(self, v: np.ndarray, degree: int = 16, ef: int = 32, ef_construction: int = 64, multiplier: float = 16.0, seed: int = 0):
        self.v, self.ef, self.degree = v, ef, degree
        u = np.random.default_rng(seed).random(len(v))
        self.levels = (-np.log(np.maximum(u, 1e-300)) / np.log(multiplier)).astype(int)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = int(self.levels.argmax())
        for layer in range(int(self.levels.max()) + 1):
            nodes, cap = np.flatnonzero(self.levels >= layer), degree * (2 if layer == 0 else 1)
            links = linked(v[nodes], min(cap, ef_construction), cap)
            self.layers.append({i: nodes[own].tolist() for i, own in zip(nodes.tolist(), links, strict=True)})
        links = list(self.layers[0].values())
        joined(v, links, self.entry, back=True)
        self.layers[0] = dict(enumerate(links))

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"v": _narrow(self.v), "levels": self.levels, "entry_ef_degree": np.array([self.entry, self.ef, self.degree])}
        for n, layer in enumerate(self.layers):
            flat, ends = _runs(layer.values())
            out |= {f"{n}/nodes": np.array(list(layer), dtype=np.int64), f"{n}/links": flat, f"{n}/ends": ends}
        return out

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> Hnsw:
        out = cls.__new__(cls)
        out.v, out.levels = a["v"].astype(np.float64), a["levels"]
        out.entry, out.ef, out.degree = map(int, a["entry_ef_degree"])
        layers = sorted({int(k.split("/")[0]) for k in a if "/" in k})
        out.layers = [dict(zip(a[f"{n}/nodes"].tolist(), [x.tolist() for x in _lists(a[f"{n}/links"], a[f"{n}/ends"])], strict=True)) for n in layers]
        return out

    def _climb(self, q: np.ndarray, layer: int, at: int) -> tuple[int, int]:
        best, cost = float(((self.v[at] - q) ** 2).sum()), 1
        while True:
            near = self.layers[layer].get(at) or []
            if not near:
                return at, cost
            d = ((self.v[near] - q) ** 2).sum(1)
            cost += len(near)
            if d.min() >= best:
                return at, cost
            best, at = float(d.min()), near[int(d.argmin())]

    def search(self, q: np.ndarray, k: int, ef: int | None = None, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        at, cost = self.entry, 0
        for layer in range(len(self.layers) - 1, 0, -1):
            at, c = self._climb(q, layer, at)
            cost += c
        kept, c = beam(self.v, self.layers[0], [at], q, max(k, ef or self.ef), dead)
        return np.array([r for _, r in kept[:k]], dtype=int), np.array([d for d, _ in kept[:k]]), cost + c

    def answers(self, q: np.ndarray, k: int, dead: np.ndarray | None = None, ef: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """A beam that holds all rows scores all that its start leads to; most starts lead to the same rows."""
        if max(k, ef or self.ef) < len(self.v):
            yield from super().answers(q, k, dead, ef=ef)
            return
        n = len(self.v)
        flat, ends = _runs([self.layers[0][i] for i in range(n)])
        src = np.repeat(np.arange(n), np.diff(ends))
        order = np.argsort(flat, kind="stable")
        sets: list[np.ndarray] = []
        of: dict[int, int] = {}
        spent, group = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        hub = back = None
        for i, x in enumerate(q):
            at = self.entry
            for layer in range(len(self.layers) - 1, 0, -1):
                at, c = self._climb(x, layer, at)
                spent[i] += c
            if at not in of:
                if hub is None:  # what leads to the first start, as well as where it leads
                    hub, back = at, reached(src[order], np.searchsorted(flat[order], np.arange(n + 1)), at)
                    sets.append(reached(flat, ends, at))
                    of[at] = 0
                elif sets[0][at] and back[at]:
                    of[at] = 0
                else:
                    of[at] = len(sets)
                    sets.append(reached(flat, ends, at))
            group[i] = of[at]
        found: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for g, seen in enumerate(sets):
            own = np.flatnonzero(group == g)
            total = int(seen.sum())
            for i, (rows, scores) in zip(own.tolist(), scanned(self.v, np.flatnonzero(seen if dead is None else seen & ~dead), q[own], k), strict=True):
                found[i] = rows, scores, int(spent[i]) + total
        for i in range(len(q)):
            yield found[i]
