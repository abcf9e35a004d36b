"""Exact search and what compares its results.

Corpora are (id, v), queries (qid, q), results (qid, rank, id, score), closest first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, require
from ..functions.vector import EPSILON, best, metric_named, score, top

#: Numbers of one broadcast block of queries (64 MB of doubles); more queries take more blocks.
BLOCK_NUMBERS = 8_000_000

RESULT = "qid long, id long, score double"
#: The same with the rows that a task met for a query, in rows of their own without an id.
MET = "qid long, id long, score double, met long"


def query_blocks(queries: DataFrame, numbers: int = BLOCK_NUMBERS, kind=np.float64, *, kept: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries as (ids, matrix) blocks of bounded size, streamed to the driver one at a time.

    ``kept`` rows that a task keeps for each query count too, so deep results take smaller blocks.
    """
    ids: list[int] = []
    rows: list[list[float]] = []
    size = 0
    for r in queries.select("qid", "q").toLocalIterator():
        if r[1] is None:
            raise DataError("null query vector")
        ids.append(r[0])
        rows.append(r[1])
        size += len(r[1]) + 4 * kept  # scores and ids, and their copies while they are merged
        if size >= numbers:
            yield np.array(ids), np.array(rows, dtype=kind)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, dtype=kind)


def keyed_blocks(queries: DataFrame, numbers: int = BLOCK_NUMBERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(qids, matrix, keys) of queries (qid, q, keys: as many longs for each), in blocks of bounded size."""
    ids: list[int] = []
    rows: list[list[float]] = []
    keys: list[list[int]] = []
    size = 0
    for qid, q, own in queries.select("qid", "q", "keys").toLocalIterator():
        ids.append(qid)
        rows.append(q)
        keys.append(own)
        size += len(q) + len(own)
        if size >= numbers:
            yield np.array(ids), np.array(rows, dtype=np.float64), np.array(keys, dtype=np.int64)
            ids, rows, keys, size = [], [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, dtype=np.float64), np.array(keys, dtype=np.int64)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to two tasks a core: where each row meets very many, work is not in proportion to the bytes of a file."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def with_met(qids: np.ndarray, best: np.ndarray, ids: np.ndarray, met: np.ndarray, sign: float = 1.0) -> pa.RecordBatch:
    """Rows of MET: the finite ones of a task's best, and how many rows each query met."""
    i, j = np.nonzero(np.isfinite(best))
    hit = np.flatnonzero(met)
    nothing = lambda n, kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((qids[i], qids[hit]))),
            pa.concat_arrays([pa.array(ids[i, j]), nothing(len(hit), pa.int64())]),
            pa.concat_arrays([pa.array(sign * best[i, j]), nothing(len(hit), pa.float64())]),
            pa.concat_arrays([nothing(len(i), pa.int64()), pa.array(met[hit])]),
        ],
        names=["qid", "id", "score", "met"],
    )


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], width: Column | None = None) -> DataFrame:
    """answer(block) of blocks of queries that are small enough to broadcast, united.

    ``width`` is the numbers of a row (those of its vector q unless stated); their sum is
    counted first, and blocks are taken by hash of the qid.
    """
    width = F.size("q") if width is None else width
    numbers = queries.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-numbers // BLOCK_NUMBERS))
    if parts == 1:
        return answer(queries)
    out = None
    for i in range(parts):
        part = answer(queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i))
        out = part if out is None else out.unionAll(part)
    return out


def differences(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared L2 of the pairs (q[i], v[j]) by their differences."""
    out, step = np.empty(len(i)), max(1, 4_000_000 // q.shape[1])
    for at in range(0, len(i), step):
        d = q[i[at : at + step]] - v[j[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", d, d)
    return out


def score_matrix(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs of two small blocks.

    Squared L2 comes from norms and products; what is small beside the norms loses digits that
    way and is worked out from differences.
    """
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPSILON)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPSILON)
    dots = q @ v.T
    if metric == "l2":
        both = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
        out = both - 2 * dots
        i, j = np.nonzero(out <= 1e-3 * both)
        out[i, j] = differences(q, v, i, j)
        return out
    return dots


def nearest_scores(q: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Squared L2 by differences of all pairs that may be among a query's k nearest, infinity for the others.

    Norms and products say which: a pair is left out only where it is farther than k others by
    more than their rounding.
    """
    both = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
    rough, slack = both - 2 * (q @ v.T), (q.shape[1] + 4) * 1e-15 * both
    if len(v) > k:
        edge = np.partition(rough + slack, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(~(rough - slack > edge))
    else:
        i, j = (x.reshape(-1) for x in np.indices(rough.shape))
    out = np.full(rough.shape, np.inf)
    out[i, j] = differences(q, v, i, j)
    return out


#: Queries and rows that meet at once: 512 x 2048 pairs, some 16 MB with what is worked out of them.
TILE_QUERIES, TILE_ROWS = 512, 2048


class Nearest:
    """The k nearest rows met so far by each query of a block, by squared L2; ties go to the smaller id.

    Queries and rows meet in tiles of bounded size.  Products in single precision, of vectors moved to the
    middle of the queries, leave out pairs that are farther than k others by more than their rounding; what
    is left is scored by differences in double precision.
    """

    def __init__(self, q: np.ndarray, k: int, centre: np.ndarray | None = None):
        self.q, self.k = q, k
        self.scores, self.ids = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64)
        self.many = np.zeros(len(q), dtype=np.int64)
        self.centre = (q.mean(0) if len(q) else np.zeros(q.shape[1])) if centre is None else centre
        moved = q - self.centre
        self.norms = (moved * moved).sum(1)
        self.left = np.concatenate((-2 * moved, self.norms[:, None], np.ones((len(q), 1))), axis=1, dtype=np.float32, casting="unsafe")

    def meet(self, v: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None, own: np.ndarray | None = None, allowed: Callable[[np.ndarray, slice], np.ndarray] | None = None) -> None:
        """Rows v under ``ids`` meet the queries at the places ``at`` (all unless stated), but none the row of its id in ``own``.

        ``allowed(places, rows)`` is a mask of the pairs of a tile that count.
        """
        if v.shape[1] != self.q.shape[1]:
            raise ValueError(f"queries are {self.q.shape[1]} wide and vectors {v.shape[1]}")
        for start in range(0, len(v), TILE_ROWS):
            rows, names = v[start : start + TILE_ROWS], ids[start : start + TILE_ROWS]
            moved = rows - self.centre
            norms = (moved * moved).sum(1)
            right = np.concatenate((moved, np.ones((len(rows), 1)), norms[:, None]), axis=1, dtype=np.float32, casting="unsafe").T
            widest = norms.max()
            for first in range(0, len(self.q) if at is None else len(at), TILE_QUERIES):
                tile = np.arange(first, min(first + TILE_QUERIES, len(self.q))) if at is None else at[first : first + TILE_QUERIES]
                self._tile(tile, rows, names, right, widest, own, None if allowed is None else allowed(tile, slice(start, start + TILE_ROWS)))

    def _tile(self, at: np.ndarray, v: np.ndarray, ids: np.ndarray, right: np.ndarray, widest: float, own: np.ndarray | None, allowed: np.ndarray | None) -> None:
        slack = (v.shape[1] + 10) * 1.2e-7 * (self.norms[at] + widest)
        if not slack.max() < 1e30:  # beyond single precision, or not numbers: all pairs are scored
            keep = np.ones((len(at), len(v)), dtype=bool)
        else:
            rough, edge = self.left[at] @ right, self.scores[at, -1]
            if allowed is not None:
                rough[~allowed] = np.inf
            need = self.k + (own is not None)
            if len(v) > need and not np.isfinite(edge).all():
                open_ = np.flatnonzero(~np.isfinite(edge))
                edge[open_] = np.partition(rough[open_], need - 1, axis=1)[:, need - 1] + slack[open_]
            keep = rough <= np.nextafter((edge + slack).astype(np.float32), np.float32(np.inf))[:, None]
        i, j = np.divmod(np.flatnonzero(keep if allowed is None else keep & allowed), len(v))
        if own is not None:
            other = own[at[i]] != ids[j]
            i, j = i[other], j[other]
        if not len(i):
            return
        self._take(at, i, j, v, ids)

    def _take(self, at: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of the queries at[i] and the rows v[j] are scored and kept where they are near."""
        scores = differences(self.q[at], v, i, j)
        near = ~(scores > self.scores[at[i], -1])
        i, j, scores = i[near], j[near], scores[near]
        if len(i):
            self._merge(at[i], scores, ids[j])

    def _merge(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, group = np.unique(at, return_inverse=True)
        a, b = np.nonzero(np.arange(self.k)[None] < self.many[rows, None])
        group = np.concatenate((a, group))
        scores, ids = np.concatenate((self.scores[rows[a], b], scores)), np.concatenate((self.ids[rows[a], b], ids))
        order = np.lexsort((ids, scores, group))
        group, scores, ids = group[order], scores[order], ids[order]
        lengths = np.bincount(group, minlength=len(rows))
        place = np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kept = place < self.k
        self.scores[rows[group[kept]], place[kept]], self.ids[rows[group[kept]], place[kept]] = scores[kept], ids[kept]
        self.many[rows] = np.minimum(lengths, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the queries, ids, scores), a query's nearest first."""
        i, j = np.nonzero(np.arange(self.k)[None] < self.many[:, None])
        return i, self.ids[i, j], self.scores[i, j]


#: Rows of both sides of a tile where blocks meet each other.
MUTUAL = 1024


def meet_each_other(a: Nearest, a_ids: np.ndarray, b: Nearest, b_ids: np.ndarray) -> None:
    """The queries of a and b, moved to one centre, meet as each other's rows; products of a tile serve both.

    Where a is b its queries meet each other, and none itself.  Pairs that may be near wait until there are as
    many as a tile's queries keep, so a row is sorted in a few times and not for each tile.
    """
    same, wide = a is b, a.q.shape[1]
    waiting: dict[tuple[bool, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def settle(turned: bool, at: int) -> None:
        pairs = waiting.pop((turned, at), [])
        if pairs:
            near, far, ids = (b, a, a_ids) if turned else (a, b, b_ids)
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            near._take(np.arange(at, min(at + MUTUAL, len(near.q))), i, j, far.q, ids)

    for start in range(0, len(b.q), MUTUAL):
        of_b = np.arange(start, min(start + MUTUAL, len(b.q)))
        right = np.concatenate((b.left[of_b, :wide] / -2, np.ones((len(of_b), 1)), b.norms[of_b, None]), axis=1, dtype=np.float32, casting="unsafe").T
        for first in range(0, start + 1 if same else len(a.q), MUTUAL):
            of_a = np.arange(first, min(first + MUTUAL, len(a.q)))
            slack = (wide + 10) * 1.2e-7 * (a.norms[of_a].max() + b.norms[of_b].max())
            rough = a.left[of_a] @ right
            if same and first == start:
                np.fill_diagonal(rough, np.inf)
            for turned in (False,) if same and first == start else (False, True):
                near, at, of_q, q_ids, other, of_v, v_ids = (b, start, of_b, b_ids, first, of_a, a_ids) if turned else (a, first, of_a, a_ids, start, of_b, b_ids)
                if not slack < 1e30:  # beyond single precision, or not numbers: all pairs are scored
                    i, j = (x.reshape(-1) for x in np.indices((len(of_q), len(of_v))))
                else:
                    edge = near.scores[of_q, -1]
                    open_ = np.flatnonzero(~np.isfinite(edge))
                    if len(open_) and len(of_v) > near.k:
                        edge[open_] = np.partition(rough.T[open_] if turned else rough[open_], near.k - 1, axis=1)[:, near.k - 1] + slack
                    edge = np.nextafter((edge + slack).astype(np.float32), np.float32(np.inf))
                    i, j = np.divmod(np.flatnonzero(rough <= (edge if turned else edge[:, None])), len(of_b))
                    i, j = (j, i) if turned else (i, j)
                if same:
                    others = q_ids[of_q[i]] != v_ids[of_v[j]]
                    i, j = i[others], j[others]
                own = waiting.setdefault((turned and not same, at), [])  # where a is b both sides are one
                own.append((i, other + j))
                if sum(len(x) for x, _ in own) >= near.k * len(of_q):
                    settle(turned and not same, at)
    for turned, at in list(waiting):
        settle(turned, at)


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", keep: Column | None = None) -> DataFrame:
    """The k nearest rows of corpus to each query; fewer where the corpus is smaller.

    The corpus is scanned where it lies: a block of queries is broadcast, each task multiplies
    its Arrow batches by it and keeps its own k best a query, and only these are shuffled.
    ``keep`` is a predicate on corpus rows, pushed to the scan.
    """
    require(k >= 1, f"k must be at least 1, not {k}")
    metric = metric_named(metric).name
    if keep is not None:
        corpus = corpus.filter(keep)
    corpus = corpus.filter(F.col("v").isNotNull())
    spark, found = corpus.sparkSession, None
    for ids, q in query_blocks(queries, kept=k):
        shared = spark.sparkContext.broadcast((ids, q))
        rows = corpus.select(F.col("id").cast("long"), "v")
        part = scan_nearest(rows, shared, k) if metric == "l2" else scan_top(rows, shared, k, _vector_scores(metric), -1.0)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    return top(found, k, metric)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan_nearest(rows: DataFrame, shared, k: int) -> DataFrame:
    """(qid, id, score): each task's k nearest of rows (id, v) by squared L2, for a broadcast block (qids, matrix) of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, near = None, None
        for b in batches:
            if b.num_rows:
                if near is None:
                    qids, near = shared.value[0], Nearest(shared.value[1], k)
                near.meet(matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False))
        if near is not None:
            i, ids, scores = near.found()
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids), pa.array(scores)], names=["qid", "id", "score"])

    return rows.mapInArrow(run, RESULT)


def _vector_scores(metric: str):

    def scores(q: np.ndarray, column: pa.Array) -> np.ndarray:
        v = matrix(column)
        if v.shape[1] != q.shape[1]:
            raise ValueError(f"queries are {q.shape[1]} wide and vectors {v.shape[1]}")
        return -score_matrix(q, v, metric)

    return scores


def scan_top(rows: DataFrame, shared, k: int, scores, sign: float = 1.0) -> DataFrame:
    """(qid, id, score): each task's k best of rows (id, payload) for a broadcast block of queries.

    ``shared`` holds (qids, payload of the queries); ``scores(payload, column)`` gives a matrix
    of queries by rows, smaller is better, of which sign times is returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked = shared.value
        best_ids = np.empty((len(qids), 0), dtype=np.int64)
        best_scores = np.empty((len(qids), 0))
        step = max(1, 4_000_000 // len(qids))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                found = np.concatenate((best_scores, scores(asked, part.column(1))), axis=1)
                every = np.concatenate((best_ids, np.broadcast_to(ids, (len(qids), len(ids)))), axis=1)
                if every.shape[1] > k:
                    order = smallest(found, every, k)
                    found, every = np.take_along_axis(found, order, 1), np.take_along_axis(every, order, 1)
                best_scores, best_ids = found, every
        if best_ids.shape[1]:
            n = best_ids.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, n)), pa.array(best_ids.reshape(-1)), pa.array(sign * best_scores.reshape(-1))], names=["qid", "id", "score"]
            )

    return rows.mapInArrow(run, RESULT)


def scan_keyed(rows: DataFrame, shared, k: int, metric: str, by_key: bool, prefix: bool = False) -> DataFrame:
    """(qid, key, id, score): each task's k best of rows (key, id, v) for a broadcast block of queries.

    ``shared`` holds (qids, matrix of queries, places of the queries that look into each key, or
    None where all look into all).  With ``by_key`` k rows a query and key are kept, else k rows a query,
    whose key may be -1.
    With ``prefix`` rows are (key, id, v, place), a key's entry is (places of the queries, how many rows
    each takes), and a query meets the rows of a key up to that place only.
    """
    sign = 1.0 if metric == "l2" else -1.0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked, opened = shared.value
        best: dict[int, Nearest] = {}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(keys).tolist():
                at = None if opened is None else opened.get(key)
                if opened is not None and (at is None or not len(at)):
                    continue
                own = b.filter(pa.array(keys == key))
                slot = key if by_key else -1
                if slot not in best:
                    best[slot] = Nearest(asked, k)
                best[slot].meet(matrix(own.column(2)), own.column(1).to_numpy(zero_copy_only=False), at)
        for slot, near in best.items():
            i, ids, scores = near.found()
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(np.full(len(i), slot)), pa.array(ids), pa.array(scores)], names=["qid", "key", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked, opened = shared.value
        every = np.arange(len(qids))
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(keys).tolist():
                at = every if opened is None else opened.get(key)
                if prefix and at is not None:
                    at, takes = at
                if at is None or not len(at):
                    continue
                own = b.filter(pa.array(keys == key))
                ids = own.column(1).to_numpy(zero_copy_only=False)
                step = max(1, 4_000_000 // len(at))
                slot = key if by_key else -1
                if slot not in best:
                    best[slot] = np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max), np.full((len(qids), k), key)
                scores, held, of = best[slot]
                for start in range(0, len(ids), step):
                    part = ids[start : start + step]
                    v = matrix(own.column(2).slice(start, step))
                    new = sign * score_matrix(asked[at], v, metric)
                    if prefix:
                        new[own.column(3).slice(start, step).to_numpy(zero_copy_only=False)[None] > takes[:, None]] = np.inf
                    both = np.concatenate((scores[at], new), axis=1)
                    names = np.concatenate((held[at], np.broadcast_to(part, new.shape)), axis=1)
                    places = np.concatenate((of[at], np.full(new.shape, key)), axis=1)
                    order = smallest(both, names, k)
                    scores[at], held[at], of[at] = (np.take_along_axis(x, order, 1) for x in (both, names, places))
        for scores, held, of in best.values():
            i, j = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[i]), pa.array(of[i, j].astype(np.int64)), pa.array(held[i, j]), pa.array(sign * scores[i, j])], names=["qid", "key", "id", "score"]
            )

    return rows.mapInArrow(nearest if metric == "l2" and not prefix else run, "qid long, key long, id long, score double")


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of all pairs of a tile whose vectors lie around zero, those that are small beside the norms by differences."""
    qn, vn = (q * q).sum(1), (v * v).sum(1)
    out = np.concatenate((-2 * q, qn[:, None], np.ones((len(q), 1))), axis=1) @ np.concatenate((v, np.ones((len(v), 1)), vn[:, None]), axis=1).T
    i, j = np.divmod(np.flatnonzero(~(out > 1e-3 * (qn + vn.max())[:, None])), len(v))
    out[i, j] = differences(q, v, i, j)
    return np.sqrt(out, out=out)


def distance_sums(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, n, total, least): rows other than the query's own, the sum of their distances, the smallest one.

    Tasks return one row a query of the broadcast block; pairs are never rows.
    """
    spark, out = corpus.sparkSession, None
    rows = corpus.filter(F.col("v").isNotNull()).select(F.col("id").cast("long"), "v")
    for ids, q in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, asked = shared.value
            centre = asked.mean(0)
            asked = asked - centre
            n, total, least = np.zeros(len(qids), dtype=np.int64), np.zeros(len(qids)), np.full(len(qids), np.inf)
            for b in batches:
                names, v = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)) - centre
                for at in range(0, len(v), TILE_ROWS):
                    ids, part = names[at : at + TILE_ROWS], v[at : at + TILE_ROWS]
                    known = np.flatnonzero(np.isin(ids, qids))
                    for first in range(0, len(qids), TILE_QUERIES):
                        tile = slice(first, first + TILE_QUERIES)
                        d = _distances(asked[tile], part)
                        i, j = np.nonzero(qids[tile, None] == ids[known][None])
                        d[i, known[j]] = 0.0
                        n[tile] += len(ids) - np.bincount(i, minlength=len(d))
                        total[tile] += d.sum(1)
                        d[i, known[j]] = np.inf
                        least[tile] = np.minimum(least[tile], d.min(1))
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(n), pa.array(total), pa.array(least)], names=["qid", "n", "total", "least"])

        part = rows.mapInArrow(run, "qid long, n long, total double, least double")
        out = part if out is None else out.unionAll(part)
    out = spark.createDataFrame([], "qid long, n long, total double, least double") if out is None else out
    return out.groupBy("qid").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least")).filter("n > 0")


#: Rows of a block of pair_distance_sum.
PAIR_ROWS = 32_768


def pair_distance_sum(rows: DataFrame, block_rows: int = PAIR_ROWS) -> DataFrame:
    """One row: n, total: how many pairs of different rows (id, v) there are, and the sum of their distances; nulls are left out.

    Rows are dealt to blocks by hash.  A block is broadcast and meets its own rows and those of later blocks
    where they lie, so two blocks meet once; tasks return sums.
    """
    rows = rows.filter(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), "v")
    spark, many, out = rows.sparkSession, rows.count(), None
    blocks = max(1, -(-many // block_rows))
    dealt = spread(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    for block in range(blocks):
        for ids, q in query_blocks(dealt.filter(F.col("block") == block).select(F.col("id").alias("qid"), F.col("v").alias("q"))):
            shared = spark.sparkContext.broadcast((ids, q))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
                qids, asked = shared.value
                centre = asked.mean(0)
                asked, n, total = asked - centre, 0, 0.0
                for b in batches:
                    names, v, own = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)) - centre, b.column(2).to_numpy(zero_copy_only=False) == block
                    for same in (True, False):
                        ids, part = names[own == same], v[own == same]
                        for at in range(0, len(part), TILE_ROWS):
                            for first in range(0, len(qids), TILE_QUERIES):
                                d = _distances(asked[first : first + TILE_QUERIES], part[at : at + TILE_ROWS])
                                if same:  # both orders of a pair meet here: the one with the smaller id first counts
                                    before = qids[first : first + TILE_QUERIES, None] < ids[at : at + TILE_ROWS][None]
                                    n, total = n + int(before.sum()), total + float((d * before).sum())
                                else:
                                    n, total = n + d.size, total + float(d.sum())
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

            part = dealt.filter(F.col("block") >= block).select("id", "v", "block").mapInArrow(run, "n long, total double")
            out = part if out is None else out.unionAll(part)
    out = spark.createDataFrame([], "n long, total double") if out is None else out
    return out.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def smallest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest (score, id) of each row; rows with a tie at the edge are sorted whole."""
    if scores.shape[1] <= 4 * k:
        return np.lexsort((ids, scores), axis=1)[:, :k]
    part = np.argpartition(scores, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(scores, part, 1).max(1)
    tied = np.flatnonzero(np.isfinite(edge) & ((scores <= edge[:, None]).sum(1) > k))
    for i in tied:
        part[i] = np.lexsort((ids[i], scores[i]))[:k]
    return part


def pair_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, metric: str = "l2") -> DataFrame:
    """pairs (qid, id, ...) with their score, by joins on both ids; Spark picks the join."""
    return (
        pairs.join(corpus.select(F.col("id").cast("long").alias("id"), "v"), "id")
        .join(queries.select("qid", "q"), "qid")
        .withColumn("score", score("q", "v", metric))
        .drop("q", "v")
    )


def scores_for(queries: DataFrame, corpus: DataFrame, found: DataFrame, metric: str = "l2") -> DataFrame:
    """(qid, rank, id, score): found ids with their true scores."""
    return pair_scores(found.select("qid", "rank", "id"), queries, corpus, metric).select("qid", "rank", "id", "score")


def top_up(found: DataFrame, queries: DataFrame, live: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Fills short results with live rows not in them, in ascending id, scored and ranked anew.

    A query lacks at most k rows, and at most k of the first 2k ids are found already, so the
    k + k smallest live ids are enough for all queries; they are broadcast.
    """
    first = live.orderBy("id").limit(2 * k).select(F.col("id").cast("long").alias("id"), "v")
    short = (
        queries.select("qid", "q")
        .join(found.groupBy("qid").agg(F.count("*").alias("n"), F.collect_set("id").alias("have")), "qid", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter(F.col("n") < k)
    )
    spare = short.crossJoin(F.broadcast(first)).filter(~F.coalesce(F.array_contains("have", F.col("id")), F.lit(False)))
    spare = spare.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).filter(F.col("nth") <= k - F.col("n"))
    filled = spare.select("qid", "id", score("q", "v", metric).alias("score"))
    return top(found.select("qid", "id", "score").unionAll(filled), k, metric)


def identifier_overlap(left: DataFrame, right: DataFrame, k: int | None = None) -> DataFrame:
    """One row: overlap, the mean share of left's ids that right has too."""
    n = left.groupBy("qid").agg(F.count("*").alias("n"))
    hit = left.join(right.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hit"))
    each = n.join(hit, "qid", "left")
    return each.agg(F.avg(F.coalesce("hit", F.lit(0)) / (F.lit(k) if k else F.col("n"))).alias("overlap"))


def score_gap(queries: DataFrame, corpus: DataFrame, left: DataFrame, right: DataFrame, metric: str = "l2") -> DataFrame:
    """One row: gap, the mean difference of true scores slot by slot; above 0, right is worse."""
    a = scores_for(queries, corpus, left, metric).select("qid", "rank", F.col("score").alias("a"))
    b = scores_for(queries, corpus, right, metric).select("qid", "rank", F.col("score").alias("b"))
    gap = F.col("b") - F.col("a")
    return a.join(b, ["qid", "rank"]).agg(F.avg(gap if metric_named(metric).smaller_is_closer else -gap).alias("gap"))


def orderings_agree(queries: DataFrame, corpus: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """One row: agree, the share of queries whose k best are the same set under two metrics."""
    a, b = (search(queries, corpus, k, m).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias(n)) for m, n in ((left, "a"), (right, "b")))
    return a.join(b, "qid").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("agree"))


def without_own(found: DataFrame, k: int) -> DataFrame:
    """A result without each query's own row (id = qid), ranked anew, k at most."""
    w = Window.partitionBy("qid").orderBy("rank")
    again = found.filter("id <> qid").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return again.select("qid", F.col("r").alias("rank"), "id", "score")


def nearest_first(found: DataFrame, k: int) -> DataFrame:
    """The first k slots of a longer result."""
    return found.filter(F.col("rank") <= k)


def triangle_violations(triples: DataFrame, metric: str, root: bool = True) -> DataFrame:
    """One row (trials, violations) over triples (a, b, c): d(a,c) > d(a,b) + d(b,c)."""
    m = metric_named(metric)

    def d(x: str, y: str) -> Column:
        s = score(x, y, metric)
        return (F.sqrt(s) if root else s) if m.smaller_is_closer else 1 - s

    bad = d("a", "c") > d("a", "b") + d("b", "c") + 1e-9
    return triples.agg(F.count("*").alias("trials"), F.count_if(bad).alias("violations"))


def order(found: DataFrame, metric: str = "l2") -> DataFrame:
    return found.orderBy("qid", best(metric), "id")


def check_k(k: int, size: int) -> None:
    if not 1 <= k <= size:
        raise ConfigError(f"k is {k}; there are {size} rows")
