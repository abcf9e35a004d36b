"""Ranked lexical search by two trees, exact.

Only terms that some item asks for matter.  One scan of the whole texts keeps, for each document,
its length and how often it holds each of these terms; what a term adds to a document's score does
not depend on the item, so a document is a sparse vector of contributions and an item a set of
coordinates.  Both sides are put into hierarchies whose nodes hold coordinate maxima: documents
of a task into nodes of ``leaf`` documents and of ``fan`` such nodes, documents with the same
heaviest term side by side; items into nodes of ``fan`` items, each next to one that it shares
most weight with.  A pair of nodes cannot score more than the sum of the documents' maxima over
the union of the items' terms.  Where that is below the weakest k-th score that the node's items
have so far, all documents of the one are done with for all items of the other.  Larger nodes
are tried first, best bounds first; what is left is scored exactly.

Scores are sums of integers below 2^53, so products of double matrices are exact.

The weakest k-th scores start from a sixty-fourth of the documents, drawn by hash: the k-th best
of any part is no more than that of all, so nothing is lost.  Items are taken in blocks of at
most ``block_terms`` different terms, which bounds what is broadcast and a task's maxima; more
blocks mean more scans.  Each task returns k rows an item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, hashed_words, scratch, words_of

#: Different terms of the items of one block, and documents of one tree.
BLOCK_TERMS, TREE = 20_000, 2048


class Terms:
    """Terms of a block of items: their hashes in order, and the words themselves."""

    def __init__(self, words: list[bytes]):
        hashes = np.array([hashed_words(w.decode())[3][0] for w in words], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [words[i] for i in order]
        self.place = {w: i for i, w in enumerate(self.words)}

    def _may_hold(self) -> tuple[np.ndarray, np.uint64]:
        if "_flags" not in self.__dict__:
            bits = max(10, (16 * len(self.hashes)).bit_length())
            flags = np.zeros(1 << bits, dtype=bool)
            flags[self.hashes >> np.uint64(64 - bits)] = True
            self._flags = flags, np.uint64(64 - bits)
        return self._flags

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_flags"}

    def counted(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """All terms of a whole text; which of these terms it holds, ascending; and how often."""
        raw, first, last, hashes = hashed_words(text)
        flags, shift = self._may_hold()
        at = np.flatnonzero(flags[hashes >> shift])
        i = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[i] == hashes[at]
        at, i = at[same], i[same]
        held, example, times = np.unique(i, return_index=True, return_counts=True)
        true = [raw[first[at[e]] : last[at[e]]] == self.words[h] for h, e in zip(held.tolist(), example.tolist(), strict=True)]
        return len(hashes), held[true], times[true]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """(number, id, distinct terms) of the items that have terms, a bounded block at a time."""
    own: list[tuple[int, object, list[bytes]]] = []
    known: set[bytes] = set()
    for number, (name, text) in enumerate(items.select(id_col, F.col(text_col).cast("string")).toLocalIterator()):
        terms = sorted(set(words_of(text)))
        if not terms:
            continue
        if own and len(known | set(terms)) > block_terms:
            yield own
            own, known = [], set()
        own.append((number, name, terms))
        known.update(terms)
    if own:
        yield own


def vectors(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, times of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for cut in range(0, b.num_rows, 1000):
                part = b.slice(cut, 1000)
                found = [own.counted(t.as_py()) for t in part.column(1)]
                rows = [i for i, f in enumerate(found) if f[0]]
                ends = np.cumsum([0, *(len(found[i][1]) for i in rows)])
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([found[i][j] for i in rows]) if rows else [], pa.int32()))
                    for j in (1, 2)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array([found[i][0] for i in rows], pa.int64()), *lists], names=["doc_id", "n", "terms", "times"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def holders(found: DataFrame, many: int) -> np.ndarray:
    """Documents that hold each of ``many`` terms; tasks return a count a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(many, dtype=np.int64)
        for b in batches:
            counts += np.bincount(b.column(0).flatten().to_numpy(), minlength=many)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["term", "n"])

    out = np.zeros(many, dtype=np.int64)
    for term, n in found.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row a term of the block
        out[term] = n
    return out


def neighbourly(sets: np.ndarray, weights: np.ndarray) -> list[int]:
    """An order of items in which each follows the one, of those left, that it shares most weight with."""
    left, order = np.ones(len(sets), dtype=bool), [0]
    left[0] = False
    weighed = sets * weights
    for _ in range(len(sets) - 1):
        shared = sets @ weighed[order[-1]]
        shared[~left] = -1.0
        order.append(int(shared.argmax()))
        left[order[-1]] = False
    return order


class ItemTree:
    """Items as coordinate sets, and nodes of ``fan`` items whose maxima are the sets' unions."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, fan: int):
        sets = np.zeros((len(items), len(weights)))
        for i, own in enumerate(items):
            sets[i, own] = 1.0
        self.order = np.array(neighbourly(sets, weights))
        self.sets = sets[self.order]
        self.edges = np.append(np.arange(0, len(items), fan), len(items))
        self.unions = np.maximum.reduceat(self.sets, self.edges[:-1], axis=0)


class Best:
    """The k best documents of each item so far: score descending, id ascending, null ids last."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.astype(np.float64)
        n = len(least)
        self.scores, self.ids, self.nulls = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64), np.ones((n, k), dtype=bool)

    def meet(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        hit = ((scores > 0) & (scores >= self.least[items][:, None])).any(axis=1)
        if not hit.any():
            return
        items, n = items[hit], int(hit.sum())
        scores = np.concatenate((self.scores[items], scores[hit]), axis=1)
        ids = np.concatenate((self.ids[items], np.broadcast_to(ids, (n, len(ids)))), axis=1)
        nulls = np.concatenate((self.nulls[items], np.broadcast_to(nulls, (n, len(nulls)))), axis=1)
        order = np.lexsort((ids, nulls, -scores), axis=1)[:, : self.k]
        self.scores[items], self.ids[items], self.nulls[items] = (np.take_along_axis(x, order, 1) for x in (scores, ids, nulls))
        self.least[items] = np.maximum(self.least[items], self.scores[items, -1])


def dual_search(tree: ItemTree, best: Best, row: np.ndarray, term: np.ndarray, worth: np.ndarray, ids: np.ndarray, nulls: np.ndarray, leaf: int, fan: int) -> tuple[int, int]:
    """Meets documents (row, term, worth) with all items; returns scored pairs and node pairs tried.

    ``row`` ascends; ids and nulls are those of the rows.
    """
    many, width = len(ids), tree.sets.shape[1]
    heaviest = np.zeros(many, dtype=np.int64)
    by = np.lexsort((worth, row))
    heaviest[row[by]] = term[by]  # the last of a row stays: its heaviest
    size = np.zeros(many)
    np.add.at(size, row, worth)
    place = np.empty(many, dtype=np.int64)
    order = np.lexsort((size, heaviest))
    place[order] = np.arange(many)
    at = place[row]
    by = np.argsort(at, kind="stable")
    at, term, worth = at[by], term[by], worth[by]
    ids, nulls = ids[order], nulls[order]
    leaves = -(-many // leaf)
    low = np.zeros((leaves, width))
    np.maximum.at(low.reshape(-1), at // leaf * width + term, worth)
    high = np.maximum.reduceat(low, np.arange(0, leaves, fan), axis=0)
    bounds = tree.unions @ high.T  # nodes of items by nodes of leaves
    weakest = np.minimum.reduceat(best.least, tree.edges[:-1])
    tried, scored = bounds.size, 0
    for h in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
        weakest = np.minimum.reduceat(best.least, tree.edges[:-1])
        nodes = np.flatnonzero((bounds[:, h] >= weakest) & (bounds[:, h] > 0))
        if not len(nodes):
            continue
        asked = np.concatenate([np.arange(tree.edges[g], tree.edges[g + 1]) for g in nodes.tolist()])
        below = np.arange(h * fan, min((h + 1) * fan, leaves))
        near = tree.sets[asked] @ low[below].T  # items by leaves
        tried += near.size
        for j in np.argsort(-near.max(axis=0), kind="stable").tolist():
            open_ = (near[:, j] >= best.least[asked]) & (near[:, j] > 0)
            if not open_.any():
                continue
            first = int(below[j]) * leaf
            last = min(first + leaf, many)
            a, z = np.searchsorted(at, (first, last))
            own = np.zeros((last - first, width))
            own[at[a:z] - first, term[a:z]] = worth[a:z]
            items = asked[open_]
            best.meet(items, tree.sets[items] @ own.T, ids[first:last], nulls[first:last])
            scored += len(items) * (last - first)
    return scored, tried


def ranked(found: DataFrame, tree: ItemTree, weights: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray, k: int, leaf: int, fan: int) -> DataFrame:
    """slot, doc_id, score, and on slot -1 the counted work (doc_id: scored pairs, score: node pairs): k rows a slot and task."""
    shared = found.sparkSession.sparkContext.broadcast((tree, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, least = shared.value
        best, work = Best(least, k), np.zeros(2, dtype=np.int64)
        for b in batches:
            for cut in range(0, b.num_rows, TREE):
                part = b.slice(cut, TREE)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                term = lists.flatten().to_numpy().astype(np.int64)
                times = part.column(3).flatten().to_numpy().astype(np.int64)
                m = 10 + (90 * part.column(1).to_numpy() * n_docs) // n_terms
                worth = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
                ids, nulls = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                work += dual_search(tree, best, row, term, worth.astype(np.float64), ids, nulls, leaf, fan)
        slot, at = np.nonzero(best.scores > 0)
        ids = pa.array(np.append(best.ids[slot, at], work[0]), mask=np.append(best.nulls[slot, at], False))
        scores = np.append(best.scores[slot, at].astype(np.int64), work[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(tree.order[slot], -1)), ids, pa.array(scores)], names=["slot", "doc_id", "score"])

    return found.mapInArrow(run, "slot long, doc_id long, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, leaf: int = 16, fan: int = 16, block_terms: int = BLOCK_TERMS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", work: bool = False,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, scores above 0; fewer where fewer match.

    Equal scores rank by ascending doc_id, null ids last.  Null and empty texts have no terms:
    such documents count for nothing and such items have no rows.  Each row of items is asked
    for itself, also where ids repeat or are null, and each row of docs is a document; an empty
    table gives no rows.  Other columns are not read.  With ``work`` it returns instead
    (n_items, n_docs, scored, tried): pairs of an item and a document that were scored, and
    pairs of nodes that were tried, a row a block of items.
    """
    spark, out, report = docs.sparkSession, None, []
    kind = items.select(item_id).schema[0].dataType
    for block in item_blocks(items, item_id, item_text, block_terms):
        terms = Terms(sorted({t for _, _, own in block for t in own}))
        path = scratch(spark, "vectors")
        made = vectors(docs, terms, id_col, text_col)
        made.write.option("compression", "zstd").parquet(path)
        found = spark.read.schema(made.schema).parquet(path)
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            drop_path(spark, path)
            continue
        held = holders(found, len(terms.words))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)
        if int(weights.max()) * 1_000_000 * max(len(own) for *_, own in block) >= 1 << 53:
            raise ValueError("an item has too many terms for exact sums")
        tree = ItemTree([[terms.place[t] for t in own] for _, _, own in block], weights.astype(np.float64), fan)
        least = np.zeros(len(block), dtype=np.int64)
        some = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(64)) == 0)
        place = {int(slot): i for i, slot in enumerate(tree.order)}
        first = _top(ranked(some, tree, weights, n_docs, n_terms, least, k, leaf, fan).filter("slot >= 0"), k)
        for slot, score in first.filter(F.col("rank") == k).select("slot", "score").collect():  # a row an item of the block
            least[place[slot]] = score
        rows = ranked(found, tree, weights, n_docs, n_terms, least, k, leaf, fan)
        if work:
            report.append((len(block), n_docs, *rows.filter("slot < 0").agg(F.sum("doc_id"), F.sum("score")).first()))
            drop_path(spark, path)
            continue
        best = scratch(spark, "ranked")
        _top(rows.filter("slot >= 0"), k).write.parquet(best)
        drop_path(spark, path)
        names = spark.createDataFrame([(i, name) for i, (_, name, _) in enumerate(block)], f"slot long, item_id {kind.simpleString()}")
        part = spark.read.parquet(best).join(F.broadcast(names), "slot").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    if work:
        return spark.createDataFrame(report, "n_items long, n_docs long, scored long, tried long")
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out
