"""Near-duplicate detection by order MinHash, verified by banded alignment.

A document is the sequence of its ``k``-word shingles.  A shingle that comes back is labelled
by its occurrence, so shingles of a document differ from one another.  Each of ``sketches``
hash orders samples the ``picked`` smallest labelled shingles and keeps them in the order of
the text; the sketch is a hash of that ordered tuple, so both content and order count.

Equal word sequences are one representative.  Representatives that share a sketch meet in a
bucket; a bucket is never expanded into its pairs.  First each meets the most central hubs of
its buckets - a hub is the member that meets the most others over all sketches, which is the
original among its edited copies.  Once these links are joined, members of a bucket that are
still in different classes are compared in blocks by a parity bitmap of their shingles, which
drops pairs that cannot be similar enough.  Of the others a spanning forest of each block is
verified, and, where that did not join them, all that are left.  So the links grow with the
members, not with their pairs, and classes are whole for all pairs that share a sketch.

Each candidate is verified once, by whole texts: with ``m`` shingles matched in order within
the band, similarity is ``m / (n1 + n2 - m)``, an ordered Jaccard.  At similarity t no more
than ``(n1 + n2) * (1 - t) / (1 + t)`` shingles are unmatched, which is the band's width; it
loses nothing.  Labelled shingles are unique, so the alignment is a longest increasing chain.

Verified links are joined into classes by connected components.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, P, cut, fresh, hashed_words, mix, windows
from .components import components

#: Bits of a document's parity bitmap, and members of a bucket in a block.
_BITS, _BLOCK = 2048, 512


def shingles(text: str | None, k: int = 5) -> tuple[bytes, np.ndarray]:
    """Digest of the words, and the labelled shingles in order; fewer than k words are one."""
    word = hashed_words(text)[3]
    if not len(word):
        return b"", np.empty(0, dtype=np.uint64)
    grams = windows(word, min(k, len(word)))
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if same.any():
        run = np.arange(len(grams))
        start = np.concatenate(([True], ~same))
        nth = np.empty(len(grams), dtype=np.uint64)
        nth[order] = (run - np.maximum.accumulate(np.where(start, run, 0))).astype(np.uint64)
        grams = np.where(nth > 0, mix(grams + nth * P), grams)
    return hashlib.blake2b(word.tobytes(), digest_size=16).digest(), grams


class OrderSketch:
    """Order MinHash sketches of labelled shingles."""

    def __init__(self, sketches: int = 16, picked: int = 3, seed: int = 1):
        self.picked = picked
        self.mult = np.random.default_rng(seed).integers(1, 2**63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.mult), dtype=np.uint64)
        many = max(1, 200_000 // max(1, len(grams)))
        for j in range(0, len(self.mult), many):
            out[j : j + many] = self._block(grams, self.mult[j : j + many])
        return mix(out)

    def _block(self, grams: np.ndarray, mult: np.ndarray) -> np.ndarray:
        ranks = grams[None, :] * mult[:, None]
        ranks ^= ranks >> np.uint64(29)
        ranks *= MIX[0]
        picked = self.picked
        if len(grams) > picked:
            at = np.sort(np.argpartition(ranks, picked - 1, axis=1)[:, :picked], axis=1)  # text order
        else:
            at = np.broadcast_to(np.arange(len(grams)), (len(mult), len(grams)))
        h = np.zeros(len(mult), dtype=np.uint64)
        for j in range(at.shape[1]):
            h = h * P + grams[at[:, j]]
        return h


def ordered_similarity(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """m / (n1 + n2 - m) by banded alignment of labelled shingles; 0 where it is below least."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n * (1 - least) / (1 + least)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least * (n - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    similarity = m / (n - m)
    return similarity if similarity >= least else 0.0


def parity(grams: np.ndarray) -> bytes:
    """Bitmap of the parity of shingles by hash: two differ in no more bits than the sets do in shingles."""
    at = (mix(grams) % np.uint64(_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=_BITS) & 1).astype(np.uint8)).tobytes()


def sketched(docs: DataFrame, k: int, sketcher: OrderSketch, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, sketch, size, bits of every document that has an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, digests, sketches, sizes, bits = [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    digest, grams = shingles(text.as_py(), k)
                    if len(grams):
                        ids.append(i)
                        digests.append(digest)
                        sketches.append(sketcher.of(grams).view(np.int64))
                        sizes.append(len(grams))
                        bits.append(parity(grams))
                flat = np.concatenate(sketches) if sketches else np.empty(0, dtype=np.int64)
                width = len(sketcher.mult)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), pa.array(flat)),
                        pa.array(sizes, pa.int64()),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["doc_id", "digest", "sketch", "size", "bits"],
                )

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, sketch array<long>, size long, bits binary")


def buckets(reps: DataFrame) -> DataFrame:
    """rep, band, key, n of the members of buckets of two or more."""
    bands = reps.select("rep", F.posexplode("sketch").alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(bands.join(full, ["band", "key"]))


def star(met: DataFrame, hubs: int) -> DataFrame:
    """Pairs (a, b), a < b, of each representative with the ``hubs`` most central hubs of its buckets.

    Members may tie; each bucket draws among the tied, so over the sketches many are hubs.
    """
    central = met.groupBy("rep").agg(F.sum("n").alias("central"))
    best = F.max(F.struct("central", F.xxhash64("rep", "band").alias("draw"), F.col("rep").alias("hub"))).alias("h")
    of = met.join(central, "rep").groupBy("band", "key").agg(best)
    mine = met.join(of, ["band", "key"]).filter("rep <> h.hub").groupBy("rep").agg(F.collect_set(F.struct("h.central", "h.hub")).alias("hubs"))  # a sketch each at most
    pairs = mine.select("rep", F.explode(F.slice(F.sort_array("hubs", asc=False), 1, hubs)["hub"]).alias("hub"))
    return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def spanning(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a cheapest spanning forest, ties to the earlier edge."""
    order = np.argsort(cost, kind="stable")
    nodes, ends = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    u, v = ends[: len(order)], ends[len(order) :]
    root, chosen = np.arange(len(nodes)), []
    while True:
        open_ = np.flatnonzero(root[u] != root[v])
        if not len(open_):
            return order[np.array(sorted(chosen), dtype=np.int64)]
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, root[u[open_]], open_)
        np.minimum.at(first, root[v[open_]], open_)
        for e in np.unique(first[first < len(order)]).tolist():
            x, y = root[u[e]], root[v[e]]
            if x != y:
                root[root == y] = x
                chosen.append(e)


def pairs_apart(met: DataFrame, reps: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of the two members of a bucket in different classes, once each, as ``apart`` gives them."""
    own = met.filter("n = 2").join(classes, F.col("rep") == F.col("node"), "left").select("rep", "band", "key", F.coalesce("class_id", "rep").alias("class"))
    two = own.groupBy("band", "key").agg(F.min(F.struct("rep", "class")).alias("x"), F.max(F.struct("rep", "class")).alias("y")).filter("x.class <> y.class")
    pairs = two.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    of = lambda x: reps.select(F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint64).reshape(-1, _BITS // 64) for c in (2, 3))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(differ <= b.column(4).to_numpy() * share + 1e-6))

    return sized.select("a", "b", "bits_a", "bits_b", (F.col("size_a") + F.col("size_b")).alias("both")).mapInArrow(run, "a long, b long")


def apart(met: DataFrame, reps: DataFrame, classes: DataFrame, least: float, forest: bool) -> DataFrame:
    """Pairs (a, b), a < b, that share a bucket and no class, but for those that cannot be similar enough.

    Of two members in different classes one is outside the bucket's largest class; so blocks of
    those outside meet blocks of all.  With ``forest`` a block gives only the pairs, most alike
    first, that would join its classes if all of them held: fewer than it has members.
    """
    own = met.filter("n > 2").join(classes, F.col("rep") == F.col("node"), "left")  # two are a pair: pairs_apart
    own = own.select("rep", "band", "key", F.coalesce("class_id", "rep").alias("class"))
    sized = own.groupBy("band", "key", "class").agg(F.count("*").alias("c")).groupBy("band", "key")
    sized = sized.agg(F.count("*").alias("classes"), F.max(F.struct("c", "class")).alias("main"), F.sum("c").alias("n")).filter("classes > 1")
    blocks = lambda n: F.ceil(n / _BLOCK).cast("int")
    mixed = own.join(sized, ["band", "key"]).select(
        "rep", "band", "key", "class", (F.col("class") != F.col("main.class")).alias("outside"), blocks(F.col("n") - F.col("main.c")).alias("lefts"), blocks(F.col("n")).alias("rights")
    )
    mixed = cut(mixed).join(reps.select("rep", "size", "bits"), "rep")
    block = lambda of: F.pmod(F.xxhash64("rep", "band"), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = mixed.filter("outside").withColumn("l", block("lefts")).withColumn("r", spread("rights")).withColumn("is_left", F.lit(1).cast("long"))
    right = mixed.withColumn("r", block("rights")).withColumn("l", spread("lefts")).withColumn("is_left", F.lit(0).cast("long"))
    rows = left.unionByName(right).select(F.xxhash64("band", "key", "l", "r").alias("group"), "is_left", "rep", "class", "size", "bits")
    share = (1 - least) / (1 + least)

    def meet(rows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lefts, rights, found = np.flatnonzero(rows[1] == 1), np.flatnonzero(rows[1] == 0), []
        many = max(1, 8192 // max(1, len(rights)))
        for at in range(0, len(lefts), many):
            part = lefts[at : at + many]
            both = rows[4][part][:, None] + rows[4][rights][None]
            differ = np.bitwise_count(bits[part][:, None] ^ bits[rights][None]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero((differ <= both * share + 1e-6) & (rows[3][part][:, None] != rows[3][rights][None]))
            found.append(np.stack((part[i], rights[j], differ[i, j])))
        a, b, cost = np.concatenate(found, axis=1) if found else np.empty((3, 0), dtype=np.int64)
        if forest:
            keep = spanning(rows[3][a], rows[3][b], cost)
            a, b = a[keep], b[keep]
        return rows[2][a], rows[2][b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rest_bits = np.empty((5, 0), dtype=np.int64), np.empty((0, _BITS // 64), dtype=np.uint64)

        def pairs(edges: np.ndarray) -> pa.RecordBatch:
            found = [meet(rest[:, a:z], rest_bits[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            a, b = (np.concatenate([p[i] for p in found]) if found else np.empty(0, dtype=np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            rest = np.concatenate((rest, np.stack([b.column(i).to_numpy() for i in range(5)])), axis=1)
            rest_bits = np.concatenate((rest_bits, np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint64).reshape(-1, _BITS // 64)))
            edges = np.concatenate(([0], np.flatnonzero(rest[0][1:] != rest[0][:-1]) + 1))
            yield pairs(edges)
            rest, rest_bits = rest[:, edges[-1] :], rest_bits[edges[-1] :]
        yield pairs(np.array([0, rest.shape[1]]))

    ordered = rows.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, k: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """a, b, similarity of the pairs whose whole texts are similar enough."""
    text = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    both = (
        pairs.join(text.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .join(text.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        .select("a", "b", "body_a", "body_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]  # a hub's text comes back
        for b in batches:
            a_ids, b_ids, found = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i in range(b.num_rows):
                text = b.column(3)[i].as_py()
                if last[0] != text:
                    last = [text, shingles(text, k)[1]]
                found.append(ordered_similarity(shingles(b.column(2)[i].as_py(), k)[1], last[1], least))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64()), pa.array(found, pa.float64())],
                names=["a", "b", "similarity"],
            )

    found = both.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") > 0)
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    least: float = 0.8,
    sketches: int = 32,
    picked: int = 3,
    hubs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id, rep_id: one row per document.

    class_id is the smallest id of the class; rep_id the smallest id of the same words.
    Documents without words (null, empty, marks only) and rows without an id are near nothing:
    their class is their own id.  Rows that share an id are one document, in the smallest of
    their texts' classes; an empty table gives no rows.  Other columns are not read.
    """
    made = cut(sketched(docs, k, OrderSketch(sketches, picked), id_col, text_col))
    reps = cut(made.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("sketch", "size", "bits")]))
    met = buckets(reps.select("rep", "sketch"))
    tried = cut(star(met, hubs))
    links = cut(verified(docs, tried, k, least, id_col, text_col))
    classes = components(links)
    for forest in (True, False):
        found = cut(apart(met, reps, classes, least, forest).union(pairs_apart(met, reps, classes, least)).distinct())
        if found.isEmpty():
            break
        left = cut(found.join(tried, ["a", "b"], "left_anti"))
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")
        more = cut(verified(texts, left, k, least, "id", "text"))
        if not more.isEmpty():
            links, tried = links.unionAll(more), tried.unionAll(left)
            classes = components(links)
    named = reps.select("digest", "rep").join(classes, F.col("rep") == F.col("node"), "left").drop("node")
    member = made.select("doc_id", "digest").join(named, "digest")
    of_words = member.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("class_id", "rep").alias("class_id"), "rep")).alias("m"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    out = ids.join(of_words, "doc_id", "left")
    return out.select("doc_id", F.coalesce("m.class_id", "doc_id").alias("class_id"), F.coalesce("m.rep", "doc_id").alias("rep_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of docs without those near another of a smaller id in their class; columns stay."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    other = fresh(docs, "other")
    others = classes.filter("doc_id != class_id").select(F.col("doc_id").alias(other))
    return docs.join(others, F.col(id_col) == F.col(other), "left_anti")
