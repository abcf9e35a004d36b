"""Compressed codes: scalar, product, rotated, residual and sign codes, and searches over them.

Codes are columns next to ids; books, ranges and rotations are small and live on the driver.
Encoding and decoding are expressions, so a code scan reads the code column only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, require
from ..functions.vector import dot, doubles, squared_l2, subtract, top, total
from ..plans.lineage import materialise
from .exact import BLOCK_NUMBERS, RESULT, matrix, pair_scores, query_blocks, scan_top, score_matrix, search, smallest, top_up
from .index import Found, Index, stats_row
from .kmeans import _sample, local_lloyd, mean_vector


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def rerank(queries: DataFrame, corpus: DataFrame, shortlist: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact scores of a shortlist (qid, id), the k best of each query."""
    return top(pair_scores(shortlist.select("qid", "id"), queries, corpus, metric), k, metric)


reranked = rerank


def code_column(rows: DataFrame, shared, encode) -> DataFrame:
    """(id, codes) of rows (id, v): ``encode(shared.value, matrix)`` gives a row of ints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = encode(shared.value, matrix(b.column(1))).astype(np.int32)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))], names=["id", "codes"])

    return rows.select(F.col("id").cast("long").alias("id"), "v").filter(F.col("v").isNotNull()).mapInArrow(run, "id long, codes array<int>")


def decoded_column(codes: DataFrame, shared, decode) -> DataFrame:
    """(id, v) of codes (id, codes): ``decode(shared.value, codes)`` gives the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = decode(shared.value, matrix(b.column(1)).astype(np.int64))
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))], names=["id", "v"])

    return codes.select(F.col("id").cast("long").alias("id"), "codes").mapInArrow(run, "id long, v array<double>")


def _closest(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, ties to the smaller code; differences, not norms, decide."""
    step, out = max(1, 2_000_000 // max(1, book.size)), np.empty(len(v), dtype=np.int64)
    for at in range(0, len(v), step):
        out[at : at + step] = ((v[at : at + step, None, :] - book[None]) ** 2).sum(2).argmin(1)
    return out


# -- scalar ------------------------------------------------------------------------------------


@dataclass
class ScalarCodes:
    """(id, codes 0..255, scale, low): one range for all, or a range a row."""

    frame: DataFrame
    per_vector: bool

    def decoded(self) -> DataFrame:
        return self.frame.select("id", F.transform("codes", lambda c: c * F.col("scale") + F.col("low")).alias("v"))


def quantise_column(v: Column, low: Column, span: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.rint((x - low) / span * 255).cast("int"))))


def scalar_quantise(vectors: DataFrame, per_vector: bool = False) -> ScalarCodes:
    """Affine codes, rounded half to even; a span below 1e-12 counts as 1e-12."""
    if per_vector:
        low, high = F.array_min(doubles("v")), F.array_max(doubles("v"))
    else:
        r = vectors.agg(F.min(F.array_min(doubles("v"))), F.max(F.array_max(doubles("v")))).first()
        require(r[0] is not None, "no vectors")
        low, high = F.lit(r[0]), F.lit(r[1])
    ranged = vectors.select("id", "v", low.alias("low"), F.greatest(high - low, F.lit(1e-12)).alias("span"))
    frame = ranged.select("id", quantise_column(F.col("v"), F.col("low"), F.col("span")).alias("codes"), (F.col("span") / 255).alias("scale"), "low")
    return ScalarCodes(frame, per_vector)


def reconstruction_error(vectors: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row: error, the mean squared distance of vectors and their decoded rows."""
    both = vectors.select("id", "v").join(decoded.select("id", F.col("v").alias("r")), "id")
    return both.agg(F.avg(squared_l2("v", "r")).alias("error"))


def scalar_search(queries: DataFrame, codes: ScalarCodes, k: int = 10, symmetric: bool = False) -> DataFrame:
    """Top k by squared L2 to decoded rows; symmetric: queries are coded on their own range."""
    if symmetric:
        own = scalar_quantise(queries.select(F.col("qid").alias("id"), F.col("q").alias("v")), codes.per_vector).decoded()
        queries = own.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return search(queries, codes.decoded(), k)


# -- product -----------------------------------------------------------------------------------


@dataclass
class ProductBooks:
    """books[subspace, code] of width w."""

    books: np.ndarray

    @property
    def subspaces(self) -> int:
        return self.books.shape[0]

    @property
    def centroids(self) -> int:
        return self.books.shape[1]

    @property
    def dimension(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def code_bytes(self) -> int:
        return self.subspaces

    def _shared(self, frame: DataFrame):
        return frame.sparkSession.sparkContext.broadcast(self.books)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(id, codes): the nearest entry of each slice, ties to the smaller code."""

        def encode(books: np.ndarray, v: np.ndarray) -> np.ndarray:
            w = books.shape[2]
            return np.stack([_closest(v[:, s * w : (s + 1) * w], book) for s, book in enumerate(books)], axis=1)

        return code_column(vectors, self._shared(vectors), encode)

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, v): the entries of the codes, joined."""
        return decoded_column(codes, self._shared(codes), lambda books, c: np.concatenate([book[c[:, s]] for s, book in enumerate(books)], axis=1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, slice, code]: squared distances of queries' slices to all entries."""
        w = self.books.shape[2]
        return np.stack([((q[:, None, s * w : (s + 1) * w] - book[None]) ** 2).sum(2) for s, book in enumerate(self.books)], axis=1)

    def table(self, queries: DataFrame) -> DataFrame:
        """(qid, t): the same as a column of arrays, for joins with lists of codes."""
        shared = self._shared(queries)
        s, c, w = self.books.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = ProductBooks(shared.value)
            for b in batches:
                if b.num_rows:
                    t = own.tables(matrix(b.column(1))).reshape(-1)
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows * s + 1, dtype=np.int32) * c), pa.array(t))
                    outer = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * s), inner)
                    yield pa.RecordBatch.from_arrays([b.column(0), outer], names=["qid", "t"])

        kind = T.StructType([queries.select("qid").schema[0], T.StructField("t", T.ArrayType(T.ArrayType(T.DoubleType())))])
        return queries.select("qid", "q").mapInArrow(run, kind)

    def search(self, queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
        """Top k by sums of table entries (asymmetric distances), queries in broadcast blocks."""

        def scores(tables: np.ndarray, column: pa.Array) -> np.ndarray:
            c = matrix(column).astype(np.int64)
            out = np.zeros((len(tables), len(c)))
            for s in range(tables.shape[1]):
                out += tables[:, s, :][:, c[:, s]]
            return np.round(out, 9)  # sums of like terms tie, whatever their order

        found, spark = None, codes.sparkSession
        numbers = max(1, BLOCK_NUMBERS // max(1, self.subspaces * self.centroids // max(1, self.dimension)))
        for qids, q in query_blocks(queries, numbers, kept=k):
            shared = spark.sparkContext.broadcast((qids, self.tables(q)))
            part = scan_top(codes.select(F.col("id").cast("long"), "codes"), shared, k, scores)
            found = part if found is None else found.unionAll(part)
        return top(found if found is not None else spark.createDataFrame([], RESULT), k)


def product_train(vectors: DataFrame, subspaces: int = 8, centroids: int = 256, sample: int = 20_000, rounds: int = 15, seed: int = 0) -> ProductBooks:
    """Books by k-means of each slice over a bounded sample."""
    v = _sample(vectors, sample, seed)
    require(len(v) > 0 and v.shape[1] % subspaces == 0, f"{subspaces} slices of width {v.shape[1] if len(v) else 0}")
    require(centroids <= len(v), f"{centroids} entries from {len(v)} rows")
    w = v.shape[1] // subspaces
    return ProductBooks(np.stack([local_lloyd(v[:, s * w : (s + 1) * w].copy(), centroids, rounds, seed + s)[0] for s in range(subspaces)]))


# -- rotations ---------------------------------------------------------------------------------


def identity_rotation(dimension: int) -> np.ndarray:
    return np.eye(dimension)


def random_rotation(dimension: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (population) and rows; tasks send sums of products, width^2 numbers."""

    def run(batches):
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(0))
                n, s, ss = n + len(v), s + v.sum(0), ss + v.T @ v
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "x": np.concatenate((s, ss.reshape(-1))).tolist()}], schema=pa.schema([("n", pa.int64()), ("x", pa.list_(pa.float64()))]))

    made = vectors.select("v").mapInArrow(run, "n long, x array<double>").select("n", F.posexplode("x").alias("i", "x"))
    rows = made.groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()
    require(bool(rows), "no vectors")
    x, n = np.array([r.x for r in rows]), rows[0].n
    d = int((np.sqrt(4 * len(x) + 1) - 1) / 2)
    mean = x[:d] / n
    return mean, x[d:].reshape(d, d) / n - np.outer(mean, mean), n


def pca_rotation(vectors: DataFrame, subspaces: int = 8) -> np.ndarray:
    """Principal directions dealt to the slices in turn, so that all carry like variance."""
    _, cov, _ = covariance(vectors)
    d = len(cov)
    require(d % subspaces == 0, f"{subspaces} slices of width {d}")
    _, directions = np.linalg.eigh(cov)
    ordered = directions[:, ::-1].T
    return np.concatenate([ordered[s::subspaces] for s in range(subspaces)])


def rotate(vectors: DataFrame, rotation: np.ndarray, column: str = "v") -> DataFrame:
    rows = [dot(F.col(column), literal(r)) for r in rotation]
    return vectors.withColumn(column, F.array(*rows))


@dataclass
class Rotated:
    books: ProductBooks
    rotation: np.ndarray

    def encode(self, vectors: DataFrame) -> DataFrame:
        return self.books.encode(rotate(vectors, self.rotation))

    def search(self, queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
        return self.books.search(rotate(queries, self.rotation, "q"), codes, k)


def train_rotated(vectors: DataFrame, subspaces: int = 8, centroids: int = 256, rotation: str = "pca", seed: int = 0) -> Rotated:
    d = len(vectors.first().v)
    kinds = {"none": lambda: identity_rotation(d), "random": lambda: random_rotation(d, seed), "pca": lambda: pca_rotation(vectors, subspaces)}
    require(rotation in kinds, f"rotation {rotation!r}")
    r = kinds[rotation]()
    return Rotated(product_train(rotate(vectors, r), subspaces, centroids, seed=seed), r)


def subspace_variance(vectors: DataFrame, subspaces: int) -> DataFrame:
    """(sub, variance): population variances of coordinates, summed by slice."""
    d = len(vectors.first().v)
    each = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("var"))
    return each.groupBy(F.floor(F.col("dim") / (d // subspaces)).cast("int").alias("sub")).agg(F.sum("var").alias("variance"))


def variance_balance(vectors: DataFrame, subspaces: int) -> DataFrame:
    """One row: balance, the smallest slice variance over the largest."""
    return subspace_variance(vectors, subspaces).agg((F.min("variance") / F.max("variance")).alias("balance"))


# -- residual ----------------------------------------------------------------------------------


@dataclass
class ResidualBooks:
    """books[stage, code] of full width."""

    books: np.ndarray

    def _shared(self, frame: DataFrame):
        return frame.sparkSession.sparkContext.broadcast(self.books)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(id, codes): the nearest entry to what earlier stages left, ties to the smaller code."""

        def encode(books: np.ndarray, left: np.ndarray) -> np.ndarray:
            out = []
            for book in books:
                out.append(_closest(left, book))
                left = left - book[out[-1]]
            return np.stack(out, axis=1)

        return code_column(vectors, self._shared(vectors), encode)

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, v): the sum of the chosen entries."""
        return decoded_column(codes, self._shared(codes), lambda books, c: sum(book[c[:, s]] for s, book in enumerate(books[: c.shape[1]])))

    def search(self, queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
        """Top k by squared distance to the decoded rows: tables of products of queries and entries, and the rows' lengths."""

        def scores(asked: tuple[np.ndarray, np.ndarray], column: pa.Array) -> np.ndarray:
            q, books = asked
            c = matrix(column).astype(np.int64)
            rows = sum(book[c[:, s]] for s, book in enumerate(books))
            dots = sum((q @ book.T)[:, c[:, s]] for s, book in enumerate(books))
            return np.round(np.maximum((q * q).sum(1)[:, None] + (rows * rows).sum(1)[None] - 2 * dots, 0.0), 9)

        found, spark = None, codes.sparkSession
        for qids, q in query_blocks(queries, kept=k):
            shared = spark.sparkContext.broadcast((qids, (q, self.books)))
            part = scan_top(codes.select(F.col("id").cast("long"), "codes"), shared, k, scores)
            found = part if found is None else found.unionAll(part)
        return top(found if found is not None else spark.createDataFrame([], RESULT), k)

    def bytes_per_vector(self) -> float:
        return len(self.books) * np.ceil(np.log2(max(2, self.books.shape[1]))) / 8

    def effective_entries(self) -> int:
        return self.books.shape[1] ** len(self.books)


def residual_fit(vectors: DataFrame, stages: int = 2, entries: int = 256, sample: int = 20_000, rounds: int = 15, seed: int = 0) -> ResidualBooks:
    """Books by k-means on what earlier stages left, over a bounded sample."""
    left = _sample(vectors, sample, seed)
    require(stages >= 1 and entries <= len(left), f"{stages} stages of {entries} entries from {len(left)} rows")
    books = []
    for s in range(stages):
        book, _ = local_lloyd(left, entries, rounds, seed + s)
        books.append(book)
        left = left - book[score_matrix(left, book, "l2").argmin(1)]
    return ResidualBooks(np.stack(books))


def residual_norms(vectors: DataFrame, books: ResidualBooks, codes: DataFrame) -> DataFrame:
    """(stage, left): mean residual norm after each stage over the mean norm."""
    both = vectors.select("id", "v").join(codes, "id")
    out = None
    for s in range(1, len(books.books) + 1):
        part = ResidualBooks(books.books[:s]).decode(codes.select("id", F.slice("codes", 1, s).alias("codes"))).withColumnRenamed("v", "r")
        row = both.join(part, "id").agg((F.avg(F.sqrt(squared_l2("v", "r"))) / F.avg(F.sqrt(dot("v", "v")))).alias("left")).select(F.lit(s).alias("stage"), "left")
        out = row if out is None else out.unionAll(row)
    return out


# -- signs -------------------------------------------------------------------------------------


def words_needed(dimension: int) -> int:
    require(dimension >= 1, "dimension must be at least 1")
    return -(-dimension // 64)


def pack(bits: Column, dimension: int) -> Column:
    """An array of booleans as 64-bit words, bit i of a word its i-th boolean."""
    words = []
    for w in range(words_needed(dimension)):
        part = F.slice(bits, 64 * w + 1, min(64, dimension - 64 * w))
        words.append(F.aggregate(F.transform(part, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.array(*words)


def unpack(words: Column, dimension: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.call_function("shiftrightunsigned", F.get(words, F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1,
    )


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def angle_from_hamming(distance: Column, dimension: int) -> Column:
    return distance / F.lit(float(dimension)) * F.lit(float(np.pi))


@dataclass
class SignCodes:
    """Centre and rotation that signs are taken after; either may be absent."""

    dimension: int
    centre: np.ndarray | None = None
    rotation: np.ndarray | None = None

    def _bits(self, v: Column) -> Column:
        v = doubles(v)
        if self.centre is not None:
            v = subtract(v, literal(self.centre))
        if self.rotation is not None:
            v = F.array(*[dot(v, literal(r)) for r in self.rotation])
        return F.transform(v, lambda x: x > 0)

    def encode(self, rows: DataFrame, ids: str = "id", column: str = "v") -> DataFrame:
        return rows.select(ids, pack(self._bits(F.col(column)), self.dimension).alias("words"))

    def search(self, queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
        """Top k by Hamming distance, ties by id; coded queries are broadcast in blocks."""

        def scores(asked: np.ndarray, column: pa.Array) -> np.ndarray:
            words = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).view(np.uint64)
            asked = asked.view(np.uint64)  # counts of signed numbers are of their magnitudes
            return sum(np.bitwise_count(asked[:, None, w] ^ words[None, :, w]).astype(np.float64) for w in range(words.shape[1]))

        coded = self.encode(queries, "qid", "q").withColumnRenamed("words", "q")
        found, spark = None, codes.sparkSession
        for qids, words in query_blocks(coded, kind=np.int64, kept=k):
            shared = spark.sparkContext.broadcast((qids, words))
            part = scan_top(codes.select(F.col("id").cast("long"), "words"), shared, k, scores)
            found = part if found is None else found.unionAll(part)
        return top(found if found is not None else spark.createDataFrame([], RESULT), k)


def sign_fit(vectors: DataFrame, centre: bool = True, rotate_by: str = "none", seed: int = 0) -> SignCodes:
    d = len(vectors.first().v)
    kinds = {"none": lambda: None, "random": lambda: random_rotation(d, seed), "pca": lambda: pca_rotation(vectors, 1)}
    require(rotate_by in kinds, f"rotation {rotate_by!r}")
    return SignCodes(d, mean_vector(vectors) if centre else None, kinds[rotate_by]())


class _CodeIndex(Index):
    """A scan over codes at a weight, and an exact second stage if ``rerank`` is above 0."""

    weight = 1.0

    def __init__(self, dimension: int, rerank: int = 0):
        super().__init__(dimension)
        require(rerank >= 0, "rerank can't be negative")
        self.rerank = rerank
        self.codes: DataFrame | None = None

    def _scan(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def live_codes(self) -> DataFrame:
        return self.codes if self.dead is None else self.codes.join(self.dead, "id", "left_anti")

    def search(self, queries: DataFrame, k: int = 10, rerank: int | None = None) -> Found:
        n = self.check_queries(queries, k)
        depth = self.rerank if rerank is None else rerank
        if depth and depth < k:
            raise ConfigError(f"rerank {depth} is below k {k}")
        if depth >= self.size:  # a shortlist of all rows needs no codes
            found = search(queries, self.live(), k)
        else:
            found = self._scan(queries, max(k, depth))
            if depth:
                found = top_up(reranked(queries, self.rows, found, k), queries, self.live(), k)
        spent = n * (self.capacity * self.weight + depth)
        return Found(found, stats_row(queries.sparkSession, spent, self.capacity * n, 0, n))


class ResidualIndex(_CodeIndex):
    name = "residual"
    weight = 0.5

    def __init__(self, dimension: int, stages: int = 2, entries: int = 256, rerank: int = 0, seed: int = 0):
        super().__init__(dimension, rerank)
        self.stages, self.entries, self.seed = stages, entries, seed

    def build(self, vectors: DataFrame, books: ResidualBooks | None = None) -> ResidualIndex:
        self._count = self.check_vectors(vectors)
        self.rows, self.dead = vectors.select(F.col("id").cast("long").alias("id"), "v"), None
        self.books = residual_fit(vectors, self.stages, self.entries, seed=self.seed) if books is None else books
        self.codes = materialise(self.books.encode(self.rows))
        return self

    def _append(self, vectors: DataFrame) -> None:
        super()._append(vectors)
        self.codes = self.codes.unionByName(materialise(self.books.encode(vectors)))

    def _scan(self, queries: DataFrame, k: int) -> DataFrame:
        return self.books.search(queries, self.live_codes(), k)


class BinaryIndex(_CodeIndex):
    name = "binary"
    weight = 1 / 32

    def __init__(self, dimension: int, rerank: int = 0, centre: bool = True, rotate: str = "none", seed: int = 0):
        super().__init__(dimension, rerank)
        self.centre, self.rotate, self.seed = centre, rotate, seed

    def build(self, vectors: DataFrame) -> BinaryIndex:
        self._count = self.check_vectors(vectors)
        self.rows, self.dead = vectors.select(F.col("id").cast("long").alias("id"), "v"), None
        self.signs = sign_fit(vectors, self.centre, self.rotate, self.seed)
        self.codes = materialise(self.signs.encode(self.rows))
        return self

    def _append(self, vectors: DataFrame) -> None:
        super()._append(vectors)
        self.codes = self.codes.unionByName(materialise(self.signs.encode(vectors)))

    def _scan(self, queries: DataFrame, k: int) -> DataFrame:
        return self.signs.search(queries, self.live_codes(), k)


# -- composite ---------------------------------------------------------------------------------


class CompositeIndex(Index):
    """Lists of product codes of residuals: open lists, shortlist by codes, exact second stage."""

    name = "composite"

    def __init__(self, dimension: int, partitions: int = 64, subspaces: int = 8, centroids: int = 256, probe: int = 8, shortlist: int = 100, residual: bool = True, seed: int = 0):
        super().__init__(dimension)
        require(dimension % subspaces == 0, f"{subspaces} slices of width {dimension}")
        require(1 <= probe <= partitions and shortlist >= 1, f"probe {probe} of {partitions}, shortlist {shortlist}")
        self.partitions, self.subspaces, self.centroids = partitions, subspaces, centroids
        self.probe, self.shortlist, self.residual, self.seed = probe, shortlist, residual, seed

    def build(self, vectors: DataFrame, centres: np.ndarray | None = None, books: ProductBooks | None = None) -> CompositeIndex:
        from .kmeans import fit_on_sample

        self._count = self.check_vectors(vectors)
        self.rows, self.dead = vectors.select(F.col("id").cast("long").alias("id"), "v"), None
        self.centres = fit_on_sample(vectors, self.partitions, seed=self.seed).centres if centres is None else centres
        filed = self._residuals(self.rows)
        self.books = product_train(filed, self.subspaces, min(self.centroids, self._count), seed=self.seed) if books is None else books
        self.lists = materialise(self._coded(filed))
        return self

    def _residuals(self, vectors: DataFrame) -> DataFrame:
        from .kmeans import assign

        filed = assign(vectors, self.centres)
        if not self.residual:
            return filed.select("id", "part", "v")
        centre = F.get(F.array(*[literal(c) for c in self.centres]), F.col("part"))
        return filed.select("id", "part", subtract("v", centre).alias("v"))

    def _coded(self, filed: DataFrame) -> DataFrame:
        return filed.select("id", "part").join(self.books.encode(filed), "id")

    def _append(self, vectors: DataFrame) -> None:
        super()._append(vectors)
        self.lists = self.lists.unionByName(materialise(self._coded(self._residuals(vectors))))

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> Found:
        """Shortlists by codes in one scan of the opened lists, then the shortlist's exact distances.

        A block of queries is broadcast with the lists that each opens; a task makes the tables
        of a list's residuals where it meets the list and keeps ``shortlist`` rows a query, so no
        scored row is shuffled beyond these.  Queries whose opened lists hold no more rows than a
        shortlist need no codes: these rows are scored exactly where they lie.
        """
        from .ivf import ivf_search, opened_rows, probes
        from .kmeans import assign

        n, probe = self.check_queries(queries, k), probe or self.probe
        require(1 <= probe <= self.partitions, f"probe {probe} of {self.partitions}")
        lists = self.lists if self.dead is None else self.lists.join(self.dead, "id", "left_anti")
        depth = max(k, min(self.shortlist, self.capacity))
        opened = materialise(probes(queries, self.centres, probe).select("qid", "part"))
        met, sizes = opened_rows(opened, lists), materialise(lists.groupBy("part").agg(F.count("*").alias("n")))
        held = opened.join(F.broadcast(sizes), "part", "left").groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        over = materialise(held.filter(F.col("n") > depth).select("qid"))
        found = ivf_search(queries.join(over, "qid", "left_anti"), assign(self.live(), self.centres).select("part", "id", "v"), self.centres, k, probe)
        if not over.isEmpty():
            asked = queries.join(over, "qid", "left_semi")
            found = found.unionAll(rerank(asked, self.rows, self.shortlisted(asked, lists, depth, probe), k))
        cost = met.select(
            (F.col("n") * (self.subspaces / self.dimension) + float(n * (self.partitions + self.shortlist))).alias("distances"),
            F.col("n").alias("candidates"), F.lit(n * probe).cast("long").alias("hops"), F.lit(n).cast("long").alias("queries"),
        )
        return Found(found, cost)

    def shortlisted(self, queries: DataFrame, lists: DataFrame, depth: int, probe: int) -> DataFrame:
        """(qid, rank, id, score): the ``depth`` rows of smallest code distance in each query's opened lists."""
        spark, found, residual = queries.sparkSession, None, self.residual
        rows = lists.select(F.col("part").cast("int").alias("part"), F.col("id").cast("long").alias("id"), "codes")
        for qids, q in query_blocks(queries, kept=depth):
            near = np.argsort(score_matrix(q, self.centres, "l2"), axis=1, kind="stable")[:, :probe]
            opened = {int(p): np.flatnonzero((near == p).any(1)) for p in np.unique(near)}
            shared = spark.sparkContext.broadcast((qids, q, opened, self.centres, self.books.books))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qids, q, opened, centres, books = shared.value
                best, ids = np.full((len(qids), depth), np.inf), np.full((len(qids), depth), np.iinfo(np.int64).max)
                for b in batches:
                    parts = b.column(0).to_numpy()
                    for part in np.unique(parts).tolist():
                        own = b.filter(pa.array(parts == part))
                        codes, names = matrix(own.column(2)).astype(np.int64), own.column(1).to_numpy()
                        for cut in range(0, len(opened.get(part, ())), 512):  # a table holds width numbers a query
                            at = opened[part][cut : cut + 512]
                            tables = ProductBooks(books).tables(q[at] - centres[part] if residual else q[at])
                            new = np.zeros((len(at), len(codes)))
                            for s in range(tables.shape[1]):
                                new += tables[:, s, :][:, codes[:, s]]
                            both = np.concatenate((best[at], np.round(new, 9)), axis=1)
                            every = np.concatenate((ids[at], np.broadcast_to(names, new.shape)), axis=1)
                            order = smallest(both, every, depth)
                            best[at], ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(every, order, 1)
                i, j = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[i, j]), pa.array(best[i, j])], names=["qid", "id", "score"])

            part = rows.filter(F.col("part").isin(sorted(opened))).mapInArrow(run, RESULT)
            found = part if found is None else found.unionAll(part)
        return top(found if found is not None else spark.createDataFrame([], RESULT), depth)

    def structure_bytes(self) -> int:
        return self.capacity * (self.subspaces + 8) + 4 * self.dimension * (self.partitions + self.centroids)
