"""Queries that moved away from the corpus, duplicated corpora, and transforms before search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, require
from ..functions.vector import add, hashed, normalise, normals, project, subtract, times, uniform
from ..operators.codes import covariance, literal, random_rotation

# -- drift -------------------------------------------------------------------------------------


def shift(queries: DataFrame, magnitude: float, seed: int = 0) -> DataFrame:
    """All queries moved along one random unit direction."""
    direction = normalise(normals(len(queries.first().q), seed, F.lit("shift")))
    return queries.withColumn("q", add("q", times(direction, magnitude)))


def scale(queries: DataFrame, magnitude: float) -> DataFrame:
    return queries.withColumn("q", times("q", magnitude))


def rotate(queries: DataFrame, magnitude: float, seed: int = 0) -> DataFrame:
    """Turned by magnitude * 90 degrees in one random plane."""
    n = len(queries.first().q)
    plane = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, 2)))[0]
    a = magnitude * np.pi / 2
    turn = np.eye(n) + plane @ (np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) - np.eye(2)) @ plane.T
    return queries.withColumn("q", project("q", turn.tolist()))


def drifted(queries: DataFrame, kind: str, magnitude: float, seed: int = 0) -> DataFrame:
    kinds = {"shift": lambda: shift(queries, magnitude, seed), "scale": lambda: scale(queries, magnitude), "rotate": lambda: rotate(queries, magnitude, seed)}
    if kind not in kinds:
        raise ConfigError(f"unknown drift {kind!r}")
    return kinds[kind]()


# -- duplicates --------------------------------------------------------------------------------


def exact_duplicates(corpus: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, v, original): a share of rows, by hash, replaced by other rows."""
    require(0 <= share < 1, f"share {share}")
    from ..plans.storage import numbered

    h = uniform(seed, "id") < share
    kept = numbered(corpus.filter(~h).select("id"), "id")
    n = kept.count()
    require(n > 0, "no row is left to copy")
    gone = corpus.filter(h).select("id", F.pmod(hashed(seed + 1, "id"), F.lit(n)).alias("number"))
    source = gone.join(kept.select("number", F.col("id").alias("original")), "number").join(corpus.select(F.col("id").alias("original"), "v"), "original")
    return corpus.filter(~h).select("id", "v", F.col("id").alias("original")).unionByName(source.select("id", "v", "original"))


def near_duplicates(corpus: DataFrame, share: float = 0.2, nudge: float = 0.01, seed: int = 0) -> DataFrame:
    """The same, copies moved by a unit step times nudge."""
    d = len(corpus.select("v").first().v)
    rows = exact_duplicates(corpus, share, seed)
    moved = rows.withColumn("e", normalise(normals(d, seed + 2)))
    return moved.select("id", F.when(F.col("id") == F.col("original"), F.col("v").cast("array<double>")).otherwise(add("v", times("e", nudge))).alias("v"), "original")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(original, n): rows of each original."""
    return rows.groupBy("original").agg(F.count("*").alias("n"))


def ties_in_the_truth(wide: DataFrame, k: int = 10) -> DataFrame:
    """One row: tied, the share of queries whose slots k and k + 1 tie; median_gap of the two."""
    two = wide.filter(F.col("rank").isin(k, k + 1)).groupBy("qid").agg((F.max("score") - F.min("score")).alias("gap"), F.count("*").alias("n")).filter("n = 2")
    return two.agg(F.avg((F.col("gap") < 1e-6).cast("int")).alias("tied"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))


def recall_by_distance(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: recall where a score, not an id, has to match (to 5 digits), each once."""
    def numbered_scores(x: DataFrame) -> DataFrame:
        s = F.round("score", 5)
        return x.select("qid", s.alias("s"), F.row_number().over(Window.partitionBy("qid", s).orderBy("rank")).alias("n"))

    hit = numbered_scores(truth).join(numbered_scores(found), ["qid", "s", "n"]).groupBy("qid").agg(F.count("*").alias("hit"))
    return truth.select("qid").distinct().join(hit, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0)) / k).alias("recall"))


def deduplicated(corpus: DataFrame) -> DataFrame:
    """(id, v): the smallest id of each vector."""
    return corpus.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def distinct_originals(found: DataFrame, originals: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(depth, originals): mean distinct originals in the first slots."""
    rows = found.join(originals.select("id", "original"), "id").withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).filter("rank <= depth")
    each = rows.groupBy("depth", "qid").agg(F.countDistinct("original").alias("n"))
    return each.groupBy("depth").agg(F.avg("n").alias("originals"))


# -- transforms --------------------------------------------------------------------------------


@dataclass
class Transform:
    """(v - centre) times matrix."""

    matrix: np.ndarray
    centre: np.ndarray
    name: str
    kept_variance: float = 1.0

    def __post_init__(self) -> None:
        if self.matrix.ndim != 2 or len(self.centre) != self.matrix.shape[0]:
            raise DataError(f"a centre of {len(self.centre)} for a matrix of {self.matrix.shape}")

    def apply(self, rows: DataFrame, column: str = "v") -> DataFrame:
        moved = subtract(column, literal(self.centre))
        same = self.matrix.shape[0] == self.matrix.shape[1] and np.array_equal(self.matrix, np.eye(len(self.matrix)))
        return rows.withColumn(column, moved if same else project(moved, self.matrix.T.tolist()))


def principal_directions(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, directions (rows, widest first) and sample variances along them."""
    mean, cov, n = covariance(vectors)
    values, directions = np.linalg.eigh(cov * n / max(1, n - 1))
    return mean, directions[:, ::-1].T, np.maximum(values[::-1], 0.0)


def fit_centring(vectors: DataFrame) -> Transform:
    mean, cov, _ = covariance(vectors)
    return Transform(np.eye(len(cov)), mean, "centring")


def fit_whitening(vectors: DataFrame, floor: float = 1e-6) -> Transform:
    mean, directions, variance = principal_directions(vectors)
    return Transform(directions.T / np.sqrt(np.maximum(variance, floor)), mean, "whitening")


def fit_reduction(vectors: DataFrame, target: int) -> Transform:
    mean, directions, variance = principal_directions(vectors)
    require(1 <= target <= len(directions), f"target {target} of {len(directions)}")
    return Transform(directions[:target].T, mean, "reduction", float(variance[:target].sum() / max(variance.sum(), 1e-12)))


def fit_random_projection(dimension: int, target: int, seed: int = 0, orthonormal: bool = True) -> Transform:
    require(1 <= target <= dimension, f"target {target} of {dimension}")
    if orthonormal:
        m = random_rotation(dimension, seed)[:, :target]
    else:
        m = np.random.default_rng(seed).standard_normal((dimension, target)) / np.sqrt(target)
    return Transform(m, np.zeros(dimension), "random projection")


def recall_after(corpus: DataFrame, queries: DataFrame, transform: Transform, k: int = 10) -> DataFrame:
    """One row: overlap of exact results before and after a transform."""
    from ..operators.exact import identifier_overlap, search

    return identifier_overlap(search(queries, corpus, k), search(transform.apply(queries, "q"), transform.apply(corpus), k), k)
