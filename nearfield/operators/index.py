"""The interface of all indexes, what a search costs, and the flat index.

A search returns ``Found``: the result frame and a one-row frame of counted costs.  Counts
come from the candidate frames themselves, never from accumulators, so retries count once.
Short results have fewer rows; ``top_up`` fills them where asked.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, IndexStateError, require
from ..functions.vector import checked, metric_named
from .exact import identifier_overlap, score_gap, search

STATS = "distances double, candidates long, hops long, queries long"


def stats_row(spark, distances: float = 0.0, candidates: int = 0, hops: int = 0, queries: int = 0) -> DataFrame:
    require(min(distances, candidates, hops, queries) >= 0, "counts can't be negative")
    return spark.createDataFrame([(float(distances), int(candidates), int(hops), int(queries))], STATS)


def charge(stats: DataFrame, count: int, weight: float = 1.0) -> DataFrame:
    """Costs with ``count`` more candidates scored at ``weight`` of a distance each."""
    require(count >= 0 and weight >= 0, "a charge can't be negative")
    return stats.withColumn("distances", F.col("distances") + count * weight).withColumn("candidates", F.col("candidates") + F.lit(count).cast("long"))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Field-wise sums."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.agg(*[F.sum(c).alias(c) for c in ("distances", "candidates", "hops", "queries")])


def distances_per_query(stats: DataFrame) -> DataFrame:
    return stats.select(F.coalesce(F.try_divide("distances", "queries"), F.lit(0.0)).alias("distances_per_query"))


@dataclass
class Found:
    result: DataFrame
    stats: DataFrame


class Index(ABC):
    """Vectors (id, v) under an access method.  Ids are columns and never move.

    ``insert`` and every search refuse an index that is not built.
    """

    name = "index"

    def __init__(self, dimension: int, metric: str = "l2"):
        require(dimension >= 1, f"dimension must be at least 1, not {dimension}")
        self.dimension = dimension
        self.metric = metric_named(metric)
        self.rows: DataFrame | None = None
        self.dead: DataFrame | None = None
        self._count = 0

    @property
    def built(self) -> bool:
        return self.rows is not None

    def require_built(self) -> None:
        if not self.built:
            raise IndexStateError(f"{self.name} is not built")

    def check_vectors(self, vectors: DataFrame) -> int:
        n, width = checked(vectors)
        require(width == self.dimension, f"vectors are {width} wide, the index {self.dimension}", DataError)
        return n

    def check_queries(self, queries: DataFrame, k: int) -> int:
        self.require_built()
        n, width = checked(queries, "q")
        require(width == self.dimension, f"queries are {width} wide, the index {self.dimension}", DataError)
        require(1 <= k <= self.size, f"k is {k}; the index holds {self.size} live rows")
        return n

    @property
    def capacity(self) -> int:
        """Rows ever filed, tombstones too."""
        return self._count

    @property
    def size(self) -> int:
        """Live rows."""
        return self._count - (self.dead.count() if self.dead is not None else 0)

    def live(self) -> DataFrame:
        """Rows without tombstones."""
        self.require_built()
        return self.rows if self.dead is None else self.rows.join(self.dead, "id", "left_anti")

    def remove(self, ids: DataFrame) -> int:
        """Tombstones (id); idempotent, refuses unknown ids; returns how many are new."""
        self.require_built()
        ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
        if not ids.join(self.rows, "id", "left_anti").isEmpty():
            raise ConfigError("an id is not in the index")
        before = 0 if self.dead is None else self.dead.count()
        self.dead = ids if self.dead is None else self.dead.unionAll(ids).distinct()
        return self.dead.count() - before

    def vector(self, identifier: int) -> list[float]:
        """One live vector."""
        found = self.live().filter(F.col("id") == identifier).select("v").first()
        if found is None:
            raise ConfigError(f"no live row {identifier}")
        return list(found.v)

    @abstractmethod
    def build(self, vectors: DataFrame) -> Index: ...

    @abstractmethod
    def search(self, queries: DataFrame, k: int = 10) -> Found: ...

    def insert(self, vectors: DataFrame) -> int:
        """Appends rows with new ids."""
        self.require_built()
        n = self.check_vectors(vectors)
        if not vectors.join(self.rows, "id", "left_semi").isEmpty():
            raise ConfigError("an id is in the index already")
        self._append(vectors)
        self._count += n
        return n

    def _append(self, vectors: DataFrame) -> None:
        self.rows = self.rows.unionByName(vectors.select("id", "v"))

    def vector_bytes(self) -> int:
        return 4 * self.dimension * self.capacity

    def structure_bytes(self) -> int:
        return 0

    def memory_bytes(self) -> int:
        return self.vector_bytes() + self.structure_bytes()

    def as_dict(self) -> dict:
        return {"index": self.name, "dimension": self.dimension, "metric": self.metric.name, "size": self.size if self.built else 0, "built": self.built}


class FlatIndex(Index):
    """Every row, with tombstones; dead rows are still charged."""

    name = "flat"

    def build(self, vectors: DataFrame) -> FlatIndex:
        self._count = self.check_vectors(vectors)
        self.rows, self.dead = vectors.select(F.col("id").cast("long").alias("id"), "v"), None
        return self

    def search(self, queries: DataFrame, k: int = 10) -> Found:
        n = self.check_queries(queries, k)
        found = search(queries, self.live(), k, self.metric.name)
        return Found(found, stats_row(queries.sparkSession, self.capacity * n, self.capacity * n, 0, n))

    def compact(self) -> tuple[DataFrame, int]:
        """Drops tombstones and numbers rows 0, 1, ... in id order; (old id, new id), reclaimed.

        Numbers come from counts of id ranges: no row moves into one task.
        """
        from ..plans.storage import numbered

        reclaimed = self.capacity - self.size
        mapping = numbered(self.live().select("id"), "id").select(F.col("id").alias("old_id"), F.col("number").alias("id"))
        self.rows = self.live().join(mapping.withColumnRenamed("id", "new"), F.col("id") == F.col("old_id")).select(F.col("new").alias("id"), "v")
        self.dead, self._count = None, self._count - reclaimed
        return mapping, reclaimed


@dataclass
class Quality:
    """Recall and cost of one result; speedup and scanned are 0 where nothing was counted."""

    index: str
    recall: float
    gap: float
    distances_per_query: float
    corpus_size: int

    @property
    def speedup(self) -> float:
        return self.corpus_size / self.distances_per_query if self.distances_per_query else 0.0

    @property
    def scanned(self) -> float:
        return self.distances_per_query / self.corpus_size if self.corpus_size else 0.0

    def as_dict(self) -> dict:
        return self.__dict__ | {"speedup": self.speedup, "scanned": self.scanned}


def evaluate_result(name: str, corpus: DataFrame, queries: DataFrame, found: Found, k: int, metric: str = "l2", truth: DataFrame | None = None) -> Quality:
    """Scores a result against exact search."""
    truth = search(queries, corpus, k, metric) if truth is None else truth
    recall = identifier_overlap(truth, found.result, k).first()[0]
    gap = score_gap(queries, corpus, truth, found.result, metric).first()[0]
    per = distances_per_query(found.stats).first()[0]
    return Quality(name, float(recall or 0.0), float(gap or 0.0), float(per), corpus.count())


def evaluate(index: Index, corpus: DataFrame, queries: DataFrame, k: int = 10, truth: DataFrame | None = None) -> Quality:
    return evaluate_result(index.name, corpus, queries, index.search(queries, k), k, index.metric.name, truth)


def evaluate_on(index: Index, corpus: DataFrame, k: int = 10, queries: int = 64, seed: int = 11) -> Quality:
    """Holds out queries, builds on the rest, evaluates."""
    from ..sources.datasets import held_out

    rest, asked = held_out(corpus, queries, seed)
    return evaluate(index.build(rest), rest, asked, k)


def compare(qualities: list[Quality]) -> list[Quality]:
    return sorted(qualities, key=lambda q: -q.recall)
