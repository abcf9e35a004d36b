"""Inserting and removing: how an index ages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import hashed, uniform
from ..operators.exact import search
from ..operators.index import Index, Quality, evaluate_result


@dataclass
class Churn:
    inserted: int = 0
    removed: int = 0
    built_size: int = 0

    @property
    def insert_share(self) -> float:
        return self.inserted / self.built_size if self.built_size else 0.0

    @property
    def remove_share(self) -> float:
        return self.removed / self.built_size if self.built_size else 0.0

    @property
    def churn(self) -> float:
        return self.insert_share + self.remove_share

    def as_dict(self) -> dict:
        return self.__dict__ | {"insert_share": self.insert_share, "remove_share": self.remove_share, "churn": self.churn}


@dataclass
class Degradation:
    churn: float
    quality: Quality
    size: int

    def as_dict(self) -> dict:
        return {"churn": self.churn, "recall": self.quality.recall, "distances": self.quality.distances_per_query, "size": self.size}


def split_for_churn(corpus: DataFrame, built_share: float = 0.5, queries: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(built, arriving, queries) by hash of the id."""
    from ..sources.datasets import held_out

    rest, asked = held_out(corpus, queries, seed + 11)
    h = uniform(seed, "id") < built_share
    return rest.filter(h), rest.filter(~h), asked


def measure(index: Index, queries: DataFrame, churn: Churn, k: int = 10) -> Degradation:
    """Recall against exact search of the live rows."""
    live = index.live()
    q = evaluate_result(index.name, live, queries, index.search(queries, k), k, truth=search(queries, live, k))
    return Degradation(churn.churn, q, index.size)


def _batches(rows: DataFrame, batches: int, seed: int) -> list[DataFrame]:
    require(batches >= 1, "batches must be at least 1")
    h = F.pmod(hashed(seed, "id"), F.lit(batches))
    return [rows.filter(h == i) for i in range(batches)]


def insert_in_batches(index: Index, built: DataFrame, arriving: DataFrame, queries: DataFrame, batches: int = 8, k: int = 10) -> list[Degradation]:
    index.build(built)
    churn, out = Churn(built_size=index.capacity), []
    for part in _batches(arriving, batches, 1):
        churn.inserted += index.insert(part)
        out.append(measure(index, queries, churn, k))
    return out


def remove_in_batches(index: Index, built: DataFrame, queries: DataFrame, batches: int = 8, share: float = 0.4, k: int = 10, seed: int = 0) -> list[Degradation]:
    require(0 < share < 1, f"share {share}")
    index.build(built)
    churn, out = Churn(built_size=index.capacity), []
    gone = built.filter(uniform(seed, "id") < share).select("id")
    for part in _batches(gone, batches, seed + 1):
        churn.removed += index.remove(part)
        out.append(measure(index, queries, churn, k))
    return out


def components_over_live(edges: DataFrame, vertices: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, component) among live vertices only."""
    from ..operators.graphs import components

    live = vertices.join(dead, "id", "left_anti")
    own = edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    return components(live, own)
