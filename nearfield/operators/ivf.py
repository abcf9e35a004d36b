"""Inverted lists, single or spilled to several lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import top
from ..plans.lineage import materialise
from .exact import RESULT, query_blocks, scan_keyed, score_matrix, top_up
from .index import Found, Index
from .kmeans import Clustering, assign, guard_partitions, lloyd


def probes(queries: DataFrame, centres: np.ndarray, probe: int, metric: str = "l2") -> DataFrame:
    """(qid, q, part, nth): the lists each query opens, nearest centre first."""
    asked = assign(queries.select(F.col("qid").alias("id"), F.col("q").alias("v")), centres, probe, metric)
    return asked.select(F.col("id").alias("qid"), F.col("v").alias("q"), "part", "nth", F.col("score").alias("to_centre"))


def ivf_search(queries: DataFrame, lists: DataFrame, centres: np.ndarray, k: int, probe: int, metric: str = "l2", copies: int = 1) -> DataFrame:
    """Top k of the rows (part, id, v) in each query's ``probe`` nearest lists.

    Queries are broadcast in blocks with the lists that each opens; a task scores its rows of
    opened lists and keeps its own best, so scored pairs are never shuffled.  Lists that no
    query of a block opens are pruned from the scan.  A row may stand in up to ``copies`` lists.
    """
    require(1 <= probe <= len(centres), f"probe {probe} of {len(centres)}")
    spark, found = lists.sparkSession, None
    rows = lists.filter(F.col("v").isNotNull()).select(F.col("part").cast("int").alias("part"), F.col("id").cast("long").alias("id"), "v")
    for qids, q in query_blocks(queries):
        scores = score_matrix(q, centres, metric)
        near = np.argsort(scores if metric == "l2" else -scores, axis=1, kind="stable")[:, :probe]
        opened = {int(p): np.flatnonzero((near == p).any(1)) for p in np.unique(near)}
        shared = spark.sparkContext.broadcast((qids, q, opened))
        part = scan_keyed(rows.filter(F.col("part").isin(sorted(opened))), shared, k * copies, metric, False).select("qid", "id", "score")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    if copies > 1:
        found = found.groupBy("qid", "id").agg(F.first("score").alias("score"))
    return top(found, k, metric)


def opened_rows(opened: DataFrame, lists: DataFrame, copies: int = 1) -> DataFrame:
    """One row: n, the rows in the lists that each query opens, a row in several of them once; no vector is read."""
    if copies > 1:  # rows by the set of lists they stand in meet queries by the set that they open
        rows = lists.groupBy("id").agg(F.sort_array(F.collect_set("part")).alias("held")).groupBy("held").agg(F.count("*").alias("size"))
        asks = opened.groupBy("qid").agg(F.sort_array(F.collect_set("part")).alias("opens")).groupBy("opens").agg(F.count("*").alias("asked"))
        met = asks.withColumn("part", F.explode("opens")).join(rows.withColumn("part", F.explode("held")), "part")
        both = met.select("opens", "held", "asked", "size").distinct()
        return both.agg(F.coalesce(F.sum(F.col("asked") * F.col("size")), F.lit(0)).alias("n"))
    asked = opened.groupBy("part").agg(F.count("*").alias("asked"))
    sizes = lists.groupBy("part").agg(F.count("*").alias("size"))
    return asked.join(sizes, "part").agg(F.coalesce(F.sum(F.col("asked") * F.col("size")), F.lit(0)).alias("n"))


def cheapest_partition_count(count: int, probe: int = 1) -> dict:
    """Cost P + probe * n / P over powers of two, its best P, and the closed form."""
    grid = [2**i for i in range(1, max(2, count.bit_length()))]
    costs = {p: p + probe * count / p for p in grid}
    return {"costs": costs, "best": min(costs, key=costs.get), "predicted": float(np.sqrt(count * probe))}


def list_sizes(lists: DataFrame, partitions: int) -> DataFrame:
    """(part, n) with empty lists too."""
    every = lists.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    return every.join(lists.groupBy("part").agg(F.count("*").alias("n")), "part", "left").fillna(0, ["n"])


def partition_spread(sizes: DataFrame) -> DataFrame:
    """One row: spread, the population deviation of list lengths over their mean."""
    return sizes.agg((F.stddev_pop("n") / F.avg("n")).alias("spread"))


class IVFIndex(Index):
    """k-means centres and the rows filed under the nearest.  Inserts keep the centres."""

    name = "ivf"
    filed_times = 1

    def __init__(self, dimension: int, partitions: int = 64, metric: str = "l2", probe: int = 1, seed: int = 0):
        super().__init__(dimension, metric)
        require(partitions >= 1, "partitions must be at least 1")
        require(1 <= probe <= partitions, f"probe {probe} of {partitions}")
        self.partitions, self.probe, self.seed = partitions, probe, seed
        self.centres: np.ndarray | None = None
        self.lists: DataFrame | None = None
        self.inserted = 0

    def build(self, vectors: DataFrame, centres: np.ndarray | None = None) -> IVFIndex:
        self._count = self.check_vectors(vectors)
        guard_partitions(self.partitions, self._count)
        self.clustering: Clustering | None = None
        if centres is None:
            self.clustering = lloyd(vectors, self.partitions, seed=self.seed)
            centres = self.clustering.centres
        self.centres, self.rows, self.dead, self.inserted = centres, vectors.select(F.col("id").cast("long").alias("id"), "v"), None, 0
        self.lists = materialise(self._filed(self.rows))
        return self

    def _filed(self, vectors: DataFrame) -> DataFrame:
        return assign(vectors, self.centres).select("part", "id", "v")

    def _append(self, vectors: DataFrame) -> None:
        super()._append(vectors)
        filed = materialise(self._filed(vectors))
        self.lists = self.lists.unionByName(filed)
        self.inserted += vectors.count()

    def live_lists(self) -> DataFrame:
        return self.lists if self.dead is None else self.lists.join(self.dead, "id", "left_anti")

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> Found:
        n = self.check_queries(queries, k)
        probe = self.probe if probe is None else probe
        require(1 <= probe <= self.partitions, f"probe {probe} of {self.partitions}")
        live = self.live_lists()
        cost = opened_rows(probes(queries, self.centres, probe, self.metric.name), live, self.filed_times).select(
            (F.col("n") + float(self.partitions * n)).alias("distances"), F.col("n").alias("candidates"), F.lit(n * probe).cast("long").alias("hops"), F.lit(n).cast("long").alias("queries")
        )
        return Found(ivf_search(queries, live, self.centres, k, probe, self.metric.name, self.filed_times), cost)

    def sizes(self) -> DataFrame:
        self.require_built()
        return list_sizes(self.lists, self.partitions)

    def rebuild(self) -> IVFIndex:
        """Clusters the live rows anew; ids stay."""
        return self.build(self.live())

    def structure_bytes(self) -> int:
        return 4 * self.dimension * self.partitions + 8 * self.capacity


def spill_uniformly(vectors: DataFrame, centres: np.ndarray, copies: int = 2) -> DataFrame:
    """(part, id, v): every row under its ``copies`` nearest centres."""
    return assign(vectors, centres, copies).select("part", "id", "v")


def spill_ratio(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, part, second, ratio): distance to the nearest centre over the second's."""
    two = assign(vectors, centres, 2)
    first = two.filter("nth = 1").select("id", "v", "part", F.sqrt("score").alias("d1"))
    second = two.filter("nth = 2").select("id", F.col("part").alias("second"), F.sqrt("score").alias("d2"))
    return first.join(second, "id").select("id", "v", "part", "second", (F.col("d1") / F.greatest("d2", F.lit(1e-12))).alias("ratio"))


def spill_adaptively(vectors: DataFrame, centres: np.ndarray, share: float = 0.3, rows: int | None = None) -> DataFrame:
    """(part, id, v): the ``share`` of rows with the highest ratio (ties by id) filed twice."""
    from ..plans.storage import numbered

    require(0 <= share <= 1, f"share {share}")
    both = materialise(spill_ratio(vectors, centres))
    n = both.count() if rows is None else rows
    m = round(n * share)
    once = both.select("part", "id", "v")
    if not m:
        return once
    # (ratio, id) in falling order are numbered over all tasks, so no task sorts more than its range
    ranked = numbered(both.select("id", (-F.col("ratio")).alias("r")), "r", "id").filter(F.col("number") < m)
    return once.unionAll(both.join(ranked.select("id"), "id", "left_semi").select(F.col("second").alias("part"), "id", "v"))


def spill_growth(lists: DataFrame) -> DataFrame:
    """One row: rows, entries, and entries a row of spilled lists."""
    return lists.agg(F.countDistinct("id").alias("rows"), F.count("*").alias("entries")).withColumn("growth", F.col("entries") / F.col("rows"))


class SpillIndex(IVFIndex):
    """Lists with rows in several of them, the union of opened lists scored once."""

    name = "spill"

    def __init__(self, dimension: int, partitions: int = 64, probe: int = 8, copies: int = 2, adaptive: float | None = None, seed: int = 0):
        super().__init__(dimension, partitions, "l2", probe, seed)
        require(1 <= copies <= partitions, f"copies {copies} of {partitions}")
        self.copies, self.adaptive = copies, adaptive
        self.filed_times = copies if adaptive is None else 2

    def _filed(self, vectors: DataFrame) -> DataFrame:
        if self.adaptive is None:
            return spill_uniformly(vectors, self.centres, self.copies)
        return spill_adaptively(vectors, self.centres, self.adaptive)

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> Found:
        found = super().search(queries, k, probe)
        return Found(top_up(found.result, queries, self.live(), k), found.stats)
