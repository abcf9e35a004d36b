"""Indexes of in-memory structures, one a shard: tree, forest, graph, layered graph.

Building groups a table by shard, a hash of the id, and keeps each structure's arrays as one
binary row (shard, n, ids, payload).  Shards are dealt so that one holds about ``shard_rows``
rows, and no more than some 128 MB of vectors or than its kind builds in bounded time, so no task holds
much more; ``shards`` asks for more of them, never for fewer.  Inserted rows join
the rows of shards that are less than a quarter full in new shards, so many small inserts leave
few shards.  A search broadcasts a block of queries, walks each shard and merges their k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, require
from ..functions.vector import top
from ..plans.lineage import materialise
from .exact import query_blocks, top_up
from .index import Found, Index
from .structures import BeamGraph, Forest, Hnsw, KdTree, packed, unpacked

#: Rows of a shard, unless the caller says otherwise, and bytes of its vectors in single precision.
SHARD_ROWS, SHARD_BYTES = 100_000, 128 << 20
#: Queries whose answers a task sends together.
SENT = 4096


class ShardedIndex(Index):
    fills = True
    kind: type
    #: The most rows of a shard, where building it takes more than a few passes over them.
    most_rows = SHARD_ROWS

    def __init__(self, dimension: int, metric: str = "l2", shards: int | None = None, shard_rows: int = SHARD_ROWS):
        super().__init__(dimension, metric)
        if not self.metric.is_a_metric:
            raise ConfigError(f"{self.name} needs l2, not {self.metric.name}")
        require(shard_rows >= 1 and (shards is None or shards >= 1), "shards and rows must be at least 1")
        self.shards, self.shard_rows = shards, max(1, min(shard_rows, self.most_rows, SHARD_BYTES // (4 * dimension)))
        self.structures: DataFrame | None = None

    def _make(self):
        """A function from a matrix to a structure, sent to the tasks."""
        raise NotImplementedError

    def build(self, vectors: DataFrame) -> ShardedIndex:
        self._count = self.check_vectors(vectors)
        self.rows, self.dead = vectors.select(F.col("id").cast("long").alias("id"), "v"), None
        self.structures = materialise(self._built(self.rows, self._count))
        return self

    def _built(self, rows: DataFrame, n: int) -> DataFrame:
        shards, make = max(self.shards or 1, -(-n // self.shard_rows)), self._make()

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            made = make(np.stack(pdf["v"].to_numpy()).astype(np.float64))
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [len(pdf)], "ids": [pdf["id"].to_numpy()], "payload": [packed(made.arrays())]})

        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        dealt = dealt.repartitionByRange(shards, "shard")  # shards side by side, however small their bytes
        return dealt.groupBy("shard").applyInPandas(one, "shard int, n long, ids array<long>, payload binary")

    def _append(self, vectors: DataFrame) -> None:
        """New rows form shards with those of shards that are less than a quarter full; full ones stay."""
        super()._append(vectors)
        small = F.col("n") < self.shard_rows / 4
        few = self.structures.filter(small).select(F.explode("ids").alias("id"))
        fresh = materialise(self.rows.join(few, "id", "left_semi").unionByName(vectors.select(F.col("id").cast("long").alias("id"), "v")))
        self.structures = materialise(self.structures.filter(~small).unionByName(self._built(fresh, fresh.count())))

    def marked(self) -> DataFrame:
        """ids, payload, gone: each structure with the places of its removed rows.

        A structure is known by its first id.  Removed ids meet the structures by a join, so a
        walk gets those of its own shard only and none pass through the driver.
        """
        if self.dead is None:
            return self.structures.select("ids", "payload", F.lit(None).cast("array<int>").alias("gone"))
        own = self.structures.withColumn("first", F.element_at("ids", 1))
        places = own.select("first", F.posexplode("ids").alias("at", "id")).join(self.dead, "id")
        gone = places.groupBy("first").agg(F.collect_list("at").alias("gone"))  # a shard's rows at most
        return own.join(gone.hint("shuffle_hash"), "first", "left").select("ids", "payload", "gone")

    def walk(self, queries: DataFrame, k: int, **how) -> DataFrame:
        """(qid, id, score, cost): each shard's answers; the first row of a walk bears its cost."""
        spark, out, rows = queries.sparkSession, None, self.marked()
        for qids, q in query_blocks(queries):
            shared, kind = spark.sparkContext.broadcast((qids, q)), self.kind

            def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
                qids, q = shared.value
                for b in batches:
                    for ids, payload, gone in zip(*b.columns, strict=True):
                        ids, made, dead = ids.values.to_numpy(), kind.restored(unpacked(payload.as_py())), None
                        if gone.is_valid:
                            dead = np.zeros(len(ids), dtype=bool)
                            dead[gone.values.to_numpy()] = True
                        for at in range(0, len(q), SENT):
                            found = [(ids[rows], scores, cost) for rows, scores, cost in made.answers(q[at : at + SENT], k, dead=dead, **how)]
                            lengths = np.array([len(x) for x, _, _ in found])
                            costs = np.zeros(lengths.sum())
                            costs[(np.cumsum(lengths) - lengths)[lengths > 0]] = [cost for x, _, cost in found if len(x)]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(qids[at : at + SENT], lengths)), pa.array(np.concatenate([x for x, _, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(costs)],
                                names=["qid", "id", "score", "cost"],
                            )

            part = rows.mapInArrow(run, "qid long, id long, score double, cost double")
            out = part if out is None else out.unionAll(part)
        return out

    def search(self, queries: DataFrame, k: int = 10, **how) -> Found:
        n = self.check_queries(queries, k)
        walked = materialise(self.walk(queries, k, **how))
        found = top(walked.select("qid", "id", "score"), k)
        if self.fills:
            found = top_up(found, queries, self.live(), k)
        cost = walked.agg(F.sum("cost").alias("distances"), F.sum("cost").cast("long").alias("candidates")).select(
            F.coalesce("distances", F.lit(0.0)).alias("distances"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.lit(n).cast("long").alias("hops"), F.lit(n).cast("long").alias("queries")
        )
        return Found(found, cost)

    def structure_bytes(self) -> int:
        self.require_built()
        return self.structures.agg(F.sum(F.octet_length("payload"))).first()[0]


class TreeIndex(ShardedIndex):
    """Exact kd-tree."""

    name = "tree"
    kind = KdTree
    most_rows = 25_000

    def __init__(self, dimension: int, leaf_size: int = 16, metric: str = "l2", **shards):
        super().__init__(dimension, metric, **shards)
        require(leaf_size >= 1, "leaf_size must be at least 1")
        self.leaf_size = leaf_size

    def _make(self):
        leaf = self.leaf_size
        return lambda v: KdTree(v, leaf)


class ForestIndex(ShardedIndex):
    name = "forest"
    kind = Forest
    fills = False

    def __init__(self, dimension: int, trees: int = 8, leaf_size: int = 64, split_on: str = "median", seed: int = 0, **shards):
        super().__init__(dimension, "l2", **shards)
        require(trees >= 1 and leaf_size >= 1, "trees and leaf_size must be at least 1")
        require(split_on in ("median", "midpoint"), f"split_on {split_on!r}")
        self.how = (trees, leaf_size, split_on, seed)

    def _make(self):
        how = self.how
        return lambda v: Forest(v, *how)


class GraphIndex(ShardedIndex):
    name = "graph"
    kind = BeamGraph
    most_rows = 16_384  # its neighbour graph costs their square

    def __init__(self, dimension: int, degree: int = 16, build_degree: int = 32, ef: int = 32, alpha: float = 1.0, entry: str = "medoid", **shards):
        super().__init__(dimension, "l2", **shards)
        require(1 <= degree <= build_degree and ef >= 1 and alpha >= 1, "degree, build_degree, ef and alpha")
        require(entry in ("medoid", "first", "random"), f"entry {entry!r}")
        self.how = (degree, build_degree, ef, alpha, entry)

    def _make(self):
        how = self.how
        return lambda v: BeamGraph(v, *how)


    def visited(self, queries: DataFrame, ef: int | None = None) -> DataFrame:
        """(qid, id) of every vertex that a walk touches; pages of a layout are counted from it."""
        self.require_built()
        out = None
        for qids, q in query_blocks(queries):
            shared = queries.sparkSession.sparkContext.broadcast((qids, q))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for ids, payload in zip(b.column(0), b.column(1), strict=True):
                        ids, made = ids.values.to_numpy(), BeamGraph.restored(unpacked(payload.as_py()))
                        for qid, x in zip(*shared.value, strict=True):
                            rows = made.visited(x, ef)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), qid)), pa.array(ids[rows])], names=["qid", "id"])

            part = self.structures.select("ids", "payload").mapInArrow(run, "qid long, id long")
            out = part if out is None else out.unionAll(part)
        return out


class HNSWIndex(ShardedIndex):
    name = "hnsw"
    kind = Hnsw
    most_rows = 16_384  # linked one after another
    fills = False

    def __init__(self, dimension: int, degree: int = 16, ef: int = 32, ef_construction: int = 64, multiplier: float = 16.0, seed: int = 0, **shards):
        super().__init__(dimension, "l2", **shards)
        require(degree >= 1 and ef >= 1 and ef_construction >= 1 and multiplier > 1, "degree, ef, ef_construction and multiplier")
        self.how = (degree, ef, ef_construction, multiplier, seed)

    def _make(self):
        how = self.how
        return lambda v: Hnsw(v, *how)
