"""Answering a query stream in batches, and caches over it.

Streams are Structured Streaming frames (qid, q) or tables in arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import add, hashed, normalise, normals, times


@dataclass
class BatchStats:
    """Queries, batches, and corpus bytes read: each batch reads the corpus once."""

    queries: int = 0
    batches: int = 0
    corpus_reads: int = 0

    def record(self, queries: int, corpus_bytes: int) -> None:
        self.queries, self.batches, self.corpus_reads = self.queries + queries, self.batches + 1, self.corpus_reads + corpus_bytes

    @property
    def corpus_bytes_per_query(self) -> float:
        return self.corpus_reads / self.queries if self.queries else 0.0

    @property
    def mean_batch(self) -> float:
        return self.queries / self.batches if self.batches else 0.0


def answer_stream(stream: DataFrame, index, k: int, out: str, checkpoint: str, stats: BatchStats | None = None) -> None:
    """Answers every micro-batch of a (qid, q) stream and writes results by batch.

    A batch that runs again replaces what it wrote, so results are exactly once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        n = batch.count()
        if n:
            index.search(batch, k).result.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if stats is not None:
                stats.record(n, index.vector_bytes())
        batch.unpersist()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batched_search(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], batch: int = 32) -> tuple[DataFrame, BatchStats]:
    """(qid, rank, id, score, batch): the answers, and the batch of each query in arrival (qid) order.

    A batch bounds what one reading of the corpus serves.  Batches that a broadcast can hold
    together are answered together, so jobs grow with the queries' bytes, not with the batches.
    """
    from ..operators.exact import in_blocks
    from ..plans.storage import numbered

    require(batch >= 1, "batch must be at least 1")
    rows = numbered(queries.select("qid", "q"), "qid").withColumn("batch", F.floor(F.col("number") / batch))
    n = rows.count()
    require(n > 0, "no queries")
    out = in_blocks(rows.select("qid", "q"), answer).join(rows.select("qid", "batch"), "qid")
    return out, BatchStats(n, -(-n // batch), 0)


def replayed_stream(queries: DataFrame, count: int = 256, distinct: int = 32, seed: int = 0) -> DataFrame:
    """(qid, q): ``count`` arrivals, each one of the first ``distinct`` queries, drawn by hash."""
    from ..plans.storage import numbered

    require(count >= 1 and distinct >= 1, "count and distinct")
    few = numbered(queries.select("qid", "q"), "qid").filter(F.col("number") < distinct).select("number", "q")
    n = few.count()
    arrivals = queries.sparkSession.range(count).select(F.col("id").alias("qid"), F.pmod(hashed(seed, "id"), F.lit(n)).alias("number"))
    return arrivals.join(F.broadcast(few), "number").select("qid", "q")


def perturbed_stream(queries: DataFrame, count: int = 256, distinct: int = 32, nudge: float = 0.05, seed: int = 0) -> DataFrame:
    """The same arrivals, each moved by ``nudge`` in a direction of its own."""
    stream = replayed_stream(queries, count, distinct, seed)
    step = normalise(normals(len(stream.first().q), seed + 1, "qid"))
    return stream.select("qid", add("q", times(step, nudge)).alias("q"))


def waiting_cost(arrival_rate: float, batch: int) -> dict[str, float]:
    """Worst and mean seconds a query waits for its batch to fill."""
    require(arrival_rate > 0 and batch >= 1, "rate and batch")
    return {"worst": (batch - 1) / arrival_rate, "mean": (batch - 1) / (2 * arrival_rate)}


def largest_batch(spark: SparkSession, rates: tuple[float, ...], service_ms: float = 0.05, read_ms: float = 2.0, budget_ms: float = 20.0) -> DataFrame:
    """(rate, batch): the largest batch up to 4096 whose wait and service stay in the budget."""
    b = F.col("b").cast("double")
    grid = spark.createDataFrame([(float(r),) for r in rates], "rate double").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(4096))))
    ok = (b - 1) / F.col("rate") * 1000 + read_ms + service_ms * b <= budget_ms
    return grid.groupBy("rate").agg(F.coalesce(F.max(F.when(ok, F.col("b"))), F.lit(1)).alias("batch"))


def exact_cache_hits(stream: DataFrame) -> DataFrame:
    """One row: queries, hits, misses, hit_rate of an exact cache that never evicts.

    A key's first arrival misses, all others hit: one partial aggregation, no order needed.
    """
    each = stream.groupBy("q").agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"), F.count("*").alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide("hits", "queries"), F.lit(0.0)))


class ExactCache:
    """Bounded first-in first-out cache on vectors' bytes."""

    def __init__(self, capacity: int = 4096):
        require(capacity >= 1, "capacity must be at least 1")
        self.capacity, self.entries = capacity, {}

    @staticmethod
    def key(q) -> bytes:
        return np.asarray(q, dtype=np.float32).tobytes()

    def get(self, q):
        return self.entries.get(self.key(q))

    def put(self, q, found) -> None:
        if len(self.entries) >= self.capacity and self.key(q) not in self.entries:
            del self.entries[next(iter(self.entries))]
        self.entries[self.key(q)] = found


class NearCache:
    """Bounded first-in first-out cache that answers within a radius; a lookup costs its size."""

    def __init__(self, radius: float, capacity: int = 4096):
        require(radius >= 0 and capacity >= 1, "radius and capacity")
        self.radius, self.capacity = radius, capacity
        self.keys, self.found, self.first, self.last = np.empty((0, 0)), [], 0, 0

    @property
    def size(self) -> int:
        return self.last - self.first

    def get(self, q):
        if not self.size:
            return None, 0
        d = ((self.keys[self.first : self.last] - np.asarray(q, dtype=np.float64)) ** 2).sum(1)
        i = int(d.argmin())
        return (self.found[self.first + i] if d[i] <= self.radius**2 else None), len(d)

    def put(self, q, found) -> None:
        q = np.asarray(q, dtype=np.float64)
        if self.last == len(self.keys):  # the room is full: keep the live keys, in order, in room for as many more
            live, names = self.keys[self.first : self.last], self.found[self.first : self.last]
            self.keys = np.empty((max(16, 2 * len(live)), len(q)))
            if names:
                self.keys[: len(names)] = live
            self.found, self.first, self.last = names, 0, len(names)
        self.keys[self.last] = q
        self.found.append(found)
        self.last += 1
        if self.size > self.capacity:
            self.first += 1


CACHED = "lane int, qid long, served_by long, hit boolean, lookup_distances long"


def run_cache(stream: DataFrame, radius: float | None, capacity: int = 4096, lanes: int = 1) -> DataFrame:
    """(lane, qid, served_by, hit, lookup_distances): which earlier query answers each.

    Order matters to a bounded cache, so each lane has a cache of its own and takes its
    arrivals in order: equal queries share a lane of an exact cache, a near cache deals arrivals
    in turn.  Lanes are sorted and streamed through a batch at a time, never held whole.
    """
    require(lanes >= 1, "lanes must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, own = None, None
        for pdf in batches:
            rows = []
            for lane, qid, q in pdf[["lane", "qid", "q"]].itertuples(index=False):
                if lane != own:
                    own, cache = lane, ExactCache(capacity) if radius is None else NearCache(radius, capacity)
                found, cost = (cache.get(q), 0) if radius is None else cache.get(q)
                if found is None:
                    cache.put(q, qid)
                rows.append((lane, qid, qid if found is None else found, found is not None, cost))
            yield pd.DataFrame(rows, columns=["lane", "qid", "served_by", "hit", "lookup_distances"])

    deal = F.xxhash64(F.col("q").cast("array<float>")) if radius is None else F.col("qid")
    rows = stream.select("qid", "q", F.pmod(deal, F.lit(lanes)).cast("int").alias("lane"))
    return rows.repartition(lanes, "lane").sortWithinPartitions("lane", "qid").mapInPandas(run, CACHED)


def cache_over_stream(stream: DataFrame, capacity: int = 4096) -> DataFrame:
    """An exact cache as a stateful stream: (qid, first_qid, hit) with a state row a vector.

    State holds the first qid of each vector's bytes, for as long as the stream lives.
    """
    from pyspark.sql.streaming.state import GroupState

    def one(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("qid")
        first = state.get[0] if state.exists else None
        known = first is not None
        if not known:
            first = int(rows["qid"].iloc[0])
            state.update((first,))
        hit = [True] * len(rows) if known else [False] + [True] * (len(rows) - 1)
        yield pd.DataFrame({"qid": rows["qid"], "first_qid": first, "hit": hit})

    keyed = stream.select("qid", F.sha2(F.to_json("q"), 256).alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(one, "qid long, first_qid long, hit boolean", "first long", "append", "NoTimeout")


def cache_stats(runs: DataFrame, saved_per_hit: float) -> DataFrame:
    """One row: queries, hits, hit_rate, lookup_distances, saved_distances, net_saving."""
    out = runs.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.sum("lookup_distances").alias("lookup_distances"))
    return out.select("*", (F.col("hits") / F.col("queries")).alias("hit_rate"), (F.col("hits") * saved_per_hit).alias("saved_distances")).withColumn(
        "net_saving", F.col("saved_distances") - F.col("lookup_distances")
    )
