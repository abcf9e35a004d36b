"""Serving policies: budgets, replicas, staged search, routing between tiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import dot, hashed, squared_l2, top
from ..operators.codes import SignCodes, literal, rerank
from ..operators.exact import BLOCK_NUMBERS, RESULT, scan_keyed, search, top_up
from ..operators.ivf import ivf_search

# -- budgets -----------------------------------------------------------------------------------


@dataclass
class Budget:
    """A cap with partial charges."""

    limit: float
    spent: float = 0.0

    def __post_init__(self) -> None:
        require(self.limit >= 0 and self.spent >= 0, "a budget can't be negative")

    @property
    def remaining(self) -> float:
        return max(0.0, self.limit - self.spent)

    @property
    def exhausted(self) -> bool:
        return self.remaining == 0

    def charge(self, count: float) -> float:
        require(count >= 0, "a charge can't be negative")
        allowed = min(count, self.remaining)
        self.spent += allowed
        return allowed


def _opened(queries: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, q, part, nth, n): all lists in the order a query opens them, with their lengths."""
    w = Window.partitionBy("qid").orderBy("to_centre", "part")
    scored = queries.crossJoin(F.broadcast(centres)).select("qid", "q", "part", squared_l2("q", "c").alias("to_centre"))
    ordered = scored.withColumn("nth", F.row_number().over(w))
    return ordered.join(F.broadcast(sizes), "part", "left").fillna(0, ["n"])


def _scan(queries: DataFrame, allowed: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Top k over the first ``take`` rows, in id order, of each opened list; short results are filled.

    What each query takes of each list is broadcast with the block of queries, and the scan
    meets no more than that; no pair of a query and a row is shuffled.  Lists that bear
    ``place`` (see storage.placed) are not numbered again.
    """
    from .storage import placed

    lists = lists if "place" in lists.columns else placed(lists)
    takes = allowed.filter("take > 0").groupBy("qid").agg(F.flatten(F.collect_list(F.array(F.col("part").cast("long"), F.col("take").cast("long")))).alias("keys"))  # a pair a list
    asked = queries.select("qid", "q").join(takes, "qid").select("qid", "q", "keys")
    rows = lists.select(F.col("part").cast("int").alias("part"), F.col("id").cast("long").alias("id"), "v", F.col("place").cast("long").alias("place"))
    found = None
    for qids, q, pairs in _taking(asked):
        opened: dict[int, tuple[list[int], list[int]]] = {}
        for i, own in enumerate(pairs):
            for part, take in zip(own[::2], own[1::2], strict=True):
                at, n = opened.setdefault(part, ([], []))
                at.append(i)
                n.append(take)
        shared = queries.sparkSession.sparkContext.broadcast((qids, q, {p: (np.array(at), np.array(n)) for p, (at, n) in opened.items()}))
        part = scan_keyed(rows.filter(F.col("part").isin(sorted(opened))), shared, k, "l2", False, prefix=True).select("qid", "id", "score")
        found = part if found is None else found.unionAll(part)
    found = queries.sparkSession.createDataFrame([], RESULT) if found is None else found
    return top_up(top(found, k), queries, lists.select("id", "v"), k)


def _taking(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[int]]]]:
    """(qids, matrix, [list, rows, list, rows, ...] of each) in blocks of bounded size."""
    ids, rows, pairs, size = [], [], [], 0
    for qid, q, own in asked.toLocalIterator():
        ids.append(qid)
        rows.append(q)
        pairs.append(own)
        size += len(q) + len(own)
        if size >= BLOCK_NUMBERS:
            yield np.array(ids), np.array(rows, dtype=np.float64), pairs
            ids, rows, pairs, size = [], [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, dtype=np.float64), pairs


def allowance(opened: DataFrame, limit: Column, per: list[str], order: list[str]) -> DataFrame:
    """opened with ``take``: what a running budget lets of each list, partly the last."""
    w = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return opened.withColumn("take", F.least(F.col("n"), F.greatest(F.lit(0), limit - before)).cast("long"))


def bounded_search(queries: DataFrame, lists: DataFrame, centres: DataFrame, sizes: DataFrame, partitions: int, k: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Per-query budget, centre scan included; (result, (qid, spent, truncated))."""
    o = allowance(_opened(queries, centres, sizes), F.lit(max(0, limit - partitions)), ["qid"], ["nth"])
    spent = o.groupBy("qid").agg((F.sum("take") + partitions).alias("spent"), (F.sum("take") < F.sum("n")).alias("truncated"))
    return _scan(queries, o, lists, k), spent


def whole_lists_search(queries: DataFrame, lists: DataFrame, centres: DataFrame, sizes: DataFrame, partitions: int, k: int, limit: int) -> DataFrame:
    """The same without partial lists: stops at the first that is beyond the budget."""
    o = _opened(queries, centres, sizes)
    upto = F.sum("n").over(Window.partitionBy("qid").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    o = o.withColumn("take", F.when(upto <= max(0, limit - partitions), F.col("n")).otherwise(F.lit(0)))
    return _scan(queries, o, lists, k)


def shared_budget_search(queries: DataFrame, lists: DataFrame, centres: DataFrame, sizes: DataFrame, k: int, total: int, probe: int) -> tuple[DataFrame, DataFrame]:
    """One budget for a batch in query order, ``probe`` lists a query; centres are not charged.

    The running sum over queries goes over all tasks.
    """
    o = _opened(queries, centres, sizes).filter(F.col("nth") <= probe)
    each = o.groupBy("qid").agg(F.sum("n").alias("wanted"))
    from .storage import running_total

    left = running_total(each, "wanted", "qid").select("qid", F.greatest(F.lit(0), F.lit(total) - F.col("before")).alias("left"))
    o = allowance(o.join(left, "qid"), F.col("left"), ["qid"], ["nth"])
    spent = o.groupBy("qid").agg(F.sum("take").alias("spent"), (F.sum("take") < F.sum("n")).alias("truncated"))
    return _scan(queries, o, lists, k), spent


def served(spent: DataFrame) -> DataFrame:
    """One row: completed, truncated, truncated_share."""
    t = F.count_if("truncated")
    return spent.agg(F.count_if(~F.col("truncated")).alias("completed"), t.alias("truncated"), (t / F.count("*")).alias("truncated_share"))


# -- replicas ----------------------------------------------------------------------------------


def tagged(answers: dict[str, DataFrame]) -> DataFrame:
    """(replica, qid, rank, id, score)."""
    out = None
    for name, a in answers.items():
        row = a.select(F.lit(name).alias("replica"), "qid", "rank", "id", "score")
        out = row if out is None else out.unionAll(row)
    require(out is not None, "no replicas")
    return out


def build_fleet(corpus: DataFrame, dimension: int, count: int = 3, partitions: int = 64, probe: int = 8, same_seed: bool = False) -> dict:
    from ..operators.ivf import IVFIndex

    require(count >= 1, "count must be at least 1")
    return {f"replica{i}": IVFIndex(dimension, partitions, "l2", probe, 0 if same_seed else i).build(corpus) for i in range(count)}


def merge_replicas(answers: DataFrame, k: int) -> DataFrame:
    """The k best of the smallest score of each id."""
    return top(answers.groupBy("qid", "id").agg(F.min("score").alias("score")), k)


def agreement(answers: DataFrame) -> DataFrame:
    """One row: slots (same id in the same slot) and sets (same id at all) over pairs of replicas."""
    a, b = answers.alias("a"), answers.alias("b")
    n = answers.groupBy("replica").agg(F.count("*").alias("n"))
    pairs = n.alias("x").join(F.broadcast(n.alias("y")), F.col("x.replica") < F.col("y.replica")).agg(F.sum("x.n").alias("n"))
    same = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.id") == F.col("b.id")) & (F.col("a.replica") < F.col("b.replica")))
    hits = same.agg(F.count("*").alias("sets"), F.count_if(F.col("a.rank") == F.col("b.rank")).alias("slots"))
    return hits.crossJoin(pairs).select((F.col("slots") / F.col("n")).alias("slots"), (F.col("sets") / F.col("n")).alias("sets"))


# -- staged search -----------------------------------------------------------------------------


@dataclass
class Shortlist:
    """First-stage candidates (qid, rank, id, score) and what they cost a query."""

    rows: DataFrame
    cost_per_query: float

    def as_neighbours(self, k: int) -> DataFrame:
        return self.rows.filter(F.col("rank") <= k)


def projection(dimension: int, rank: int, seed: int = 0) -> np.ndarray:
    """``rank`` orthonormal directions."""
    require(1 <= rank <= dimension, f"rank {rank} of {dimension}")
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))[0][:, :rank].T


def exact_shortlist(queries: DataFrame, corpus: DataFrame, depth: int, size: int) -> Shortlist:
    require(1 <= depth <= size, f"depth {depth} of {size}")
    return Shortlist(search(queries, corpus, depth), size)


def sign_shortlist(queries: DataFrame, corpus: DataFrame, depth: int, size: int, dimension: int) -> Shortlist:
    """Hamming distance of uncentred signs, at 1/32 of a distance each."""
    require(1 <= depth <= size, f"depth {depth} of {size}")
    codes = SignCodes(dimension)
    return Shortlist(codes.search(queries, codes.encode(corpus), depth), size / 32)


def projected_shortlist(queries: DataFrame, corpus: DataFrame, depth: int, size: int, basis: np.ndarray) -> Shortlist:
    """Squared L2 of few projections, at their share of a distance."""
    require(1 <= depth <= size, f"depth {depth} of {size}")
    low = lambda c: F.array(*[dot(F.col(c), literal(r)) for r in basis])
    found = search(queries.select("qid", low("q").alias("q")), corpus.select("id", low("v").alias("v")), depth)
    return Shortlist(found, size * basis.shape[0] / basis.shape[1])


def partition_shortlist(queries: DataFrame, lists: DataFrame, centres: np.ndarray, depth: int, probe: int, cost_per_query: float) -> Shortlist:
    return Shortlist(ivf_search(queries, lists, centres, depth, probe), cost_per_query)


def shortlist_recall(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: shortlist_recall, the share of the truth that is anywhere in the shortlist."""
    there = rows.select("qid", "id").distinct().withColumn("hit", F.lit(1))
    return truth.join(there, ["qid", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("shortlist_recall"))


def staged_search(queries: DataFrame, corpus: DataFrame, truth: DataFrame, short: Shortlist, depth: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(answer, one row of shortlist_recall, final_recall, first_stage_cost, rerank_cost, total_cost)."""
    answer = rerank(queries, corpus, short.rows, k)
    final = shortlist_recall(truth, answer).withColumnRenamed("shortlist_recall", "final_recall")
    row = shortlist_recall(truth, short.rows).crossJoin(final).select(
        "*", F.lit(float(short.cost_per_query)).alias("first_stage_cost"), F.lit(float(depth)).alias("rerank_cost"), F.lit(float(short.cost_per_query + depth)).alias("total_cost")
    )
    return answer, row


def depth_sweep(truth: DataFrame, wide: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(depth, recall): the share of the truth within each depth of one wide shortlist.

    With exact second stage this is the final recall, since reranking keeps what it is given.
    """
    at = truth.join(wide.select("qid", "id", F.col("rank").alias("at")), ["qid", "id"], "left")
    cells = [F.avg(F.coalesce((F.col("at") <= d).cast("int"), F.lit(0))).alias(str(d)) for d in depths]
    return at.agg(*cells).unpivot([], [str(d) for d in depths], "depth", "recall").select(F.col("depth").cast("int").alias("depth"), "recall")


def smallest_depth(sweep: DataFrame, target: float) -> DataFrame:
    return sweep.filter(F.col("recall") >= target).agg(F.min("depth").alias("depth"))


# -- routing -----------------------------------------------------------------------------------


def centrality(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """(qid, signal): distance to the nearest centre."""
    d = queries.crossJoin(F.broadcast(centres)).select("qid", F.sqrt(squared_l2("q", "c")).alias("d"))
    return d.groupBy("qid").agg(F.min("d").alias("signal"))


def boundary_closeness(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """(qid, signal): distance to the second centre less that to the first; small is near a border."""
    d = queries.crossJoin(F.broadcast(centres)).select("qid", F.sqrt(squared_l2("q", "c")).alias("d"))
    two = d.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d"))).filter("r <= 2")
    return two.groupBy("qid").agg((F.max("d") - F.min("d")).alias("signal"))


def result_spread(found: DataFrame) -> DataFrame:
    """(qid, signal): the last score less the first."""
    return found.groupBy("qid").agg((F.max_by("score", "rank") - F.min_by("score", "rank")).alias("signal"))


def best_score(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.min_by("score", "rank").alias("signal"))


@dataclass
class Tier:
    """A named index and what a query costs there."""

    name: str
    index: object
    cost: float


@dataclass
class Routed:
    """A merged result, which tier answered each query, and the mean cost."""

    found: DataFrame
    escalation_rate: float
    distances_per_query: float


def always(tier: Tier, queries: DataFrame, k: int) -> Routed:
    return Routed(tier.index.search(queries, k).result.withColumn("tier", F.lit(tier.name)), 0.0, tier.cost)


def escalate(cheap: Tier, dear: Tier, queries: DataFrame, k: int, signal, share: float = 0.2) -> Routed:
    """All to the cheap tier; the ``share`` whose answers look worst again to the dear one.

    ``signal`` makes (qid, signal) of the cheap result; the largest go on.
    """
    from .lineage import materialise

    first = materialise(cheap.index.search(queries, k).result)
    chosen = materialise(escalated(signal(first), share))
    n, m = queries.count(), chosen.count()
    second = dear.index.search(queries.join(chosen, "qid", "left_semi"), k).result if m else first.limit(0)
    return Routed(route(first, second, chosen), m / n, cheap.cost + dear.cost * m / n)


def choose_up_front(cheap: Tier, dear: Tier, queries: DataFrame, k: int, signal: DataFrame, share: float = 0.2) -> Routed:
    """Each query to one tier only, by a signal of the query itself."""
    from .lineage import materialise

    chosen = materialise(escalated(signal, share))
    n, m = queries.count(), chosen.count()
    parts = [(cheap, queries.join(chosen, "qid", "left_anti"), n - m), (dear, queries.join(chosen, "qid", "left_semi"), m)]
    out = None
    for tier, own, count in parts:
        if count:
            row = tier.index.search(own, k).result.withColumn("tier", F.lit("cheap" if tier is cheap else "dear"))
            out = row if out is None else out.unionByName(row)
    require(out is not None, "no queries")
    return Routed(out, m / n, (cheap.cost * (n - m) + dear.cost * m) / n)


def margin(found: DataFrame) -> DataFrame:
    """(qid, signal): the second score over the first of a cheap answer; small means unsure."""
    two = found.filter("rank <= 2").groupBy("qid").agg(F.min("score").alias("a"), F.max("score").alias("b"))
    return two.select("qid", (F.col("b") / F.greatest("a", F.lit(1e-9))).alias("signal"))


def escalated(signal: DataFrame, share: float, largest_first: bool = True) -> DataFrame:
    """(qid) of the round(n * share) queries (half to even) with the most extreme signal."""
    require(0 <= share <= 1, f"share {share}")
    from .storage import numbered

    order = -F.col("signal") if largest_first else F.col("signal")
    ranked = numbered(signal.select("qid", order.alias("o")), "o", "qid")
    return ranked.filter(F.col("number") < round(ranked.count() * share)).select("qid")


def route(cheap: DataFrame, dear: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, rank, id, score, tier): the dear answer of chosen queries, the cheap one of others."""
    a = cheap.join(chosen, "qid", "left_anti").withColumn("tier", F.lit("cheap"))
    return a.unionByName(dear.join(chosen, "qid", "left_semi").withColumn("tier", F.lit("dear")))


def random_split(queries: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(qid): as many queries as ``escalated`` takes, by hash."""
    return escalated(queries.select("qid", hashed(seed, "qid").alias("signal")), share)


def interpolated(cheap: tuple[float, float], dear: tuple[float, float], cost: float) -> float:
    """Recall at a cost on the line between two (cost, recall) points."""
    (c1, r1), (c2, r2) = cheap, dear
    return r1 if c2 == c1 else r1 + (r2 - r1) * (cost - c1) / (c2 - c1)


def routing_cost(tiers: DataFrame, cost: dict[str, float]) -> DataFrame:
    """One row: escalation_rate and mean cost of routed queries."""
    each = tiers.groupBy("qid").agg(F.first("tier").alias("tier"))
    pay = F.when(F.col("tier") == "dear", F.lit(cost["cheap"] + cost["dear"])).otherwise(F.lit(cost["cheap"]))
    return each.agg(F.avg((F.col("tier") == "dear").cast("int")).alias("escalation_rate"), F.avg(pay).alias("distances_per_query"))
