"""Measures of results, their uncertainty, calibration, tuning and reports.

``truth`` and ``found`` are results (qid, rank, id, score); per-query tables have qid and recall.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, require
from ..functions.vector import hashed

# -- recall ------------------------------------------------------------------------------------


def _hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """found with ``hit``: 1 where the truth has the id too."""
    there = truth.select("qid", "id").withColumn("hit", F.lit(1))
    return found.join(there, ["qid", "id"], "left").fillna(0, ["hit"])


def per_query(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, recall, gain, reciprocal_rank) of every query of the truth, 0 where nothing is found."""
    ideal = sum(1 / math.log2(r + 1) for r in range(1, k + 1))
    own = _hits(truth, found).groupBy("qid").agg(
        (F.sum("hit") / k).alias("recall"),
        (F.sum(F.col("hit") / F.log2(F.col("rank") + 1)) / ideal).alias("gain"),
        F.max(F.col("hit") / F.col("rank")).alias("reciprocal_rank"),
    )
    return truth.select("qid").distinct().join(own, "qid", "left").fillna(0.0)


def per_query_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    return per_query(truth, found, k).select("qid", "recall")


def distance_ratio(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: mean over slots of the found distance over the true one (roots of squared L2)."""
    a = truth.select("qid", "rank", F.sqrt("score").alias("t"))
    b = found.select("qid", "rank", F.sqrt("score").alias("f"))
    return a.join(b, ["qid", "rank"]).agg(F.avg(F.col("f") / F.greatest("t", F.lit(1e-9))).alias("distance_ratio"))


def score_all(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: recall, gain, reciprocal_rank, distance_ratio."""
    means = per_query(truth, found, k).agg(*[F.avg(c).alias(c) for c in ("recall", "gain", "reciprocal_rank")])
    return means.crossJoin(distance_ratio(truth, found))


def near_misses(wide: DataFrame, k: int = 10, offset: int = 10) -> DataFrame:
    """Slots offset+1 to offset+k of a wide result, ranked from 1."""
    return wide.filter(F.col("rank").between(offset + 1, offset + k)).withColumn("rank", F.col("rank") - offset)


def shuffled(found: DataFrame, seed: int = 0) -> DataFrame:
    """The same answers in an order drawn by hash."""
    w = Window.partitionBy("qid").orderBy(hashed(seed, "qid", "id"), "id")
    return found.withColumn("rank", F.row_number().over(w))


# -- uncertainty -------------------------------------------------------------------------------


def estimate(values: DataFrame, column: str = "recall") -> DataFrame:
    """One row: mean, error (sample deviation over root n), samples and the 95 % interval."""
    c = F.col(column)
    return values.agg(
        F.avg(c).alias("mean"), (F.coalesce(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count(c))).alias("error"), F.count(c).alias("samples")
    ).select("*", (F.col("mean") - 1.96 * F.col("error")).alias("low"), (F.col("mean") + 1.96 * F.col("error")).alias("high"))


def overlaps(left: tuple[float, float], right: tuple[float, float]) -> bool:
    return left[0] <= right[1] and right[0] <= left[1]


def paired_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: mean and error of right minus left by query, and the unpaired error."""
    d = left.select("qid", F.col("recall").alias("a")).join(right.select("qid", F.col("recall").alias("b")), "qid")
    n = F.sqrt(F.count("*"))
    return d.agg(
        F.avg(F.col("b") - F.col("a")).alias("mean"),
        (F.stddev_samp(F.col("b") - F.col("a")) / n).alias("error"),
        (F.sqrt(F.var_samp("a") + F.var_samp("b")) / n).alias("unpaired_error"),
        F.count("*").alias("samples"),
    )


def recall_quantiles(values: DataFrame, quantiles=(0.01, 0.05, 0.1, 0.5)) -> DataFrame:
    """One row: q0, q1, ... with linear interpolation."""
    return values.agg(*[F.percentile("recall", F.lit(q)).alias(f"q{i}") for i, q in enumerate(quantiles)])


def queries_to_detect(values: DataFrame, gaps=(0.01, 0.02, 0.05, 0.1)) -> DataFrame:
    """(gap, queries): how many queries tell a gap from noise at this spread."""
    s = values.agg(F.stddev_samp("recall").alias("s"))
    return s.select(F.col("s"), F.explode(F.array(*map(F.lit, gaps))).alias("gap")).select("gap", F.ceil(F.pow(3.92 * F.col("s") / F.col("gap"), 2)).cast("long").alias("queries"))


def spread(runs: DataFrame) -> DataFrame:
    """(index, seeds, mean, deviation, range, cost_range) of (index, seed, recall, distances)."""
    return runs.groupBy("index").agg(
        F.count("*").alias("seeds"), F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("deviation"),
        (F.max("recall") - F.min("recall")).alias("range"), (F.max("distances") - F.min("distances")).alias("cost_range"),
    )


def across_seeds(make: Callable[[int], object], corpus: DataFrame, queries: DataFrame, k: int = 10, seeds: Iterable[int] = range(8)) -> DataFrame:
    """(index, seed, recall, distances): the same corpus under rebuilt indexes."""
    from ..operators.exact import search
    from ..operators.index import evaluate
    from .lineage import materialise

    truth = materialise(search(queries, corpus, k))
    rows = []
    for s in seeds:
        q = evaluate(make(s).build(corpus), corpus, queries, k, truth)
        rows.append((q.index, s, q.recall, q.distances_per_query))
    return corpus.sparkSession.createDataFrame(rows, "index string, seed int, recall double, distances double")


# -- calibration -------------------------------------------------------------------------------


def signals(found: DataFrame) -> DataFrame:
    """(qid, nearest, furthest, gap, ratio, spread) of returned scores."""
    return found.groupBy("qid").agg(
        F.min("score").alias("nearest"), F.max("score").alias("furthest"), (F.max("score") - F.min("score")).alias("gap"),
        (F.max("score") / F.greatest(F.min("score"), F.lit(1e-9))).alias("ratio"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("spread"),
    )


def _pearson(a: str, b: str) -> Column:
    c = F.corr(a, b)
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def average_ranks(values: DataFrame, column: str, name: str) -> DataFrame:
    """values with the 0-based rank of a column, ties at their mean; sums run over all tasks."""
    from .storage import running_total

    each = running_total(values.groupBy(column).agg(F.count("*").alias("n")), "n", column)
    ranks = each.select(F.col(column).alias("of"), (F.col("before") + (F.col("n") - 1) / 2).alias(name))
    return values.join(ranks, F.col(column) == F.col("of")).drop("of")


def correlations(values: DataFrame, signal: str) -> DataFrame:
    """One row: correlation and rank_correlation of a signal with recall, 0 where one is constant."""
    ranked = average_ranks(average_ranks(values.select(signal, "recall"), signal, "a"), "recall", "b")
    return ranked.agg(_pearson(signal, "recall").alias("correlation"), _pearson("a", "b").alias("rank_correlation"))


def flag_the_worst(values: DataFrame, signal: str, share: float = 0.2, bad_below: float = 0.5, largest_is_worse: bool = True) -> DataFrame:
    """One row: flagged, caught, missed, false_alarms, precision, sensitivity."""
    require(0 < share <= 1, f"share {share}")
    from .storage import numbered

    order = -F.col(signal) if largest_is_worse else F.col(signal)
    rows = numbered(values.select("qid", order.alias("o"), (F.col("recall") < bad_below).alias("bad")), "o", "qid")
    f = F.col("number") < max(1, round(rows.count() * share))
    out = rows.agg(F.count_if(f).alias("flagged"), F.count_if(f & F.col("bad")).alias("caught"), F.count_if(~f & F.col("bad")).alias("missed"), F.count_if(f & ~F.col("bad")).alias("false_alarms"))
    return out.select(
        "*", F.coalesce(F.try_divide("caught", "flagged"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("caught"), F.col("caught") + F.col("missed")), F.lit(0.0)).alias("sensitivity"),
    )


# -- tuning ------------------------------------------------------------------------------------


def sweep_setting(answer: Callable[[int], object], truth: DataFrame, values: Iterable[int], k: int = 10) -> DataFrame:
    """(value, recall, distances) of ``answer(value)``, which returns a Found."""
    from ..operators.index import distances_per_query

    out = None
    for v in values:
        found = answer(v)
        row = per_query_recall(truth, found.result, k).agg(F.avg("recall").alias("recall")).crossJoin(distances_per_query(found.stats))
        row = row.select(F.lit(v).alias("value"), "recall", F.col("distances_per_query").alias("distances"))
        out = row if out is None else out.unionAll(row)
    require(out is not None, "no values")
    return out


def cheapest_that_clears(settings: DataFrame, target: float) -> DataFrame:
    """One row: value, recall, distances of the cheapest that reaches target; nulls if none does."""
    ok = settings.filter(F.col("recall") >= target)
    return ok.agg(F.min(F.struct("distances", "value", "recall")).alias("m")).select("m.value", "m.recall", "m.distances")


def best_available(settings: DataFrame) -> DataFrame:
    return settings.agg(F.max(F.struct("recall", -F.col("distances"), "value")).alias("m")).select("m.value", "m.recall")


def drops(by_value: DataFrame) -> DataFrame:
    """One row: how often a query's recall falls from a setting to the next; (qid, value, recall)."""
    w = Window.partitionBy("qid").orderBy("value")
    return by_value.withColumn("before", F.lag("recall").over(w)).agg(F.count_if(F.col("recall") < F.col("before")).alias("drops"))


# -- fusion ------------------------------------------------------------------------------------


def checked_ranking(ranking: DataFrame) -> DataFrame:
    missing = {"source", "qid", "rank", "id", "score"} - set(ranking.columns)
    if missing:
        raise DataError(f"a ranking lacks {sorted(missing)}")
    return ranking


def normaliser(name: str) -> Column:
    """Scores (smaller is better) on a common scale: max, range, best or global."""
    s, w = F.col("score"), Window.partitionBy("source", "qid")
    low, high = F.min(s).over(w), F.max(s).over(w)
    kinds = {
        "max": s / F.greatest(high, F.lit(1e-12)),
        "range": (s - low) / F.greatest(high - low, F.lit(1e-12)),
        "best": s / F.greatest(low, F.lit(1e-12)),
        "global": None,
    }
    if name not in kinds:
        raise ConfigError(f"unknown normaliser {name!r}")
    return kinds[name]


def normalised(rankings: DataFrame, how: str = "range") -> DataFrame:
    if how == "global":
        means = rankings.groupBy("source").agg(F.greatest(F.avg("score"), F.lit(1e-12)).alias("m"))
        return rankings.join(F.broadcast(means), "source").withColumn("norm", F.col("score") / F.col("m")).drop("m")
    return rankings.withColumn("norm", normaliser(how))


def _weights(spark, weights: dict[str, float] | None) -> DataFrame | None:
    return None if weights is None else spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")


def fuse_by_score(rankings: DataFrame, k: int = 10, weights: dict[str, float] | None = None, how: str = "range") -> DataFrame:
    """Weighted sums of normalised scores, the k smallest of the union; an absent id takes its list's worst."""
    n = normalised(checked_ranking(rankings), how)
    w = _weights(rankings.sparkSession, weights)
    n = n.withColumn("weight", F.lit(1.0)) if w is None else n.join(F.broadcast(w), "source")
    worst = n.groupBy("source", "qid").agg((F.first("weight") * F.max("norm")).alias("worst"))
    base = worst.groupBy("qid").agg(F.sum("worst").alias("base"))
    better = n.join(worst, ["source", "qid"]).groupBy("qid", "id").agg(F.sum(F.col("weight") * F.col("norm") - F.col("worst")).alias("less"))
    from ..functions.vector import top

    return top(better.join(base, "qid").select("qid", "id", (F.col("base") + F.col("less")).alias("score")), k)


def fuse_by_rank(rankings: DataFrame, k: int = 10, weights: dict[str, float] | None = None, constant: float = 1.0) -> DataFrame:
    """Sums of weight / (constant + rank), the k largest."""
    from ..functions.vector import top

    require(constant >= 0, "constant can't be negative")
    w = _weights(rankings.sparkSession, weights)
    n = checked_ranking(rankings)
    n = n.withColumn("weight", F.lit(1.0)) if w is None else n.join(F.broadcast(w), "source")
    summed = n.groupBy("qid", "id").agg(F.sum(F.col("weight") / (F.lit(float(constant)) + F.col("rank"))).alias("score"))
    return top(summed, k, "ip")


# -- reports -----------------------------------------------------------------------------------

ROW = "index string, corpus string, setting string, recall double, distances double, memory_bytes long, queries long"


@dataclass
class Report:
    """Measured rows and the sizes of their corpora."""

    rows: DataFrame
    corpus_sizes: dict[str, int] = field(default_factory=dict)

    def checked(self) -> Report:
        bad = self.rows.filter(~F.col("recall").between(0, 1) | (F.col("distances") < 0) | (F.col("memory_bytes") < 0))
        require(bad.isEmpty(), "a row is out of range", DataError)
        return self

    def add(self, row: dict) -> Report:
        return Report(self.rows.unionByName(self.rows.sparkSession.createDataFrame([row], ROW)), self.corpus_sizes)

    def for_index(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("index") == name)

    def for_corpus(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("corpus") == name)

    def with_speedup(self) -> DataFrame:
        sizes = self.rows.sparkSession.createDataFrame(list(self.corpus_sizes.items()), "corpus string, n long")
        return self.rows.join(F.broadcast(sizes), "corpus", "left").withColumn("speedup", F.when(F.col("distances") > 0, F.col("n") / F.col("distances")).otherwise(F.col("n").cast("double")))

    def means(self) -> DataFrame:
        """Mean recall by index and by corpus in one pass."""
        return self.rows.groupingSets([[F.col("index")], [F.col("corpus")]], F.col("index"), F.col("corpus")).agg(F.avg("recall").alias("recall"))

    def as_json(self) -> str:
        return json.dumps([r.asDict() for r in self.rows.orderBy("corpus", "index", "setting").collect()])

    def as_table(self) -> str:
        rows = self.rows.orderBy("corpus", "index", "setting").collect()
        return "\n".join([f"{'corpus':14}{'index':12}{'setting':14}{'recall':>8}{'distances':>12}"] + [f"{r.corpus:14}{r['index']:12}{r.setting:14}{r.recall:8.3f}{r.distances:12.1f}" for r in rows])


def standard_error(queries: int) -> float:
    return 0.17 / math.sqrt(queries)


def frontier(rows: DataFrame, budget: float, by: tuple[str, ...] = ("index",)) -> DataFrame:
    """(by..., recall): recall at a cost by linear interpolation; 0 below the cheapest row, the
    dearest row's value above it.  The bracketing rows come from lead, one sort a group."""
    best = rows.groupBy(*by, "distances").agg(F.max("recall").alias("recall"))
    w = Window.partitionBy(*by).orderBy("distances")
    seg = best.withColumn("d2", F.lead("distances").over(w)).withColumn("r2", F.lead("recall").over(w))
    at = F.when(F.col("d2").isNull(), F.col("recall")).otherwise(
        F.col("recall") + (F.col("r2") - F.col("recall")) * (F.lit(budget) - F.col("distances")) / (F.col("d2") - F.col("distances"))
    )
    inside = (F.col("distances") <= budget) & (F.col("d2").isNull() | (F.col("d2") > budget))
    return seg.groupBy(*by).agg(F.coalesce(F.max(F.when(inside, at)), F.lit(0.0)).alias("recall"))


def compare_at_a_budget(report: Report, corpus: str, budget: float = 1000.0) -> DataFrame:
    return frontier(report.for_corpus(corpus), budget).orderBy(F.col("recall").desc(), "index")


# -- attacks -----------------------------------------------------------------------------------


def from_sparse_regions(corpus: DataFrame, sample: DataFrame, count: int = 100, k: int = 10, first_rows: int = 4096) -> DataFrame:
    """(qid, q): sampled rows with the largest distance to their k-th other neighbour.

    The distance to the k-th neighbour among part of the corpus is no smaller than that among all.  Growing
    parts bound it for each row, the widest of these are measured among all, and rows whose bound is below the
    ``count`` largest of what was measured are left out: none of them can be an answer.
    """
    from ..operators.exact import search, spread
    from .lineage import materialise

    rows, asked = spread(corpus.select("id", "v")), sample.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    kth = lambda q, among: search(q, among, k + 1).filter(F.col("rank") == k + 1).select("qid", "score")
    share, left = max(1, corpus.count() // first_rows), asked
    while share > 1:
        part = rows.filter(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(share)) == 0)
        bound = materialise(left.select("qid").join(kth(left, part), "qid", "left"))  # none where the part holds too few rows
        widest = bound.orderBy(F.col("score").desc_nulls_first(), "qid").limit(2 * count)
        edge = kth(left.join(widest, "qid", "left_semi"), rows).orderBy(F.col("score").desc()).limit(count).agg(F.count("*").alias("n"), F.min("score").alias("edge")).first()
        if edge.n == count:
            near = bound.filter(F.col("score") < edge.edge).select("qid")
            left = materialise(left.join(near, "qid", "left_anti"))
        share //= 8
    far = kth(left, rows).orderBy(F.col("score").desc(), "qid").limit(count)
    return asked.join(far.select("qid"), "qid", "left_semi")


def between_partitions(centres: DataFrame, count: int = 100) -> DataFrame:
    """(qid, q): midpoints of pairs of centres (part, c), the pairs in order of their parts."""
    from ..functions.vector import add, times

    a, b = centres.select(F.col("part").alias("p1"), F.col("c").alias("c1")), centres.select(F.col("part").alias("p2"), F.col("c").alias("c2"))
    pairs = a.join(F.broadcast(b), F.col("p1") < F.col("p2")).orderBy("p1", "p2").limit(count)
    w = Window.orderBy("p1", "p2")
    return pairs.select((F.row_number().over(w) - 1).cast("long").alias("qid"), times(add("c1", "c2"), 0.5).alias("q"))


def far_from(corpus: DataFrame, entry: Column, count: int = 100) -> DataFrame:
    """(qid, q): rows furthest from a walk's entry."""
    from ..functions.vector import squared_l2

    return corpus.orderBy(squared_l2("v", entry).desc(), "id").limit(count).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def the_worst_answered(pool: DataFrame, recalls: DataFrame, count: int = 100) -> DataFrame:
    """(qid, q) of the lowest recall, ties by id."""
    return pool.join(recalls.orderBy("recall", "qid").limit(count).select("qid"), "qid", "left_semi")
