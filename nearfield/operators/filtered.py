"""Search under a predicate, applied before, after, or inside the access method."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import squared_l2
from .exact import search
from .ivf import ivf_search
from .kmeans import uniform_sample


def selectivity(corpus: DataFrame, keep: Column) -> DataFrame:
    """One row: matching rows, all rows, and their share."""
    hit = F.coalesce(keep, F.lit(False)).cast("int")
    return corpus.agg(F.sum(hit).alias("matching"), F.count("*").alias("rows"), F.avg(hit).alias("selectivity"))


def random_predicate(corpus: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """(id) of max(1, round(n * share)) rows, by hash of seed and id."""
    require(0 < share <= 1, f"selectivity {share}")
    m = max(1, round(corpus.count() * share))
    return uniform_sample(corpus.select("id"), m, seed)


def clustered_predicate(corpus: DataFrame, share: float = 0.1, pivot: int = 0) -> DataFrame:
    """(id) of the rows nearest to the row ``pivot``."""
    require(0 < share <= 1, f"selectivity {share}")
    m = max(1, round(corpus.count() * share))
    at = corpus.filter(F.col("id") == pivot).select("v").first()
    require(at is not None, f"no row {pivot}")
    return corpus.orderBy(squared_l2("v", F.array(*[F.lit(float(x)) for x in at.v])), "id").limit(m).select("id")


def filter_then_search(queries: DataFrame, corpus: DataFrame, keep: Column, k: int = 10, metric: str = "l2") -> DataFrame:
    """The k nearest matching rows: exact.  The predicate reaches the scan of the corpus."""
    return search(queries, corpus, k, metric, keep)


exact_filtered = filter_then_search


def search_then_filter(queries: DataFrame, corpus: DataFrame, keep: Column, k: int = 10, over_fetch: int = 10, metric: str = "l2") -> DataFrame:
    """k * over_fetch nearest rows, then those that match, k at most; short where few do."""
    require(over_fetch >= 1, "over_fetch must be at least 1")
    wide = search(queries, corpus.select("id", "v"), k * over_fetch, metric)
    passing = wide.join(corpus.filter(keep).select(F.col("id").cast("long").alias("id")), "id", "left_semi")
    return _renumbered(passing, k)


def filter_in_lists(queries: DataFrame, lists: DataFrame, centres: np.ndarray, keep: Column, k: int = 10, probe: int = 8, metric: str = "l2") -> DataFrame:
    """Opened lists, of which only matching rows are scored."""
    return ivf_search(queries, lists.filter(keep), centres, k, probe, metric)


def filter_walk(found: DataFrame, matching: DataFrame, k: int) -> DataFrame:
    """A wide walk's result without rows that don't match, k at most."""
    return _renumbered(found.join(matching.select("id"), "id", "left_semi"), k)


def _renumbered(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("rank")
    again = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return again.select("qid", F.col("r").alias("rank"), "id", "score")
