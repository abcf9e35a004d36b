"""Invariants that every result has to keep, as counts of violations, and sweeps over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import squared_l2
from ..operators.exact import pair_scores, search


def violations(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(rule, violations): a row for each rule, 0 where it holds."""
    counts = found.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("score").alias("best"))
    asked = queries.select("qid").join(counts, "qid", "left")
    w = Window.partitionBy("qid").orderBy("rank")
    true = pair_scores(found.select("qid", "id", F.col("score").alias("said")), queries, corpus)
    kth = search(queries, corpus, k).groupBy("qid").agg(F.max("score").alias("kth"))
    rules = [
        ("returns_k_results", asked.agg(F.count_if(F.coalesce("n", F.lit(0)) != k).alias("violations"))),
        ("identifiers_are_distinct", counts.agg(F.count_if(F.col("n") != F.col("d")).alias("violations"))),
        ("identifiers_are_in_range", found.join(corpus.select("id"), "id", "left_anti").agg(F.count("*").alias("violations"))),
        ("scores_agree_with_identifiers", true.agg(F.count_if(F.abs(F.col("said") - F.col("score")) > 1e-3 * F.greatest(F.lit(1.0), F.col("score"))).alias("violations"))),
        ("results_are_ordered", found.withColumn("p", F.lag("score").over(w)).agg(F.count_if(F.col("score") < F.col("p") - 1e-5).alias("violations"))),
        ("the_nearest_is_within_the_exact_kth", counts.join(kth, "qid").agg(F.count_if(F.col("best") > F.col("kth") + 1e-4).alias("violations"))),
    ]
    out = None
    for name, frame in rules:
        row = frame.select(F.lit(name).alias("rule"), F.col("violations").cast("long").alias("violations"))
        out = row if out is None else out.unionAll(row)
    return out


def every_structure(dimension: int = 32) -> dict:
    """(index, setting) to a new index: what a report measures."""
    from ..operators import codes, hashing, index, ivf, sharded

    slices = 8 if dimension % 8 == 0 else 1
    return {
        ("flat", "all"): lambda: index.FlatIndex(dimension),
        ("ivf", "probe 4"): lambda: ivf.IVFIndex(dimension, 64, "l2", 4),
        ("ivf", "probe 8"): lambda: ivf.IVFIndex(dimension, 64, "l2", 8),
        ("ivf", "probe 16"): lambda: ivf.IVFIndex(dimension, 64, "l2", 16),
        ("spill", "probe 8"): lambda: ivf.SpillIndex(dimension, 64, 8, 2),
        ("tree", "leaf 16"): lambda: sharded.TreeIndex(dimension),
        ("forest", "8 trees"): lambda: sharded.ForestIndex(dimension, 8),
        ("graph", "ef 32"): lambda: sharded.GraphIndex(dimension, ef=32),
        ("graph", "ef 64"): lambda: sharded.GraphIndex(dimension, ef=64),
        ("hnsw", "ef 32"): lambda: sharded.HNSWIndex(dimension, ef=32),
        ("lsh", "8 tables"): lambda: hashing.LSHIndex(dimension, 12, 8),
        ("residual", "rerank 100"): lambda: codes.ResidualIndex(dimension, 2, 64, 100),
        ("binary", "rerank 100"): lambda: codes.BinaryIndex(dimension, 100),
        ("composite", "probe 8"): lambda: codes.CompositeIndex(dimension, 64, slices, 64, 8, 100),
    }


def standard_corpora(spark: SparkSession, count: int = 4096, dimension: int = 32) -> dict[str, DataFrame]:
    """The corpora of a report."""
    from ..sources import datasets

    return {
        "gaussian": datasets.gaussian(spark, count, dimension),
        "clustered": datasets.clustered(spark, count, dimension),
        "subspace": datasets.on_a_subspace(spark, count, dimension, min(8, dimension)),
        "normalised": datasets.unit_vectors(spark, count, dimension),
    }


def every_index(dimension: int = 16) -> dict:
    """All structures at small settings."""
    from ..operators import codes, hashing, index, ivf, sharded

    return {
        "flat": index.FlatIndex(dimension),
        "ivf": ivf.IVFIndex(dimension, 8, "l2", 4),
        "spill": ivf.SpillIndex(dimension, 8, 4, 2),
        "tree": sharded.TreeIndex(dimension),
        "forest": sharded.ForestIndex(dimension, 8, 32),
        "graph": sharded.GraphIndex(dimension, 8, 16, 32),
        "hnsw": sharded.HNSWIndex(dimension, 8, 32, 32),
        "lsh": hashing.LSHIndex(dimension, 6, 8),
        "residual": codes.ResidualIndex(dimension, 2, 16, 50),
        "binary": codes.BinaryIndex(dimension, 100),
        "composite": codes.CompositeIndex(dimension, 8, 4, 16, 4, 50),
    }


def awkward_corpora(spark: SparkSession, dimension: int = 16, count: int = 512) -> dict[str, DataFrame]:
    from ..sources import datasets

    one = datasets.gaussian(spark, 2, dimension).limit(1).select("v")
    return {
        "gaussian": datasets.gaussian(spark, count, dimension),
        "clustered": datasets.clustered(spark, count, dimension),
        "subspace": datasets.on_a_subspace(spark, count, dimension, 3),
        "duplicated": datasets.copied(datasets.gaussian(spark, count // 4, dimension), 4).select("id", "v"),
        "identical": spark.range(count).crossJoin(F.broadcast(one)),
    }


def sweep(spark: SparkSession, names: tuple[str, ...] | None = None, dimension: int = 16, count: int = 512, queries: int = 16, k: int = 10) -> DataFrame:
    """(index, corpus, rule, violations) over indexes and corpora."""
    from .lineage import materialise

    out = None
    for label, corpus in awkward_corpora(spark, dimension, count).items():
        corpus = materialise(corpus)
        asked = corpus.filter(F.col("id") < queries).select(F.col("id").alias("qid"), F.transform("v", lambda x, i: x + 0.05 * F.sin(i + 1)).alias("q"))
        for name, index in every_index(dimension).items():
            if names and name not in names:
                continue
            found = materialise(index.build(corpus).search(asked, k).result)
            row = violations(found, corpus, asked, k).select(F.lit(name).alias("index"), F.lit(label).alias("corpus"), "rule", "violations")
            row = materialise(row)
            out = row if out is None else out.unionAll(row)
    return out


def by_rule(report: DataFrame) -> DataFrame:
    return report.groupBy("rule").agg(F.sum("violations").alias("violations"))


def clean(report: DataFrame) -> bool:
    return report.filter("violations > 0").isEmpty()


def distance_bound(a: str, b: str):
    """Root distance of two columns; for range joins against boxes and radii."""
    return F.sqrt(squared_l2(a, b))
