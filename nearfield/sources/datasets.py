"""Corpora: tables, seeded generators, held-out queries, and diagnostics of a corpus.

Generators hash each number from seed, id and place, so a table is made where it is used,
nothing passes the driver, and any engine with md5 makes the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.vector import add, hashed, normalise, normals, times, uniform
from ..operators.codes import literal
from ..operators.exact import distance_sums, pair_distance_sum, search, spread


def corpus_table(spark: SparkSession, sf_dir: str, name: str = "embeddings", ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of a Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(ids).alias("id"), F.col(column).alias("v"))


def _rows(spark: SparkSession, count: int) -> DataFrame:
    require(count >= 2, "a corpus has at least 2 rows")
    return spark.range(0, count, 1, max(1, min(64, count // 4096 + 1)))


def gaussian(spark: SparkSession, count: int = 4096, dimension: int = 32, seed: int = 0) -> DataFrame:
    require(dimension >= 1, "dimension must be at least 1")
    return _rows(spark, count).select("id", normals(dimension, seed).alias("v"))


def clustered(spark: SparkSession, count: int = 4096, dimension: int = 32, clusters: int = 16, spread: float = 0.15, seed: int = 0) -> DataFrame:
    """Rows around random centres."""
    require(1 <= clusters <= count and spread >= 0, f"{clusters} clusters, spread {spread}")
    centres = spark.range(clusters).select(F.col("id").alias("at"), normals(dimension, seed + 2).alias("c"))
    rows = _rows(spark, count).select("id", F.pmod(hashed(seed, "id"), F.lit(clusters)).alias("at"), normals(dimension, seed + 1).alias("e"))
    return rows.join(F.broadcast(centres), "at").select("id", add("c", times("e", spread)).alias("v"))


def on_a_subspace(spark: SparkSession, count: int = 4096, dimension: int = 512, intrinsic: int = 8, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Latent normals times an orthonormal basis, plus noise."""
    require(1 <= intrinsic <= dimension and noise >= 0, f"intrinsic {intrinsic} of {dimension}")
    from ..functions.vector import project

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, intrinsic)))[0]
    rows = _rows(spark, count).select("id", normals(intrinsic, seed).alias("z"), normals(dimension if noise else 1, seed + 1).alias("e"))
    v = project("z", basis.tolist())
    return rows.select("id", (add(v, times("e", noise)) if noise else v).alias("v"))


def skewed(spark: SparkSession, count: int = 4096, dimension: int = 64, decay: float = 0.9, seed: int = 0) -> DataFrame:
    """Normals whose deviations fall geometrically by coordinate."""
    require(0 < decay <= 1, f"decay {decay}")
    scale = [decay**i for i in range(dimension)]
    return gaussian(spark, count, dimension, seed).select("id", F.zip_with("v", literal(scale), lambda x, s: x * s).alias("v"))


def unit_vectors(spark: SparkSession, count: int = 512, dimension: int = 64, seed: int = 0) -> DataFrame:
    return gaussian(spark, count, dimension, seed).select("id", normalise("v").alias("v"))


def scaled_vectors(spark: SparkSession, count: int = 512, dimension: int = 64, spread: float = 8.0, seed: int = 0) -> DataFrame:
    """Random directions of lengths from 1 to spread."""
    require(spread >= 1, f"spread {spread}")
    u = unit_vectors(spark, count, dimension, seed).withColumn("s", 1 + (spread - 1) * uniform(seed + 7, "id"))
    return u.select("id", times("v", F.col("s")).alias("v"))


def copied(corpus: DataFrame, copies: int = 4) -> DataFrame:
    """Every row ``copies`` times, under ids id * copies + i; (id, v, original)."""
    require(copies >= 1, "copies must be at least 1")
    each = corpus.select("v", F.col("id").alias("original"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("i"))
    return each.select((F.col("original") * copies + F.col("i")).cast("long").alias("id"), "v", "original")


def held_out(corpus: DataFrame, count: int = 128, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(corpus without them, queries): the rows of the smallest hashes of seed and id."""
    from ..operators.kmeans import near_hashes

    few, h = near_hashes(corpus, count, seed)
    edge = few.select(h.alias("h")).orderBy("h").limit(count).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    require(1 <= count and edge.n == count, f"{count} queries from {edge.n} rows")
    return corpus.filter(h > edge.h), corpus.filter(h <= edge.h).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _sampled(corpus: DataFrame, sample: int, seed: int) -> DataFrame:
    """(id, v) of ``sample`` rows; where there are no more than these, of all, which then need no order and no one task."""
    from ..operators.kmeans import uniform_sample

    rows = corpus.select("id", "v")
    return rows if rows.count() <= sample else uniform_sample(rows, sample, seed)


def typical_distance(corpus: DataFrame, sample: int = 256, seed: int = 5) -> DataFrame:
    """One row: typical_distance, the mean distance of pairs of sampled rows."""
    return pair_distance_sum(_sampled(corpus, sample, seed)).select(F.try_divide("total", "n").alias("typical_distance"))


def perturbed_queries(corpus: DataFrame, count: int = 128, nudge: float = 0.25, seed: int = 11) -> DataFrame:
    """(qid, q): rows moved by a random unit step times nudge times the typical distance."""
    from ..operators.kmeans import uniform_sample

    d = len(corpus.select("v").first().v)
    step = float(nudge * typical_distance(corpus, seed=seed).first()[0])
    rows = uniform_sample(corpus.select("id", "v"), count, seed).withColumn("e", normalise(normals(d, seed + 3)))
    return rows.select(F.col("id").alias("qid"), add("v", times("e", step)).alias("q"))


def relative_contrast(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: contrast, the mean over queries of mean distance over nearest distance, own rows left out."""
    mean = F.col("total") / F.col("n")
    return distance_sums(queries, corpus).agg(F.avg(mean / F.greatest("least", F.lit(1e-9))).alias("contrast"))


def neighbour_margin(found: DataFrame) -> DataFrame:
    """One row: margin, the mean of (second - first) / first distance of results."""
    two = found.filter("rank <= 2").groupBy("qid").agg(F.sqrt(F.min("score")).alias("a"), F.sqrt(F.max("score")).alias("b"))
    return two.agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", F.lit(1e-9))).alias("margin"))


def intrinsic_dimension(corpus: DataFrame, sample: int = 1024, seed: int = 13) -> DataFrame:
    """One row: dimension by two nearest neighbours: slope of -ln(1 - F) on ln(r2 / r1), F < 0.9."""
    from ..plans.storage import numbered

    s = _sampled(corpus, sample, seed)
    near = search(s.select(F.col("id").alias("qid"), F.col("v").alias("q")), spread(corpus.select("id", "v")), 3).filter("qid != id")
    two = near.groupBy("qid").agg(F.min("score").alias("a"), F.min(F.when(F.col("rank") >= 3, F.col("score"))).alias("b")).filter("a > 0 and b > 0")
    ordered = numbered(two.select("qid", F.log(F.sqrt(F.col("b") / F.col("a"))).alias("x")), "x", "qid")
    ranked = ordered.select("x", ((F.col("number") + 1) / F.lit(float(max(1, ordered.count())))).alias("f"))
    return ranked.filter("f < 0.9").agg((F.sum(F.col("x") * -F.log(1 - F.col("f"))) / F.sum(F.col("x") * F.col("x"))).alias("dimension"))


def nearest_neighbour_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: stable, the share of queries with the same nearest row in two results."""
    a, b = (x.filter("rank = 1").select("qid", F.col("id").alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "qid").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("stable"))


def expected_contrast(dimension: int, count: int = 2048) -> float:
    """Mean over nearest distance of normals in closed form."""
    mean = math.sqrt(2 * dimension)
    return mean / max(1e-9, mean - math.sqrt(2 * math.log(count)))
