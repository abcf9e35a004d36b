"""Vector arithmetic as Column expressions, computed in DOUBLE inside the JVM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, require


@dataclass(frozen=True)
class Metric:
    """Direction of a score, and whether triangle-inequality pruning is legal with it."""

    name: str
    smaller_is_closer: bool
    is_a_metric: bool


METRICS = {
    "l2": Metric("l2", True, True),
    "ip": Metric("ip", False, False),
    "cosine": Metric("cosine", False, False),
}
EPSILON = 1e-12


def metric_named(name: str) -> Metric:
    if name not in METRICS:
        raise ConfigError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def which_metrics_allow_pruning(names=tuple(METRICS)) -> dict[str, list[str]]:
    """Names by whether pruning by the triangle inequality is sound for them."""
    return {
        "prunable": [n for n in names if metric_named(n).is_a_metric],
        "not_prunable": [n for n in names if not metric_named(n).is_a_metric],
    }


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column | str) -> Column:
    """Unit length; a vector shorter than EPSILON is divided by EPSILON, so zero stays zero."""
    v = doubles(v)
    length = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def score(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Score of two vectors: squared L2, inner product or cosine."""
    return {"l2": squared_l2, "ip": dot, "cosine": cosine}[metric_named(metric).name](a, b)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def times(v: Column | str, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(doubles(v), lambda x: x * factor)


def project(v: Column | str, rows: list[list[float]]) -> Column:
    """The dot products of v with some fixed rows (a small matrix, as literals)."""
    v = doubles(v)
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in r])) for r in rows])


def best(metric: str, by: Column | str = "score") -> Column:
    """Order of scores, closest first."""
    return _c(by).asc() if metric_named(metric).smaller_is_closer else _c(by).desc()


def hashed(seed: int, *key: Column | str) -> Column:
    """A number from 0 below 2^52 hashed from the key: the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *key: Column | str) -> Column:
    """hashed, between 0 and 1 and neither of them."""
    return (hashed(seed, *key) + 0.5) / F.lit(float(1 << 52))


def normals(dimension: int, seed: int, key: Column | str = "id") -> Column:
    """An array of standard normal numbers, each hashed from seed, key and place: a retried task draws the same."""
    one = lambda i: F.sqrt(-2 * F.log(uniform(seed, key, i, F.lit("r")))) * F.cos(uniform(seed, key, i, F.lit("a")) * (2 * math.pi))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), one)


def sound_unions(spark: SparkSession) -> None:
    """Has unions dealt anew where they are grouped, for the session.

    Spark 4.1 takes a union of frames that are dealt alike for dealt like them, but joins their
    partitions end to end; groupings and joins of the union then miss rows of one another.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def top(scored: DataFrame, k: int, metric: str = "l2", by: tuple[str, ...] = ("qid",), ids: str = "id") -> DataFrame:
    """(by..., rank, id, score) of the k best rows of each group; ties go to the smaller id.

    Spark plans a partial limit before the shuffle, so a task sends k rows a group at most.
    """
    require(k >= 1, f"k must be at least 1, not {k}")
    sound_unions(scored.sparkSession)
    w = Window.partitionBy(*by).orderBy(best(metric), F.col(ids))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(*by, "rank", ids, "score")


def checked(vectors: DataFrame, column: str = "v") -> tuple[int, int]:
    """(rows, width) of a vector column, by one aggregation; refuses what is not a vector set."""
    sound_unions(vectors.sparkSession)
    kind = dict(vectors.dtypes).get(column)
    require(kind in ("array<float>", "array<double>"), f"{column} is {kind}, not an array of floats", DataError)
    r = vectors.agg(F.count("*").alias("n"), F.count(column).alias("there"), F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    require(r.n > 0, "no vectors", DataError)
    require(r.n == r.there, "null vectors", DataError)
    require(r.a == r.b and r.a > 0, f"widths from {r.a} to {r.b}", DataError)
    return r.n, r.b
