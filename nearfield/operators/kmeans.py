"""Clustering: k-means over the whole table or a bounded sample, assignment, sampling.

Centres are few (partitions x width numbers) and live on the driver; vectors never do, except
a sample of stated size.  Each round is one scan: tasks return sums and counts of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, ConfigError, DataError, require
from ..functions.vector import checked, doubles, hashed, uniform
from ..plans.lineage import materialise
from .exact import matrix, score_matrix


@dataclass
class Clustering:
    """centres[part]; sizes, rounds and inertia of the last round."""

    centres: np.ndarray
    sizes: np.ndarray
    rounds: int
    inertia: float

    def __post_init__(self) -> None:
        require(len(self.centres) > 0, "no centres")
        if not self.sizes.any():
            raise BuildError("every partition is empty")

    @property
    def k(self) -> int:
        return len(self.centres)

    def as_dict(self) -> dict:
        return {"k": self.k, "rounds": self.rounds, "inertia": self.inertia, "largest": int(self.sizes.max()), "empty": int((self.sizes == 0).sum())}


def centre_frame(spark, centres: np.ndarray) -> DataFrame:
    """(part, c) rows of centres."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "part int, c array<double>")


def centres_of(frame: DataFrame) -> np.ndarray:
    """Centres of a (part, c) table, whose parts are 0, 1, ... without gaps."""
    rows = sorted(frame.select("part", "c").collect())
    require([r[0] for r in rows] == list(range(len(rows))), "parts are not 0, 1, ...", DataError)
    return np.array([r[1] for r in rows], dtype=np.float64)


def assign(vectors: DataFrame, centres: np.ndarray, nearest: int = 1, metric: str = "l2") -> DataFrame:
    """vectors' (id, v) with part, nth (from 1) and score of the ``nearest`` centres of each row."""
    require(1 <= nearest <= len(centres), f"{nearest} of {len(centres)} centres")
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1))
            if v.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors are {v.shape[1]} wide and centres {shared.value.shape[1]}")
            scores = score_matrix(v, shared.value, metric)
            order = np.argsort(scores if metric == "l2" else -scores, axis=1, kind="stable")[:, :nearest]
            at = np.repeat(np.arange(len(v)), nearest)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    b.column(1).take(pa.array(at)).cast(pa.list_(pa.float64())),
                    pa.array(order.reshape(-1).astype(np.int32)),
                    pa.array(np.tile(np.arange(1, nearest + 1, dtype=np.int32), len(v))),
                    pa.array(np.take_along_axis(scores, order, 1).reshape(-1)),
                ],
                names=["id", "v", "part", "nth", "score"],
            )

    rows = vectors.select(F.col("id").cast("long").alias("id"), "v").filter(F.col("v").isNotNull())
    return rows.mapInArrow(run, "id long, v array<double>, part int, nth int, score double")


def inertia_of(assigned: DataFrame) -> DataFrame:
    """One row: inertia, the sum of scores of first assignments."""
    return assigned.filter("nth = 1").agg(F.sum("score").alias("inertia"))


def _round(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray | None]:
    """Sums and counts by partition, inertia, and the row furthest from its centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    p, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertia, far = np.zeros((p, d)), np.zeros(p), 0.0, (-1.0, None)
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(0))
                scores = score_matrix(v, shared.value, "l2")
                part = scores.argmin(1)
                near = scores[np.arange(len(v)), part]
                np.add.at(sums, part, v)
                counts += np.bincount(part, minlength=p)
                inertia += float(near.sum())
                if near.max() > far[0]:
                    far = (float(near.max()), v[near.argmax()].tolist())
        rows = [(i, int(counts[i]), sums[i].tolist(), 0.0) for i in np.flatnonzero(counts)]
        rows += [(-1, 0, far[1], inertia), (-2, 0, far[1], far[0])] if far[1] is not None else []
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "n", "s", "x"), r, strict=True)) for r in rows],
            schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("x", pa.float64())]),
        )

    made = vectors.select("v").filter(F.col("v").isNotNull()).mapInArrow(run, "part int, n long, s array<double>, x double")
    longs = made.filter("part >= 0").select("part", "n", F.posexplode("s").alias("dim", "s")).groupBy("part", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rest = made.filter("part < 0").groupBy("part").agg(F.sum("x").alias("x"), F.max_by("s", "x").alias("v"))
    out = longs.select("part", "dim", "n", "s", F.lit(None).cast("array<double>").alias("v")).unionAll(
        rest.select("part", F.lit(0).alias("dim"), F.lit(0).cast("long").alias("n"), F.col("x").alias("s"), "v")
    )
    sums, counts, inertia, far = np.zeros((p, d)), np.zeros(p), 0.0, None
    for r in out.collect():  # partitions x width numbers
        if r.part >= 0:
            sums[r.part, r.dim], counts[r.part] = r.s, r.n
        elif r.part == -1:
            inertia = r.s
        else:
            far = np.array(r.v)
    return sums, counts, inertia, far


def near_hashes(rows: DataFrame, count: int, seed: int, ids: str = "id") -> tuple[DataFrame, Column]:
    """(rows that hold the ``count`` smallest hashes of seed and id, the hash).

    A limit after a sort takes ``count`` rows from every task; here a threshold on the hash
    leaves little more than ``count`` rows in all, which is checked by a count.
    """
    h = hashed(seed, ids)
    n = rows.count()
    share = (count + 6 * count**0.5 + 10) / max(n, 1)
    if share < 0.5:
        few = rows.filter(h <= F.lit(int(share * 2**52)))
        if few.count() >= count:
            return few, h
    return rows, h


def random_init(vectors: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k distinct rows, those of the smallest hashes of seed and id."""
    require(k >= 1, f"k must be at least 1, not {k}")
    rows = uniform_sample(vectors.filter(F.col("v").isNotNull()), k, seed).select("v").collect()
    require(len(rows) == k, f"k is {k}, but there are {len(rows)} rows")
    return np.array([r.v for r in rows], dtype=np.float64)


def plus_plus_init(vectors: DataFrame, k: int, seed: int = 0, sample: int = 20_000) -> np.ndarray:
    """k-means++ seeds (chosen by squared distance) among a bounded sample of rows.

    Where k is more than a tenth of the sample, which it would then nearly copy, seeds come from
    rounds over all rows instead (``oversampled_init``).
    """
    if 10 * k > sample:
        return oversampled_init(vectors, k, seed)
    pool = _sample(vectors, sample, seed)
    require(len(pool) >= k >= 1, f"k is {k}, but there are {len(pool)} rows")
    rng = np.random.default_rng(seed)
    chosen = [pool[rng.integers(len(pool))]]
    near = score_matrix(pool, np.array(chosen), "l2")[:, 0]
    while len(chosen) < k:
        at = rng.choice(len(pool), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(pool))
        chosen.append(pool[at])
        near = np.minimum(near, score_matrix(pool, pool[at][None], "l2")[:, 0])
    return np.array(chosen)


def oversampled_init(vectors: DataFrame, k: int, seed: int = 0, rounds: int = 4, factor: float = 2.0) -> np.ndarray:
    """k seeds by oversampling (k-means||): rounds over all rows, then a weighted choice among what they drew.

    Each round draws about ``factor`` * k rows, each by its squared distance to what is drawn so
    far, at a hash of its id; tasks hold a block of a round's rows and return rows and sums.  Each
    row drawn weighs as many rows as are nearest to it; k of them are chosen by weight and distance.
    """
    rows = vectors.filter(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), doubles("v").alias("v"))
    spark, n = vectors.sparkSession, rows.count()
    require(n >= k >= 1, f"k is {k}, but there are {n} rows")
    new = np.array(rows.orderBy(hashed(seed, "id"), "id").limit(1).select("v").first().v)[None]
    drawn, state = new, rows.withColumn("d", F.lit(float("inf"))).withColumn("at", F.lit(-1).cast("long"))
    for r in range(rounds):
        state = materialise(_nearer(state, spark.sparkContext.broadcast((len(drawn) - len(new), new))))
        whole = state.agg(F.sum("d")).first()[0]
        if not whole:
            break
        chance = F.least(F.lit(1.0), F.lit(factor * k / whole) * F.col("d"))
        found = state.filter((F.col("d") > 0) & (uniform(seed + 1 + r, "id") < chance)).select("id", "v").orderBy("id").toPandas()["v"]  # some factor * k rows
        new = np.stack(found.to_numpy()) if len(found) else np.empty((0, drawn.shape[1]))
        drawn = np.concatenate((drawn, new))
    if len(new):
        state = _nearer(state, spark.sparkContext.broadcast((len(drawn) - len(new), new)))
    weights = np.zeros(len(drawn))
    for at, count in state.groupBy("at").agg(F.count("*")).collect():  # a row for each that was drawn
        weights[at] = count
    if len(drawn) < k:  # fewer different rows than seeds
        more = rows.orderBy(hashed(seed + 99, "id"), "id").limit(k - len(drawn)).select("v").collect()
        return np.concatenate((drawn, np.array([x.v for x in more])))
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(drawn), p=weights / weights.sum()))]
    near = score_matrix(drawn, drawn[chosen], "l2")[:, 0]
    while len(chosen) < k:
        p = near * weights
        p[chosen] = 0.0
        left = np.setdiff1d(np.arange(len(drawn)), chosen)
        at = int(rng.choice(len(drawn), p=p / p.sum())) if p.sum() > 0 else int(left[0])
        chosen.append(at)
        near = np.minimum(near, score_matrix(drawn, drawn[at][None], "l2")[:, 0])
    return drawn[chosen]


def _nearer(state: DataFrame, shared) -> DataFrame:
    """state (id, v, d, at) with the distance to, and the number of, the nearest of more centres; earlier ones keep ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, centres = shared.value
        for b in batches:
            v, d, at = matrix(b.column(1)), b.column(2).to_numpy().copy(), b.column(3).to_numpy().copy()
            step = max(1, 4_000_000 // max(1, len(v)))
            for cut in range(0, len(centres), step):
                scores = score_matrix(v, centres[cut : cut + step], "l2")
                best = scores.argmin(1)
                least = scores[np.arange(len(v)), best]
                closer = least < d
                d[closer], at[closer] = least[closer], first + cut + best[closer]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), pa.array(at)], names=["id", "v", "d", "at"])

    return state.select("id", "v", "d", "at").mapInArrow(run, "id long, v array<double>, d double, at long")


def lloyd(vectors: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-4, seed: int = 0, init: np.ndarray | None = None) -> Clustering:
    """k-means over all rows.  Ends when the inertia's relative gain is below tolerance (never
    in the first round).  An empty partition is moved to the row furthest from its centre."""
    require(rounds >= 1, "rounds must be at least 1")
    require(tolerance > 0, "tolerance must be above 0")
    checked(vectors)
    centres = plus_plus_init(vectors, k, seed) if init is None else np.array(init, dtype=np.float64)
    last = None
    for n in range(1, rounds + 1):
        sums, counts, inertia, far = _round(vectors, centres)
        full = counts > 0
        centres = centres.copy()
        centres[full] = sums[full] / counts[full, None]
        for i in np.flatnonzero(~full)[:1]:
            centres[i] = far
        if last is not None and last - inertia <= tolerance * max(last, 1e-12) and full.all():
            break
        last = inertia
    return Clustering(centres, counts, n, inertia)


def minibatch(vectors: DataFrame, k: int, rounds: int = 10, batch: int = 1024, seed: int = 0) -> Clustering:
    """k-means on a fresh bounded sample each round, centres moved by running means."""
    require(rounds >= 1, "rounds must be at least 1")
    n, _ = checked(vectors)
    require(1 <= batch <= n, f"batch is {batch}; there are {n} rows")
    centres, seen = plus_plus_init(vectors, k, seed, batch), np.zeros(k)
    for r in range(rounds):
        v = _sample(vectors, batch, seed + 1 + r)
        part = score_matrix(v, centres, "l2").argmin(1)
        for p in np.unique(part):
            own = v[part == p]
            seen[p] += len(own)
            centres[p] += (own - centres[p]).sum(0) / seen[p]
    _, counts, inertia, _ = _round(vectors, centres)
    return Clustering(centres, counts, rounds, inertia)


@dataclass
class Fit:
    """Centres fitted on part of a corpus."""

    centres: np.ndarray
    sample_size: int
    corpus_size: int
    rounds: int
    inertia: float

    @property
    def partitions(self) -> int:
        return len(self.centres)

    @property
    def share(self) -> float:
        return self.sample_size / self.corpus_size if self.corpus_size else 0.0

    @property
    def samples_per_centre(self) -> float:
        return self.sample_size / len(self.centres) if len(self.centres) else 0.0


def uniform_sample(vectors: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Exactly ``count`` rows without replacement: the smallest hashes of seed and id."""
    require(count >= 1, f"count must be at least 1, not {count}")
    few, h = near_hashes(vectors, count, seed)
    return few.orderBy(h, "id").limit(count)


def dense_sample(vectors: DataFrame, count: int, sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """``count`` rows without replacement, likelier near the mean: exponential keys by weight."""
    require(count >= 1, f"count must be at least 1, not {count}")
    from ..functions.vector import squared_l2

    centre = [float(x) for x in mean_vector(vectors)]
    u = uniform(seed, "id")
    distance = F.sqrt(squared_l2("v", F.array(*map(F.lit, centre))))
    return vectors.orderBy(-F.log(u) * F.exp(F.lit(sharpness) * distance), "id").limit(count)


def mean_vector(vectors: DataFrame) -> np.ndarray:
    """Mean by coordinate (width numbers)."""
    rows = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    return np.array([r.m for r in sorted(rows)])


def _sample(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    rows = uniform_sample(vectors.filter(F.col("v").isNotNull()), count, seed).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def local_lloyd(v: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """k-means of a matrix in memory: for samples and sub-spaces of stated size."""
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), size=k, replace=False)].copy()
    inertia = 0.0
    for _ in range(rounds):
        scores = score_matrix(v, centres, "l2")
        part = scores.argmin(1)
        near = scores[np.arange(len(v)), part]
        inertia = float(near.sum())
        for p in range(k):
            own = v[part == p]
            centres[p] = own.mean(0) if len(own) else v[near.argmax()]
    return centres, inertia


def fit_on_sample(vectors: DataFrame, partitions: int, sample_size: int | None = None, rounds: int = 15, seed: int = 0) -> Fit:
    """Centres of a bounded sample (256 rows a centre unless stated), for tables of any size."""
    n, _ = checked(vectors)
    size = min(n, 256 * partitions) if sample_size is None else sample_size
    require(partitions >= 1, "partitions must be at least 1")
    require(partitions <= size <= n, f"sample {size} of {n} rows for {partitions} partitions")
    centres, inertia = local_lloyd(_sample(vectors, size, seed), partitions, rounds, seed)
    return Fit(centres, size, n, rounds, inertia)


def neighbours_in_the_same_partition(truth: DataFrame, assigned: DataFrame, probes: DataFrame) -> DataFrame:
    """One row: share of true neighbours (qid, id) whose part is the query's own (qid, part)."""
    part = assigned.filter("nth = 1").select("id", F.col("part").alias("theirs"))
    return truth.join(part, "id").join(probes.select("qid", "part"), "qid").agg(F.avg((F.col("theirs") == F.col("part")).cast("int")).alias("share"))


def guard_partitions(partitions: int, rows: int) -> None:
    if not 1 <= partitions <= rows:
        raise ConfigError(f"{partitions} partitions for {rows} rows")
