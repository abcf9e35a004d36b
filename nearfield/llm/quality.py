"""Quality classifier: document evidence with hierarchical empirical Bayes over sites.

1. A logistic classifier on marks of the text (letter case, symbols, repetition, word lengths)
   is fitted on a bounded sample of labelled documents.  It gives each document a probability
   p and, against the sample's prior, a log likelihood ratio: its evidence.
2. Grouped sums of p give each host a posterior mean, shrunk to the global mean, and each path
   a posterior mean, shrunk to its host's.  The strength of either prior is estimated from the
   spread between sites beyond sampling noise (method of moments), so a sparse site says
   little and a large one speaks for itself.  All documents take part.
3. A document's posterior is its evidence with the path's mean as prior odds, its own p taken
   out of the sums (a document is no witness for itself).

All grouped sums are partial before they shuffle; only narrow rows are joined.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

FEATURES = [
    "upper", "symbol", "digit", "space", "marks_a_word", "word_length", "log_words", "distinct", "run", "packed", "lines",
]
#: Labelled documents that the classifier is fitted on: about so many, by hash of the id.
FIT_ROWS = 20_000
#: Prior odds of a site never go beyond this in log units: evidence can always overturn it.
MOST_LOGIT = 4.0

_UPPER, _LETTER, _DIGIT, _SPACE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = _UPPER, _LETTER, _LETTER, _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE


def features(text: str | None) -> list[float]:
    """The marks of one whole text, as named in FEATURES; a text of white space alone is all 0."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=5)
    n, ink = len(raw), len(raw) - int(counts[_SPACE])
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in re.split(rb"\n+", raw) if x]
    return [
        counts[_UPPER] / ink,
        counts[_OTHER] / ink,
        counts[_DIGIT] / ink,
        counts[_SPACE] / n,
        counts[_OTHER] / len(words),
        min(ink / len(words), 40.0),
        np.log1p(len(words)),
        np.log(len(set(words)) + 1) / np.log(len(words) + 1),
        same / len(words),
        _packed(raw),
        len(set(lines)) / max(1, len(lines)),
    ]


def _packed(raw: bytes, block: int = 1 << 16) -> float:
    """Mean share that the blocks of a text pack to, each by its own length; one rule for all lengths."""
    blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
    return sum(len(zlib.compress(b, 1)) * np.log(len(b) + 16) for b in blocks) / len(raw) / np.log(4096)


class Logistic:
    """Ridge logistic regression on standardised marks and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        good = (y.sum() + 1.0) / (len(y) + 2.0)
        self.prior = float(np.log(good / (1 - good)))
        z = self._design(x)
        w = np.zeros(z.shape[1])
        w[0] = self.prior
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (y - p) - penalty * w
            bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def measured(docs: DataFrame, host: Column, path: Column, id_col: str, text_col: str) -> DataFrame:
    """doc_id, host, path, x (the marks) of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(3)], dtype=np.float64).reshape(-1)
            ends = pa.array(range(0, len(x) + 1, len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.ListArray.from_arrays(ends, pa.array(x))], names=["doc_id", "host", "path", "x"]
            )

    return rows.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength kappa (in documents) of group means around ``mean``, by moments.

    groups has n and s (sum of p).  Between-group variance beyond m(1-m)/n noise gives
    kappa = m(1-m)/tau^2 - 1; no extra spread gives a strong prior.
    """
    r = groups.filter("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("binomial"),
    ).first()
    if not r["n"] or not r["binomial"]:
        return 100.0
    tau2 = max(r["between"] - r["noise"], 0.0) / r["n"]
    return float(np.clip(r["binomial"] / r["n"] / max(tau2, 1e-9) - 1, 1.0, 10_000.0))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, score, kept: one row per row of docs.

    host defaults to ``source``, path to ``source/lang``; a null host or path is the empty one.
    Labels are (doc_id, quality 0/1); null labels and ids are left out, repeated ones averaged.
    Without labels evidence is 0 and every document is kept.  A null, empty or blank text has
    marks of 0 throughout, and is rejected: it has nothing to keep.  An empty table gives no
    rows.  score is the probability of good quality; kept means score >= 0.5.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    made = cut(measured(docs, host, path, id_col, text_col))
    truth = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("q"))
    truth = truth.dropna().groupBy("id").agg(F.avg("q").alias("q"))
    labelled = cut(made.filter(F.element_at("x", 7) > 0).join(truth, F.col("doc_id") == F.col("id")).select("doc_id", "x", "q"))
    share = min(1.0, fit_rows / max(1, labelled.count()))
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)  # the driver gets no more
    sample = sorted(labelled.filter(drawn).collect())
    model = Logistic(np.array([r.x for r in sample]).reshape(-1, len(FEATURES)), np.array([float(r.q >= 0.5) for r in sample]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(x[:, 6] > 0), pa.array(shared.value.logit(x))],
                names=["doc_id", "host", "path", "inked", "logit"],
            )

    judged = cut(made.mapInArrow(run, "doc_id long, host string, path string, inked boolean, logit double"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = cut(judged.withColumn("p", p).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = F.lit(0.5 if whole is None else min(max(whole, 1e-3), 1 - 1e-3))
    k_host = F.lit(_strength(hosts, mean))
    shrunk = (k_host * mean + F.col("host_s")) / (k_host + F.col("host_n"))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = cut(paths.join(hosts, F.col("host") == F.col("h")).drop("h").withColumn("host_mean", shrunk))
    k_path = F.lit(_strength(sites, F.col("host_mean")))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("t"), "host_n", "host_s", "n", "s")
    of = judged.join(sites, (F.col("host") == F.col("h")) & (F.col("path") == F.col("t")))
    # a document is no witness for itself, neither at its path nor at its host
    left = lambda s: F.greatest(F.col(s) - p, F.lit(0.0))
    of = of.withColumn("host_mean", (k_host * mean + left("host_s")) / (k_host + F.col("host_n") - 1))
    others = (k_path * F.col("host_mean") + left("s")) / (k_path + F.col("n") - 1)
    odds = F.greatest(F.lit(-MOST_LOGIT), F.least(F.lit(MOST_LOGIT), F.log(F.col("path_mean") / (1 - F.col("path_mean")))))
    evidence = F.when(F.lit(bool(sample)), F.col("logit") - F.lit(model.prior)).otherwise(F.lit(0.0))
    out = of.withColumn("path_mean", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))).withColumn("evidence", evidence)
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    out = out.withColumn("score", F.when(F.col("inked"), score).otherwise(F.lit(0.0)))
    kept = F.col("inked") & ((F.col("score") >= 0.5) | F.lit(not sample))
    return out.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "score", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Rows of docs that are not rejected, columns as they were.

    Rows that share an id share the decision: they go only if all of them are rejected.
    """
    bad = quality(docs, labels, id_col=id_col, **how).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(~F.col("kept"))
    own = fresh(docs, "bad")
    return docs.join(bad.select(F.col("doc_id").alias(own)), F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
