"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed three-byte sequences of lower-cased words.  A
document is a mixture of languages: expectation-maximisation estimates its proportions from
the likelihoods of its sequences.  Which languages take part is chosen by penalised
likelihood: the languages enter by their proportion under all of them, and the set stops
growing where another language gains less than the penalty.

The model is fitted on a bounded sample of labelled documents: about ``fit_docs`` of each
language, by hash of the id.  Sequence counts are summed within tasks before they shuffle.
What is broadcast is the table of log probabilities, languages x 2^15 numbers of four bytes
(131 MB at ``MOST_LANGUAGES``); more labels than that are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 15
MOST_LANGUAGES = 1000
#: Neighbouring sequences share bytes, so a likelihood counts for about a third.
OVERLAP = 3.0

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or any(map(str.isalpha, text)))


def sequences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the three-byte sequences of a text's words, a space on either side."""
    raw = b" ".join((b" " + text.encode("utf-8", "replace").translate(_LOWER) + b" ").split())
    x = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    counts = np.bincount(h >> np.uint32(17), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


class Mixture:
    """log p(sequence | language), priors, and the inference of a document's proportions."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.2):
        self.names = names
        self.log_p = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BINS)).T.astype(np.float32)
        self.log_prior = np.log((docs + 1.0) / (docs.sum() + len(docs)))

    def _em(self, p: np.ndarray, c: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        n = c.sum()
        for _ in range(steps):
            mass = p @ pi
            new = pi * ((c / mass) @ p) / n
            moved = np.abs(new - pi).max()
            pi = new
            if moved < 1e-3:
                break
        return pi, float(c @ np.log(p @ pi))

    def infer(self, text: str | None, penalty: float = 2.0, steps: int = 12) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its score, and the proportions of the chosen set."""
        if not self.names or not has_letter(text):
            return "und", 0.0, []
        at, c = sequences(text)
        log_p = self.log_p[at].astype(np.float64)
        alone = (c @ log_p) / OVERLAP + self.log_prior
        best = int(alone.argmax())
        odds = np.exp(alone - alone[best])
        if len(self.names) == 1 or len(c) == 0:
            return self.names[best], float(1 / odds.sum()), [(self.names[best], 1.0)]
        p = np.exp(log_p)
        pi, _ = self._em(p, c, np.full(len(self.names), 1 / len(self.names)), steps)
        order = [best] + [int(x) for x in np.argsort(-pi) if x != best]
        chosen, share, value = [best], np.ones(1), alone[best]
        for x in order[1:]:
            if pi[x] < 0.02:
                break
            trial = chosen + [x]
            start = np.append(share * (1 - max(pi[x], 0.05)), max(pi[x], 0.05))
            new, log = self._em(p[:, trial], c, start, steps)
            gain = log / OVERLAP + self.log_prior[best] - value
            if gain <= penalty + 0.5 * np.log(c.sum()):
                break
            chosen, share, value = trial, new, value + gain
        main = int(share.argmax())
        score = float(share[main]) if len(chosen) > 1 else float(1 / odds.sum())
        return self.names[chosen[main]], min(1.0, score), [(self.names[a], float(b)) for a, b in zip(chosen, share, strict=True)]


def fit(docs: DataFrame, learn: Column, fit_docs: int, id_col: str, text_col: str, lang_col: str) -> Mixture:
    """Mixture of the languages in the rows of docs where ``learn`` holds."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Mixture([], np.zeros((0, BINS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, fit_docs / sizes[k]))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, c = sequences(text.as_py())
                sums.setdefault(lang, np.zeros(BINS, dtype=np.int64))[at] += c.astype(np.int64)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bin", "n"])

    summed = sample.select("lang", "text").mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), BINS))
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("x")).toLocalIterator():
        counts[names.index(r["lang"]), [x["bin"] for x in r["x"]]] = [x["n"] for x in r["x"]]
    return Mixture(names, counts, np.array([sizes[k] for k in names], dtype=float))


def identify(
    docs: DataFrame,
    fit_docs: int = 2000,
    penalty: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: one row per row of docs.

    Learns from text and lang of rows whose crc32(id as text) mod 3 is not 1 (a null id is held
    out); a prediction reads the text only.  A null text, one without a letter, or no learned
    language give "und" with score 0.  languages holds the chosen set with its proportions.
    """
    number = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    held = F.coalesce(number == 1, F.lit(True))
    model = fit(docs, ~held, fit_docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.infer(t.as_py(), penalty) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"lang": k, "share": v} for k, v in f[2]] for f in found], kind),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    )
