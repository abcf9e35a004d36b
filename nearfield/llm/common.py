"""What the operators of this subpackage share: words, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of UTF-8 that are part of a word once A-Z are lower: digits, a-z and all of 0x80-0xFF.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; a null has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of P and of its inverse modulo 2^64, as far as pieces of text needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(max(n, 2 * len(self.up), 1 << 16), dtype=np.uint64)
            ones[1:] = P
            self.up = np.multiply.accumulate(ones)
            ones[1:] = _P_INV
            self.down = np.multiply.accumulate(ones)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hashed_words(text: str | None, step: int = 1 << 20) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A whole text's word bytes, the starts and ends of its words in them, and the words' hashes.

    A hash depends on the bytes of its word alone, so the text goes through in pieces of
    ``step`` bytes, cut between words.
    """
    raw = text.encode("utf-8", "replace").translate(WORD_BYTES) if text else b""
    firsts, lasts, words, at = [], [], [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= step else raw.rfind(b" ", at, at + step)
        if end <= at:
            end = raw.find(b" ", at + step)
        end = len(raw) if end < 0 else end
        piece = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate(([False], piece != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = _POWERS.to(len(piece) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(piece * up[: len(piece)], dtype=np.uint64)))
        words.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        firsts.append(first + at)
        lasts.append(last + at)
        at = end
    if not words:
        return raw, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return raw, np.concatenate(firsts), np.concatenate(lasts), np.concatenate(words)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; there must be k words."""
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * P + words[j : len(words) - k + 1 + j]
    return mix(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, is a folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its machines share")
        current = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows in the shared folder; no executor's loss loses them.

    Spark's cleaner removes the files when the last plan that reads them is gone.
    """
    shared_dir(df.sparkSession)
    # Spark 4.1 joins partitions of a union end to end, but takes them for dealt like its parts
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path by Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
