"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are lower-cased (A-Z) runs of digits, letters and everything beyond ASCII.  A window is
``n`` consecutive words of a benchmark item; an item with fewer words is one window itself.
Each task hashes its documents' words and their windows, looks these up in the broadcast
sorted hashes, and verifies each hit by the words themselves.

What is broadcast is bounded: items are taken in blocks of at most ``block_words`` words
(read from the driver one block at a time), flat arrays of some 30 bytes a word; more blocks
mean more scans, never a larger broadcast.  An item longer than a block is dealt to several,
which overlap by a window.  Documents are not shuffled with one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hashed_words, windows, words_of

#: Words of benchmark items in one broadcast block: about 60 MB of arrays.
BLOCK_WORDS = 2_000_000


class WindowIndex:
    """Windows of some items: their words, and for each window length sorted hashes with places and items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.items = [name for name, _ in items]
        self.words = b" ".join(w for _, words in items for w in words)
        _, first, last, hashes = hashed_words(self.words.decode())
        self.first, self.last = first.astype(np.uint32), last.astype(np.uint32)
        made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        at = 0
        for i, (_, words) in enumerate(items):
            k = min(n, len(words))
            h = windows(hashes[at : at + len(words)], k)
            made.setdefault(k, []).append((h, np.arange(at, at + len(h), dtype=np.uint32), np.full(len(h), i, dtype=np.uint32)))
            at += len(words)
        self.tables = {}
        for k, parts in made.items():
            h, place, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            self.tables[k] = h[order], place[order], item[order]

    def words_at(self, place: int, k: int) -> list[bytes]:
        return self.words[self.first[place] : self.last[place + k - 1]].split()

    def _may_hold(self, k: int) -> np.ndarray:
        """A table of flags by the upper bits of a hash, made once in a task: most windows end here."""
        flags = self.__dict__.setdefault("_flags", {})
        if k not in flags:
            h = self.tables[k][0]
            flags[k] = np.zeros(1 << max(10, (8 * len(h)).bit_length()), dtype=bool)
            flags[k][h >> np.uint64(65 - len(flags[k]).bit_length())] = True
        return flags[k]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_flags"}

    def scan(self, text: str | None) -> tuple[int, list[int], list[int], set[int], bytes, np.ndarray, np.ndarray]:
        """Words, starts and ends (exclusive) of windows that occur, their items; and where words are."""
        raw, first, last, hashes = hashed_words(text)
        starts, ends, items = [], [], set()
        for k, (table, places, owners) in self.tables.items():
            if len(hashes) < k:
                continue
            h = windows(hashes, k)
            flags = self._may_hold(k)
            at = np.flatnonzero(flags[h >> np.uint64(65 - len(flags).bit_length())])
            low, high = np.searchsorted(table, h[at], "left"), np.searchsorted(table, h[at], "right")
            for i, a, z in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                own = raw[first[i] : last[i + k - 1]].split()
                true = [j for j in range(a, z) if self.words_at(places[j], k) == own]
                if true:
                    starts.append(i)
                    ends.append(i + k)
                    items.update(owners[true].tolist())
        return len(hashes), starts, ends, items, raw, first, last


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, n: int, block_words: int = BLOCK_WORDS, id_col="item_id", text_col="text"):
    """Window indexes of the benchmark, a block of items at a time."""
    own: list[tuple[str, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = words_of(text)
        step = max(1, max(block_words, n) - n + 1)  # pieces overlap, so no window is cut
        for at in range(0, max(1, len(words) - n + 1) if words else 0, step):
            piece = words[at : at + step + n - 1]
            if own and size + len(piece) > block_words:
                yield WindowIndex(own, n)
                own, size = [], 0
            own.append(("null" if name is None else name, piece))
            size += len(piece)
    if own:
        yield WindowIndex(own, n)


def _scan_text(index: WindowIndex, text: str | None):
    n, starts, ends, items, *_ = index.scan(text)
    return n, _merged(starts, ends), sorted({index.items[x] for x in items})


SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_SCAN_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged word ranges of hits), items.

    Null and empty texts have no words and no hits.  Repeated rows and repeated ids give a row
    each; items of the same id count once.  Items without a word are left out; a null item id
    is listed as "null".  An empty benchmark hits nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    indexes = blocks(benchmark, n, block_words)
    first, second = next(indexes, WindowIndex([], n)), next(indexes, None)
    if second is not None:  # a number for each row, the same in every scan
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    def scanned(index: WindowIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                for part in _parts(b):
                    found = [_scan_text(own, t) for t in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(1),
                            pa.array([f[0] for f in found], pa.int64()),
                            pa.array([[{"start": a, "end": z} for a, z in f[1]] for f in found], _SCAN_ARROW.field(3).type),
                            pa.array([f[2] for f in found], _SCAN_ARROW.field(4).type),
                        ],
                        schema=_SCAN_ARROW,
                    )

        return rows.mapInArrow(run, SCAN)

    out = scanned(first)
    if second is not None:
        for more in chain((second,), indexes):
            out = out.unionByName(scanned(more))
        out = out.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return out


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def hit_report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of scan()'s rows."""
    joined = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    return scanned.select(
        "doc_id",
        "n_words",
        joined.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS, text_col: str = "text"
) -> DataFrame:
    """Rows of docs in which no window occurs, columns as they were; a scan without a shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    out = docs
    for index in blocks(benchmark, n, block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                for part in _parts(b):
                    clean = [not _scan_text(own, t)[1] for t in part.column(at).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS, text_col: str = "text"
) -> DataFrame:
    """docs with the hit words cut out of the texts, block after block; all rows stay."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    out = docs
    for index in blocks(benchmark, n, block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                for part in _parts(b):
                    texts = [_without(own, t) for t in part.column(at).to_pylist()]
                    yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

        out = out.mapInArrow(run, docs.schema)
    return out


def _without(index: WindowIndex, text: str | None) -> str | None:
    _, starts, ends, _, _, first, last = index.scan(text)
    if not starts:
        return text
    raw, out, pos = text.encode("utf-8", "replace"), [], 0
    for a, z in _merged(starts, ends):
        out.append(raw[pos : first[a]])
        pos = last[z - 1]
    return b"".join([*out, raw[pos:]]).decode("utf-8")
