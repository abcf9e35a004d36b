"""Phrase collocation mining: frequent word n-grams by Misra-Gries summaries, then exact counts.

``frequent`` finds a set that holds every n-gram of at least ``threshold`` occurrences.  Each
task counts the hashes of its n-grams and deals the counts to hash partitions.  Counts of a part
of the table are a summary of it without error; a partition's summaries are merged to one of
more counters than its mass (all occurrences in it) divided by the threshold.  Where more
n-grams are left than that, the count of the first one beyond is taken off all of them, and
those at 0 go.  That takes off less than the threshold in all, so whoever stood ``threshold``
times survives.  Only the survivors' bits of a Bloom filter of bounded size come back.

It runs three times: for single words, for pairs of surviving words, and for runs of three to
``longest`` words of surviving pairs, since a phrase is no more frequent than its parts.  A scan
of all texts then counts what passes the filters exactly, by the words themselves; what is below
the threshold goes.

Words of a piece of text are hashed as arrays; texts go through in chunks cut between words,
which overlap by what a phrase needs, so a very long text takes no more memory than others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, _POWERS, drop_path, mix, scratch

#: Bytes that end a piece of text become 10, spaces and tabs 32, A-Z lower.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b in b" \t" else b for b in range(256))
#: Bytes of text that are hashed at once, n-grams that are counted at once in a task, occurrences in a hash partition.
CHUNK, BUFFER, PARTITION = 1 << 21, 4_000_000, 8_000_000
#: Bits of a filter at most (32 MB).
MOST_BITS = 1 << 28
_BREAK = re.compile(rb"[\n ]")


def chunks(raw: bytes, longest: int, step: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Parts of a translated text and how many of their bytes are their own: words that start there are theirs.

    A part goes on by ``longest`` words of the next one, or to the end of the piece of text.
    """
    at = 0
    while at < len(raw):
        if len(raw) - at <= step:
            yield raw[at:], len(raw) - at
            return
        end = max(raw.rfind(b"\n", at, at + step), raw.rfind(b" ", at, at + step)) + 1
        if end <= at:
            found = _BREAK.search(raw, at + step)
            end = found.end() if found else len(raw)
        more = 256
        while True:
            tail = raw[end : end + more]
            stop = tail.find(b"\n")
            if stop >= 0:
                tail = tail[:stop]
                break
            if end + more >= len(raw) or sum(map(bool, tail.split(b" "))) > longest + 1:  # the last may be cut
                break
            more *= 2
        yield raw[at:end] + tail, end - at
        at = end


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a translated part, and the number of each one's piece."""
    b = np.frombuffer(raw, dtype=np.uint8)
    breaks = b == 10
    inside = np.concatenate(([False], ~(breaks | (b == 32)), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS.to(len(b) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)))
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return first, last, hashes, np.cumsum(breaks, dtype=np.int64)[first]


class Filter:
    """A Bloom filter in segments, one for each hash partition; no survivor is missing."""

    def __init__(self, parts: int, segment: int, bits: np.ndarray):
        self.parts, self.segment, self.bits = parts, segment, bits

    @staticmethod
    def places(hashes: np.ndarray, parts: int, segment: int, k: int) -> np.ndarray:
        """The k-th bits (of three) of hashes: within the segment of their partition, which their upper bits name."""
        base = (hashes >> np.uint64(64 - parts.bit_length() + 1)) * np.uint64(segment) if parts > 1 else np.uint64(0)
        rest = hashes & np.uint64((1 << 40) - 1)
        return base + ((mix(rest + np.uint64(k << 40)) if k else rest) & np.uint64(segment - 1))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may have survived."""
        left = np.arange(len(hashes))
        for k in range(3):
            if not len(left):
                break
            at = self.places(hashes[left], self.parts, self.segment, k)
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), dtype=bool)
        out[left] = True
        return out


def grams(hashes: np.ndarray, piece: np.ndarray, own: int, lang: np.uint64, lengths: range, single=None, pairs=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams of each length that lie in one piece and start among the first ``own`` words.

    With the filters of words and of pairs only those that hold nothing else are made.
    """
    g, at = mix(hashes + lang), np.arange(len(hashes))
    ok = paired = None
    for n in range(1, lengths.stop):
        if n > 1:
            keep = at + n <= len(hashes)
            at, g = at[keep], g[keep]
            end = at + n - 1
            keep = piece[at] == piece[end]
            if ok is not None:
                keep &= ok[end]
            if paired is not None:
                keep &= paired[end - 1]
            at, g = at[keep], mix(g[keep] * P + hashes[end[keep]])
        if n == 1 and single is not None:
            ok = single.holds(g)
            at, g = at[ok], g[ok]
        if n == 2 and pairs is not None:
            held = pairs.holds(g)
            at, g = at[held], g[held]
            paired = np.zeros(len(hashes), dtype=bool)
            paired[at] = True
        if n in lengths:
            mine = np.searchsorted(at, own)
            yield n, at[:mine], g[:mine]


def lang_seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.md5(lang.encode()).digest()[:8], dtype=np.uint64)[0]


def parts_of(rows: pa.RecordBatch, longest: int) -> Iterator[tuple[str, bytes, int]]:
    """(lang, part, bytes of its own) of rows (lang, body); short texts of a language go together."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, body in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        raw = body.as_py().translate(_BYTES)
        if len(raw) > CHUNK:
            yield from ((lang, *c) for c in chunks(raw, longest))
            continue
        held.setdefault(lang, []).append(raw)
        size[lang] = size.get(lang, 0) + len(raw)
        if size[lang] > CHUNK:
            whole = b"\n".join(held.pop(lang))
            size.pop(lang)
            yield lang, whole, len(whole)
    for lang, own in held.items():
        whole = b"\n".join(own)
        yield lang, whole, len(whole)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("body"))


def summaries(rows: DataFrame, lengths: range, parts: int, filters: tuple) -> DataFrame:
    """part, hashes, counts: a task's counts of its n-grams, dealt to hash partitions by their upper bits.

    Below the partition's bits 40 bits of a hash are kept, five bytes; n-grams that agree in
    them count as one, which keeps too many rather than too few.
    """
    top = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = (found >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(found), dtype=np.int64)
            own, edges = np.unique(part, return_index=True)
            edges = np.append(edges, len(found))
            bytes_ = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(own.astype(np.int32)),
                    pa.array([np.ascontiguousarray(bytes_[a:z].T).tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    pa.array([np.ascontiguousarray(counts[a:z].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                ],
                names=["part", "hashes", "counts"],
            )

        for b in batches:
            for lang, raw, bytes_own in parts_of(b, lengths.stop):
                first, _, hashes, piece = words(raw)
                for _, _, g in grams(hashes, piece, int(np.searchsorted(first, bytes_own)), lang_seed(lang), lengths, *(f.value for f in filters)):
                    held.append(_shortened(g, top))
                    size += len(g)
                if size > BUFFER:
                    yield dealt()
                    size = 0
        if size:
            yield dealt()

    return rows.mapInArrow(run, "part int, hashes binary, counts binary")


def _shortened(g: np.ndarray, top: int) -> np.ndarray:
    """Hashes without the bits between those of the partition and the last 40."""
    low = np.uint64((1 << 40) - 1)
    high = np.uint64(((1 << top) - 1) << (64 - top)) if top else np.uint64(0)
    return g & (low | high)


class Summary:
    """A Misra-Gries summary of one hash partition, made of summaries of parts of the table."""

    def __init__(self, threshold: int, room: int = BUFFER):
        self.threshold, self.room = threshold, room
        self.hashes, self.counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.mass = self.taken = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((hashes, counts))
        self.size += len(hashes)
        self.mass += int(counts.sum())
        if self.size > self.room:
            self.merge()

    def merge(self) -> None:
        """One counter a hash; beyond mass / threshold + 1 of them the smallest go, and as much of the others."""
        every, at = np.unique(np.concatenate([self.hashes, *(h for h, _ in self.held)]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, *(c for _, c in self.held)]), minlength=len(every)).astype(np.int64)
        self.held, self.size = [], 0
        most = self.mass // self.threshold + 1
        if len(every) > most:
            off = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
            off = min(off, self.threshold - 1 - self.taken)  # never more in all than a frequent one can lose
            self.taken += off
            counts -= off
            every, counts = every[counts > 0], counts[counts > 0]
        self.hashes, self.counts = every, counts

    def survivors(self) -> np.ndarray:
        """Hashes that may stand ``threshold`` times."""
        self.merge()
        return self.hashes[self.counts + self.taken >= self.threshold]


def frequent(rows: DataFrame, lengths: range, threshold: int, *filters) -> Filter:
    """A filter that holds all n-grams of these lengths with at least ``threshold`` occurrences."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    mass = max(1, size // 6 * max(1, len(lengths)))  # as texts of usual words have; more only makes partitions larger
    parts = 1 << max(0, (mass // PARTITION).bit_length())
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * mass // threshold).bit_length()))
    segment = max(64, bits // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Summary(threshold)

        def close() -> pa.RecordBatch:
            found = own.survivors()
            bits = np.zeros(segment, dtype=np.uint8)
            for k in range(3):
                bits[(Filter.places(found, parts, segment, k) & np.uint64(segment - 1)).astype(np.int64)] = 1
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for b in batches:
            for part, hashes, counts in zip(*b.columns, strict=True):
                if part.as_py() != at:
                    if at is not None:
                        yield close()
                    at, own = part.as_py(), Summary(threshold)
                low = np.frombuffer(hashes.as_py(), dtype=np.uint8).reshape(5, -1)
                whole = np.zeros((low.shape[1], 8), dtype=np.uint8)
                whole[:, :5] = low.T
                high = np.uint64(at) << np.uint64(64 - parts.bit_length() + 1) if parts > 1 else np.uint64(0)
                times = np.ascontiguousarray(np.frombuffer(counts.as_py(), dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
                own.add(whole.view("<u8").reshape(-1) | high, times.astype(np.int64))
        if at is not None:
            yield close()

    dealt = summaries(rows, lengths, parts, filters).repartition(min(parts, 1 << 14), "part").sortWithinPartitions("part")
    out = np.zeros(max(1, parts * segment // 8), dtype=np.uint8)
    for part, bits in dealt.mapInArrow(run, "part int, bits binary").collect():  # bounded by MOST_BITS
        out[part * segment // 8 : (part + 1) * segment // 8] = np.frombuffer(bits, dtype=np.uint8)
    return Filter(parts, segment, out)


def counted(rows: DataFrame, single, pairs, longer, longest: int, threshold: int) -> DataFrame:
    """lang, phrase, n, a: exact counts of frequent n-grams, and all words of a language with a null phrase and n = 0.

    Tasks deal their counts to the filter's hash partitions, a row of lists for each partition
    and language; a partition adds them up by the words themselves.
    """
    parts = longer.value.parts
    top = parts.bit_length() - 1
    lists = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}  # by language, hashes and counts
        names: dict[str, dict[int, tuple[int, str]]] = {}
        totals: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made: list[tuple] = [(0, lang, [None], [0], [n]) for lang, n in totals.items()]
            for lang, own in held.items():
                known, at = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([c for _, c in own])).astype(np.int64)
                part = (known >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(known), dtype=np.int64)
                edges = np.searchsorted(part, np.arange(parts + 1))
                named = [names[lang][h] for h in known.tolist()]
                for i in np.unique(part).tolist():
                    mine = named[edges[i] : edges[i + 1]]
                    made.append((i, lang, [p for _, p in mine], [n for n, _ in mine], times[edges[i] : edges[i + 1]].tolist()))
            for x in (held, names, totals):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], lists.field(j).type) for j in range(5)], schema=lists)

        for b in batches:
            for lang, raw, bytes_own in parts_of(b, longest + 1):
                first, last, hashes, piece = words(raw)
                own, seed = int(np.searchsorted(first, bytes_own)), lang_seed(lang)
                totals[lang] = totals.get(lang, 0) + own
                known = names.setdefault(lang, {})
                for n, at, g in grams(hashes, piece, own, seed, range(1, longest + 1), single.value, pairs.value):
                    if n > 2:
                        passed = longer.value.holds(g)
                        at, g = at[passed], g[passed]
                    found, example, times = np.unique(g, return_index=True, return_counts=True)
                    held.setdefault(lang, []).append((found, times))
                    for h, i in zip(found.tolist(), at[example].tolist(), strict=True):
                        if h not in known:
                            known[h] = n, b" ".join(filter(None, raw[first[i] : last[i + n - 1]].split(b" "))).decode("utf-8", "replace")
            if sum(map(len, names.values())) > 1_000_000 or sum(len(h) for own in held.values() for h, _ in own) > 2 * BUFFER:
                yield out()
        if totals:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, {}

        def close() -> pa.RecordBatch:
            left = [(lang, phrase, n, a) for (lang, phrase, n), a in sums.items() if a >= threshold or not n]
            sums.clear()
            kinds = pa.string(), pa.string(), pa.int32(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in left], kinds[j]) for j in range(4)], names=["lang", "phrase", "n", "a"])

        for b in batches:
            for part, lang, phrases, sizes, counts in zip(*b.columns, strict=True):
                if part.as_py() != at:
                    yield close()
                    at = part.as_py()
                lang = lang.as_py()
                for phrase, n, a in zip(phrases.as_py(), sizes.as_py(), counts.as_py(), strict=True):
                    key = lang, phrase, n
                    sums[key] = sums.get(key, 0) + a
        yield close()

    dealt = rows.mapInArrow(run, "part int, lang string, phrases array<string>, sizes array<int>, counts array<long>")
    return dealt.repartition(min(parts, 1 << 14), "part").sortWithinPartitions("part").mapInArrow(added, "lang string, phrase string, n int, a long")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, first: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, a and phrase.

    A phrase of 2 to ``longest`` words stands at least ``threshold`` times (a); cut after its
    first words its parts stand l and r times, n words stand in the language, and score is
    floor(1000 * a * n / (l * r)) of the cut where that is lowest, at ties the first.  Phrases
    that a longer one of at least ``share`` percent of their count holds are left out.  Null texts
    are empty, a null language is ``und``.  Repeated rows count as often as they stand; languages
    without such phrases have no rows, nor has an empty table.  Other columns are not read.
    """
    spark, rows = docs.sparkSession, _rows(docs, text_col, lang_col)
    filters: list = []  # of words, pairs, longer runs
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        filters.append(spark.sparkContext.broadcast(frequent(rows, lengths, threshold, *filters)))
    path = scratch(spark, "phrases")
    made = counted(rows, *filters, longest, threshold)
    made.write.parquet(path)
    every = spark.read.schema(made.schema).parquet(path)
    total = every.filter("n = 0").select("lang", F.col("a").alias("n"))
    counts = every.filter("n > 0").select("lang", "phrase", F.col("n").alias("size"), "a")
    phrases = counts.filter("size > 1")
    word = F.split("phrase", " ")
    inside = lambda of, a, z: F.array_join(F.slice(of, a, z), " ")
    cuts = phrases.select("lang", "phrase", "a", word.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", inside("words", F.lit(1), F.col("k")).alias("left"), inside("words", F.col("k") + 1, F.size("words")).alias("right"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    total = F.broadcast(total) if total.count() <= 100_000 else total
    parted = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = parted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # a phrase that stands as often as some longer one stands as often as one that is a word longer
    outer = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(inside(word, F.lit(1), F.col("size") - 1), inside(word, F.lit(2), F.col("size") - 1))).alias("phrase"))
    outer = outer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(outer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    best = left.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= first)
    out = scratch(spark, "collocations")
    best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score").write.parquet(out)
    drop_path(spark, path)
    return spark.read.parquet(out)
