"""Removal of long repeated byte strings by suffix arrays of grouped suffixes.

A byte goes if a string of ``length`` bytes that covers it starts at another place too, in the
same document or in any other.  One suffix array of all texts would have to be sorted in one
piece, so the places where equal strings can meet are found first:

Each string of ``length`` bytes has an anchor, the ``core`` bytes in it of the least hash (the
first of equal ones).  Equal strings have equal anchors at equal distances, so all starts that
share an anchor are one *piece*: some 135 bytes of starts at most, and the bytes they reach.
Pieces meet by the hash of their anchor; anchors that stand once in the corpus are left out, and
equal pieces are one with a count: what they hold is repeated.  Pieces that differ but share an
anchor are sorted: the task takes them apart by the bytes that ``step`` neighbouring starts have
in common, and where several remain, it builds the suffix array of these together.  Neighbours
in it that agree in ``length`` bytes are repeats, byte for byte.

The suffix array is built in linear time by grouping (``suffix_array``): suffixes are put into
groups by first byte; groups are taken in descending order, and each moves the previous smaller
suffixes of its members up into groups of their own, by how many members lead to them, until all
suffixes of a group share their Lyndon prefix.  One pass in ascending order then gives each
group's own order.  Nothing is renamed and no smaller problem is solved again.

An anchor with more than ``most`` different pieces (a passage that very many documents share
ends in as many ways) is not sorted in one task: its pieces are dealt by what each ``step``
starts have in common, equal parts are made one before they are shuffled, and different parts
of one common string are sorted.  Where even these are more than ``most``, whole strings are
counted, a row each.  These steps go by digests of 128 bits.

Hashes of anchors and pieces have 64 bits.  Two different pieces would be taken for equal only
if they share an anchor's hash and their own; no other step relies on hashes of less than 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, _POWERS, drop_path, fresh, mix, scratch

#: Starts of a text that are hashed at once.
_SEGMENT = 1 << 20
#: A number for each byte value, so that sums of small bytes spread over all 64 bits.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * P)


def suffix_array(text) -> list[int]:
    """Starts of the suffixes of a sequence of numbers in ascending order, by grouping."""
    n = len(text)
    letters = sorted(set(text))
    place = {c: g for g, c in enumerate(letters)}
    group = [place[c] for c in text]  # of each suffix
    members: list[list[int]] = [[] for _ in letters]  # of each group, ascending; those that left are skipped
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(letters)), -1]
    below = list(range(-1, len(letters) - 1))
    smaller = [-1] * n  # the last suffix before i that is smaller
    done = bytearray(n)
    g = len(letters) - 1
    while g >= 0:
        members[g] = own = [i for i in members[g] if group[i] == g]
        runs: list[tuple[int, int]] = []  # (members of g that lead to p, p)
        last = -1
        times = 0
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            done[i] = 1
            if p == last:
                times += 1
            else:
                if last >= 0:
                    runs.append((times, last))
                last, times = p, 1
        if last >= 0:
            runs.append((times, last))
        if len(runs) > 1:
            runs.sort(key=lambda r: -r[0])
        now, split = 0, {}
        for times, p in runs:  # most first, so fewer end up between them and the rest
            if times != now:
                now, split = times, {}
            h = group[p]
            f = split.get(h)
            if f is None:
                f = split[h] = len(members)
                up = above[h]
                members.append([p])
                above.append(up)
                below.append(h)
                above[h] = f
                if up >= 0:
                    below[up] = f
            else:
                members[f].append(p)
            group[p] = f
        g = below[g]
    free = [0] * len(members)
    g = at = 0
    while g >= 0 and n:
        free[g] = at
        at += len(members[g])
        g = above[g]
    order = [0] * n
    placed = bytearray(n)
    i, k = n, 0
    while True:
        p = i - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = smaller[p]
        if k == n:
            return order
        i = order[k]
        k += 1


def repeated_starts(pieces: list[bytes], length: int) -> list[list[int]]:
    """For each of some different pieces the starts whose ``length`` bytes start elsewhere in them too."""
    text: list[int] = []
    first, room = [], []
    for p in pieces:
        first.append(len(text))
        room.append(np.maximum(len(p) - length + 1 - np.arange(len(p) + 1), 0))
        text += p
        text.append(-1)
    joined = b"\0".join(pieces) + b"\0"
    order = np.array(suffix_array(text), dtype=np.int64)
    order = order[np.concatenate(room)[order] > 0]  # suffixes that reach no start are not compared
    hit = set()
    last, held = -1, b""
    for i in order.tolist():
        own = joined[i : i + length]
        if own == held:
            hit.add(last)
            hit.add(i)
        last, held = i, own
    found: list[list[int]] = [[] for _ in pieces]
    at = np.array(first)
    for i in sorted(hit):
        j = int(np.searchsorted(at, i, "right")) - 1
        found[j].append(i - first[j])
    return found


class Anchors:
    """Anchors of texts: the least of all hashes of ``core`` bytes in each string of ``length``."""

    def __init__(self, length: int, core: int):
        if not 8 <= core < length <= 4000:
            raise ValueError("core must be at least 8 and below length, and length at most 4000")
        self.length, self.core = length, core

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the anchor, its hash, first start, last start, hash of the piece), ascending, each start in one."""
        parts = []
        for at in range(0, max(1, len(raw) - self.length + 1), _SEGMENT):
            parts.append(self._segment(raw, at))
        place, key, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.concatenate(([True], place[1:] != place[:-1]))
        place, key, lo = place[new], key[new], lo[new]
        hi = np.append(lo[1:], len(raw) - self.length + 1) - 1
        return place, key, lo, hi, self._pieces(raw, lo, hi)

    def _sums(self, raw: bytes, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(raw, dtype=np.uint8, count=z - a, offset=a)
        up, down = _POWERS.to(len(own) + 1)
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[own] * up[: len(own)], dtype=np.uint64))), down

    def _segment(self, raw: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = min(_SEGMENT, len(raw) - self.length + 1 - at)
        sums, down = self._sums(raw, at, at + starts + self.length - 1)
        many = self.length - self.core + 1
        hashes = mix((sums[self.core :] - sums[: -self.core]) * down[: len(sums) - self.core])
        ranked = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        rows = -(-len(ranked) // many)
        table = np.full(rows * many, np.iinfo(np.uint64).max, dtype=np.uint64)
        table[: len(ranked)] = ranked
        table = table.reshape(rows, many)
        before = np.minimum.accumulate(table, axis=1).reshape(-1)
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(after[:starts], before[many - 1 : many - 1 + starts]) & np.uint64((1 << 24) - 1)
        least = least.astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        return least[lo] + at, hashes[least[lo]], lo + at

    def _pieces(self, raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), dtype=np.uint64)
        a = 0
        while a < len(lo):
            z = max(a + 1, int(np.searchsorted(lo, lo[a] + _SEGMENT)))
            sums, down = self._sums(raw, int(lo[a]), int(hi[z - 1]) + self.length)
            i, j = lo[a:z] - lo[a], hi[a:z] + self.length - lo[a]
            out[a:z] = mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))
            a = z
        return out


def anchored(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """key, piece, row, at, digest for rows (row, digest, body); ``at`` packs first start, anchor and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in range(0, b.num_rows, 500):
                part = b.slice(cut, 500)
                found, counts = [], []
                for raw in part.column(2):
                    raw = raw.as_py()
                    if len(raw) < anchors.length:
                        counts.append(0)
                        continue
                    place, key, lo, hi, piece = anchors.of(raw)
                    found.append((key.view(np.int64), piece.view(np.int64), (lo << 24) | ((place - lo) << 12) | (hi - lo)))
                    counts.append(len(key))
                key, piece, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
                which = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(piece), part.column(0).take(which), pa.array(at), part.column(1).take(which)], names=["key", "piece", "row", "at", "digest"]
                )

    return rows.mapInArrow(run, "key long, piece long, row long, at long, digest binary")


_LO, _BACK, _SPAN = "shiftright(at, 24)", "shiftright(at, 12) & 4095", "at & 4095"


def cut_out(reps: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """key, piece, twice, back, body: the bytes of pieces, one example of each."""
    wanted = reps.groupBy("digest").agg(F.collect_list(F.struct("key", "piece", "twice", "at")).alias("pieces"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, own = b.column(1)[i].as_py(), b.column(0)[i].values
                key, piece, twice, at = (own.field(j) for j in range(4))
                at = at.to_numpy(zero_copy_only=False)
                lo, span = at >> 24, at & 4095
                bodies = [raw[a : a + n + length] for a, n in zip(lo.tolist(), span.tolist(), strict=True)]
                for j in range(0, len(at), 20_000):
                    own_part = slice(j, j + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [key[own_part], piece[own_part], twice[own_part], pa.array((at[own_part] >> 12) & 4095), pa.array(bodies[own_part], pa.binary())],
                        names=["key", "piece", "twice", "back", "body"],
                    )

    both = wanted.join(texts, "digest").select("pieces", "body")
    return both.mapInArrow(run, "key long, piece long, twice boolean, back long, body binary")


def ranges_of(starts: list[int]) -> list[int]:
    """First and last of each run of neighbouring starts, one after the other."""
    out: list[int] = []
    for s in starts:
        if out and s == out[-1] + 1:
            out[-1] = s
        else:
            out += [s, s]
    return out


def sort_group(backs: list[int], bodies: list[bytes], twice: list[bool], length: int, step: int) -> list[list[int]]:
    """Repeated starts of different pieces that share an anchor, ``backs`` bytes after their first start.

    Starts are taken in steps by distance to the anchor.  Those of a step have bytes in common;
    pieces that differ there share no string, and pieces that agree in all the step's bytes
    repeat each other.  What is left is sorted.
    """
    hit: list[set[int]] = [set() for _ in bodies]
    least, most = 1 << 30, -1
    for back, body in zip(backs, bodies, strict=True):
        least, most = min(least, back - (len(body) - length)), max(most, back)
    for a in range(least // step * step, most + 1, step):  # starts a to a + step - 1 before the anchor
        shared: dict[bytes, dict[bytes, list[int]]] = {}
        for i, back in enumerate(backs):
            body = bodies[i]
            lo, hi = max(0, back - a - step + 1), min(len(body) - length, back - a)
            if lo <= hi:
                common = body[max(0, back - a) : back - a - step + 1 + length] if back >= a else b""
                shared.setdefault(common, {}).setdefault((lo + a - back, body[lo : hi + length]), []).append(i)
        for same in shared.values():
            own = list(same)
            for piece in own:
                if len(same[piece]) > 1 or twice[same[piece][0]]:
                    for i in same[piece]:
                        lo = piece[0] - a + backs[i]
                        hit[i].update(range(lo, lo + len(piece[1]) - length + 1))
            if len(own) > 1:
                for piece, starts in zip(own, repeated_starts([p[1] for p in own], length), strict=True):
                    for i in same[piece]:
                        lo = piece[0] - a + backs[i]
                        hit[i].update(lo + s for s in starts)
    return [sorted(x) for x in hit]


def sorted_pieces(pieces: DataFrame, length: int, step: int, kind: str = "long") -> DataFrame:
    """key, piece, ranges of pieces that stand once; groups of one key are of bounded size.

    ``kind`` is the type of key and piece.
    """
    made = f"key {kind}, piece {kind}, ranges array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = pa.int64() if kind == "long" else pa.binary()
        schema = pa.schema([("key", name), ("piece", name), ("ranges", pa.list_(pa.int32()))])
        group: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            if group:
                starts = sort_group([g[3] for g in group], [g[4] for g in group], [g[2] for g in group], length, step)
                done.extend((g[0], g[1], ranges_of(s)) for g, s in zip(group, starts, strict=True) if s and not g[2])
                group.clear()

        def out() -> pa.RecordBatch:
            rows = [pa.array([d[i] for d in done], schema.field(i).type) for i in range(3)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                group.append(row)
            if len(done) > 5000:
                yield out()
        close()
        yield out()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, made)


def stepped(pieces: DataFrame, length: int, step: int) -> DataFrame:
    """common, same, key, piece, twice, lo, back, body: the parts of pieces by distance to the anchor, ``step`` starts each.

    ``common`` digests the bytes that all starts of a part share, ``same`` the part itself; a
    string that stands in two parts stands in parts of one ``common``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda a, x: hashlib.blake2b(x, digest_size=16, salt=a.to_bytes(8, "little")).digest()
        names = ["common", "same", "key", "piece", "twice", "lo", "back", "body"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            rows = []
            for key, piece, twice, back, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last = len(body) - length
                for a in range((back - last) // step * step, back + 1, step):
                    lo, hi = max(0, back - a - step + 1), min(last, back - a)
                    own = body[lo : hi + length]
                    common = digest(a, body[back - a : back - a - step + 1 + length])
                    rows.append((common, digest(back - lo, own), key, piece, twice, lo, back - lo, own))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], names=names)

    return pieces.mapInArrow(run, "common binary, same binary, key long, piece long, twice boolean, lo int, back long, body binary")


def counted_strings(pieces: DataFrame, length: int) -> DataFrame:
    """key, piece, ranges, as sorted_pieces; every whole string of every piece is a row, so no key is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, piece, twice, _, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(body) - length + 1
                digests = [hashlib.blake2b(body[s : s + length], digest_size=16).digest() for s in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([key] * n, pa.binary()), pa.array([piece] * n, pa.binary()), pa.array([twice] * n, pa.bool_()), pa.array(range(n), pa.int32())],
                    names=["string", "key", "piece", "twice", "start"],
                )

    strings = pieces.mapInArrow(run, "string binary, key binary, piece binary, twice boolean, start int")
    repeated = strings.groupBy("string").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).filter("n > 1").select("string")
    found = strings.filter("not twice").join(repeated, "string").groupBy("key", "piece").agg(F.collect_list("start").alias("starts"))  # of one piece
    return found.select("key", "piece", F.flatten(F.transform("starts", lambda s: F.array(s, s))).alias("ranges"))


def split_pieces(pieces: DataFrame, parts: DataFrame, length: int, step: int, most: int) -> DataFrame:
    """key, piece, ranges of pieces of keys that are too many for one task.

    ``parts`` is stepped(pieces), one row for each (common, same), with whether it stands twice.
    Equal parts repeat each other; different ones of one ``common`` are sorted where they are few
    enough, else their strings are counted.
    """
    sizes = parts.groupBy("common").agg(F.count("*").alias("different"), F.count_if(~F.col("twice")).alias("single")).filter("different > 1 and single > 0")
    open_ = parts.join(sizes, "common").select(F.col("common").alias("key"), F.col("same").alias("piece"), "twice", "back", "body", "different")
    few, many = (open_.filter(c).drop("different") for c in (F.col("different") <= most, F.col("different") > most))
    whole = parts.filter("twice").select(F.col("common").alias("key"), F.col("same").alias("piece"), F.array(F.lit(0), F.octet_length("body") - length).alias("ranges"))
    marks = sorted_pieces(few, length, step, "binary").unionByName(counted_strings(many, length)).unionByName(whole)
    every = stepped(pieces, length, step).filter("not twice").select("common", "same", "key", "piece", "lo")
    marks = marks.select(F.col("key").alias("common"), F.col("piece").alias("same"), "ranges")
    found = every.join(marks, ["common", "same"]).groupBy("key", "piece").agg(F.collect_list(F.transform("ranges", lambda r: r + F.col("lo"))).alias("r"))  # of one piece
    return found.select("key", "piece", F.flatten("r").alias("ranges"))


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def repeated_spans(docs: DataFrame, length: int = 200, core: int = 64, step: int = 14, most: int = 500, text_col: str = "text") -> DataFrame:
    """digest, starts: for the SHA-256 of each text with repeats, its repeated starts as [first, last, first, last, ...] in any order."""
    spark, anchors = docs.sparkSession, Anchors(length, core)
    body = F.col(text_col).cast("string").cast("binary").alias("body")
    long_ones = docs.filter(F.octet_length(F.col(text_col).cast("string")) >= length)
    paths = [scratch(spark, f"repeats-{x}") for x in ("anchors", "hits", "pieces", "marks", "starts", "crowded", "parts")]

    def kept(df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = long_ones.select(F.monotonically_increasing_id().alias("row"), digest_of(text_col).alias("digest"), body)
    every = kept(anchored(rows, anchors), paths[0])
    repeated = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    hits = kept(every.select("key", "piece", "row", "at").join(repeated, "key"), paths[1])
    names = every.groupBy("row").agg(F.first("digest").alias("digest"))
    by_piece = hits.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("example"))
    pieces = kept(by_piece.select("key", "piece", (F.col("n") > 1).alias("twice"), "example.row", "example.at"), paths[2])
    sizes = pieces.groupBy("key").agg(F.count("*").alias("different"), F.count_if(~F.col("twice")).alias("single")).filter("different > 1 and single > 0")
    texts = long_ones.select(digest_of(text_col).alias("digest"), body).groupBy("digest").agg(F.first("body").alias("body"))
    reps = pieces.join(sizes, "key").join(names, "row")
    small = sorted_pieces(cut_out(reps.filter(F.col("different") <= most), texts, length), length, step)
    marks = small
    if not sizes.filter(F.col("different") > most).isEmpty():
        hot = kept(cut_out(reps.filter(F.col("different") > most), texts, length), paths[5])
        parts = stepped(hot, length, step).groupBy("common", "same").agg((F.sum(F.when(F.col("twice"), 2).otherwise(1)) > 1).alias("twice"), F.first(F.struct("back", "body")).alias("one"))
        parts = kept(parts.select("common", "same", "twice", "one.back", "one.body"), paths[6])
        marks = small.unionByName(split_pieces(hot, parts, length, step, most))
    marks = kept(marks, paths[3])
    lo = F.expr(_LO)
    whole = hits.join(pieces.filter("twice").select("key", "piece"), ["key", "piece"]).select("row", F.array(lo, lo + F.expr(_SPAN)).alias("starts"))
    part = hits.join(marks, ["key", "piece"]).select("row", F.transform("ranges", lambda r: r + F.expr(_LO)).alias("starts"))
    of_row = whole.unionByName(part).groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # of one text
    # equal texts have equal repeats
    found = kept(of_row.join(names, "row").groupBy("digest").agg(F.first("starts").alias("starts")), paths[4])
    for path in paths[:4] + paths[5:]:
        drop_path(spark, path)
    return found


def spans_of(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed runs (start, end) of ranges of repeated starts."""
    pairs = np.unique(starts.reshape(-1, 2), axis=0)
    a, z = pairs[:, 0], np.maximum.accumulate(pairs[:, 1]) + length
    new = np.concatenate(([True], a[1:] > z[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return np.stack((a[new], z[last]), axis=1)


def _with_starts(docs: DataFrame, name: str, length: int, text_col: str, how: dict) -> DataFrame:
    """docs with a column of repeated starts (null: none), rows and other columns as they were."""
    digest = fresh(docs, "digest")
    found = repeated_spans(docs, length, text_col=text_col, **how).select(F.col("digest").alias(digest), F.col("starts").alias(name))
    return docs.withColumn(digest, digest_of(text_col)).join(found, digest, "left").drop(digest)


def report(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row for each row of docs.

    Texts are their UTF-8 bytes; a null is empty, keeps no byte and has no span.  Texts shorter
    than ``length`` have no string.  Repeated rows repeat each other wholly; rows that share an
    id, and rows without one, are documents of their own.  An empty table gives no rows.  Other
    columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    rows = _with_starts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "starts", length, "text", how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for raw, starts in zip(b.column(1), b.column(2), strict=True):
                raw, spans = raw.as_py(), []
                kept = hashlib.sha256()
                at = 0
                if starts.is_valid:
                    spans = spans_of(starts.values.to_numpy(zero_copy_only=False), length).tolist()
                    for a, z in spans:
                        kept.update(raw[at:a])
                        at = z
                kept.update(raw[at:])
                made.append((len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[i] for m in made], schema.field(i + 1).type) for i in range(5)]], schema=schema)

    made = rows.select("doc_id", F.col("text").cast("binary").alias("body"), "starts")
    return made.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", **how) -> DataFrame:
    """docs with repeated bytes cut out of the texts; a character that is cut in two becomes U+FFFD."""
    name = fresh(docs, "starts")
    rows = _with_starts(docs, name, length, text_col, how)

    @F.pandas_udf("string")
    def kept(texts, starts):
        out = []
        for text, own in zip(texts, starts, strict=True):
            if own is not None and text is not None:
                raw = text.encode()
                spans = spans_of(np.asarray(own, dtype=np.int64), length)
                edges = np.concatenate(([0], spans.reshape(-1), [len(raw)])).reshape(-1, 2)
                text = b"".join(raw[a:z] for a, z in edges.tolist()).decode("utf-8", "replace")
            out.append(text)
        return texts.__class__(out)

    return rows.withColumn(text_col, kept(F.col(text_col).cast("string"), name)).drop(name)
