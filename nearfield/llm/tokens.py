"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic
programming keeps the best score and its number of pieces at each end, nothing else.  Tie
rules are the tokenizer's: a later candidate must be strictly better, and candidates of one
end come from the earliest start, so the longest last piece wins a tie.  A character that is
no piece itself may stand alone as unknown, at the lowest score less 10, and then counts as
its UTF-8 bytes (byte fallback).

Spaces become the mark U+2581 and one is put before the text.  No piece has the mark after
another character, and none has a line feed, so the best path passes every such boundary and
counts add up over segments; segments that come back are looked up in a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments remembered in a task, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Normal and user pieces with their scores from a sentencepiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, float(p.score)) for p in model.pieces if p.type in (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED)]


class _Memory(dict):
    def __init__(self, count, prefix: str):
        super().__init__()
        self.count, self.prefix = count, prefix

    def __missing__(self, word: str) -> int:
        n = self.count(self.prefix + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Piece counts of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        lowest = 0.0
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
            lowest = min(lowest, score)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.splits = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.feed = not any("\n" in p for p, _ in pieces)
        self.marked, self.bare = _Memory(self.viterbi, MARK), _Memory(self.viterbi, "")

    def viterbi(self, s: str) -> int:
        """Pieces of the best path through s, whose spaces are marks already."""
        n = len(s)
        best, count, done = [0.0] + [None] * n, [0] * (n + 1), 0
        single, unknown = self.single, self.unknown

        def close(upto: int) -> None:  # ends before upto have all their matches
            nonlocal done
            while done < upto:
                done += 1
                c = s[done - 1]
                if c not in single:
                    score = best[done - 1] + unknown
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        count[done] = count[done - 1] + len(c.encode("utf-8", "replace"))

        for last, (length, score) in self.automaton.iter(s):
            end = last + 1
            if done < last:
                close(last)
            start = end - length
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end] = score
                count[end] = count[start] + 1
        close(n)
        return count[n]

    def tokens(self, text: str | None) -> int:
        """Pieces of a whole text; none for a null or an empty one."""
        if not text:
            return 0
        if not self.splits:
            return self.viterbi(MARK + text.replace(" ", MARK))
        if MARK in text or "  " in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            segments = _SEGMENT.findall(marked)
            if not self.feed:
                return sum(map(self.bare.__getitem__, segments))
            parts = [p for s in segments for p in s.split("\n")]
            return sum(map(self.bare.__getitem__, parts)) + text.count("\n")
        if not self.feed:
            return sum(map(self.marked.__getitem__, text.split(" ")))
        total, first = text.count("\n"), True
        for line in text.split("\n"):
            words = line.split(" ")
            total += (self.marked if first else self.bare)[words[0]]
            del words[0]
            total += sum(map(self.marked.__getitem__, words))
            first = False
        return total


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_chars, n_bytes: one row per row of docs, repeated rows and null ids too.

    A null or empty text has 0 of each.  The vocabulary (a model file's, so bounded) is read
    on the driver and broadcast.  An empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            counts = [counter.tokens(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), b.column(2), b.column(3)], names=["doc_id", "n_tokens", "n_chars", "n_bytes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        F.char_length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_chars long, n_bytes long")
