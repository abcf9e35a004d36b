"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import collocations, lexical, order_minhash, suffix_dedup
from nearfield.llm.common import words_of


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_sorted_order(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repetitive_sequences():
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    for text in (b"", b"a" * 500, b"ab" * 300, b"ba" * 300, fib[-1], bytes(range(256)) * 3):
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def repeats(texts, length):
    raws, seen = [(t or "").encode() for t in texts], collections.Counter()
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def shuffled_texts(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(30, 120))) for _ in range(6)]
    texts = ["".join(rnd.choice(base)[a : a + rnd.randint(5, 60)] for a in [rnd.randint(0, 40) for _ in range(rnd.randint(1, 6))]) for _ in range(60)]
    return [*texts, None, "", "a" * 500, "ab" * 300, texts[0], texts[1]]


@pytest.mark.parametrize("most", [500, 3, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_repeated_bytes_equal_brute_force(spark, seed, most):
    texts = shuffled_texts(seed)
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, digest string, starts binary").repartition(3)
    got = suffix_dedup.report(docs, 40, core=12, step=5, most=most)
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert rows == [(i, *b) for i, b in enumerate(repeats(texts, 40))]


def test_repeats_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.report(spark.createDataFrame([], schema)).collect() == []
    rows = suffix_dedup.report(spark.createDataFrame([(None, "x" * 250), (None, "y" * 199), (3, None)], schema)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (199, 0, 0), (250, 250, 1)]
    same = suffix_dedup.report(spark.createDataFrame([(1, "z1" + "q" * 50 + "".join(map(str, range(90))))] * 3, schema)).collect()
    assert len(same) == 3 and all(r.n_removed == r.n_bytes for r in same)


def test_a_text_longer_than_a_segment(spark, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh") for _ in range(6000))
    texts = [text, "q" + text[1000:1300] + "r", text[4000:4100]]
    whole = repeats(texts, 60)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    one, many = suffix_dedup.Anchors(60, 20), []
    place, key, lo, hi, piece = one.of(text.encode())
    assert lo[0] == 0 and hi[-1] == len(text) - 60 and (lo[1:] == hi[:-1] + 1).all() and len(set(place.tolist())) == len(place)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(one.of(text.encode()), (place, key, lo, hi, piece), strict=True))
    got = suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60, core=20)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == [(i, *b) for i, b in enumerate(whole)]
    assert many == []


def test_texts_without_repeats_keep_other_columns(spark):
    passage = "".join(map(str, range(1000, 1100)))
    docs = spark.createDataFrame([(1, "ä" + passage + "!", 7), (2, passage, 8), (3, "alone", 9), (4, None, 1)], "doc_id long, text string, starts int")
    got = {r.doc_id: (r.text, r.starts) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {1: ("ä!", 7), 2: ("", 8), 3: ("alone", 9), 4: (None, 1)}


def ranked(docs, items, k):
    terms = [(i, collections.Counter(words_of(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in terms:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words_of(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [20_000, 40])
def test_search_equals_brute_force(spark, block_terms):
    rnd = random.Random(3)
    word = [f"w{i}" for i in range(60)]
    docs = [(rnd.choice([None, i, i]), " ".join(rnd.choices(word, weights=[1 / (j + 1) for j in range(60)], k=rnd.randint(0, 40)))) for i in range(700)]
    docs += [(9000, None), (9001, ""), (9002, "W1 w1, W2"), (9002, "w1 W1 w2"), (8000, "w1 w1 w2"), (9003, "w5 " * 30_000)]
    items = [(j, " ".join(rnd.choices(word, k=rnd.randint(1, 12)))) for j in range(20)] + [(20, None), (None, "w1 w2 w59"), (3, "w1 w1 é"), (21, "nowhere")]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(frame, asked, k=4, leaf=3, fan=4, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == ranked(docs, items, 4)


def test_search_prunes_and_takes_empty_tables(spark):
    rnd = random.Random(4)
    topics = [[f"t{t}w{j}" for j in range(30)] for t in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(topics[i % 20], k=20))) for i in range(4000)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, " ".join(rnd.choices(topics[i], k=15))) for i in range(20)], "item_id long, text string")
    work = lexical.search(docs, items, work=True).first()
    assert work.scored < 0.2 * work.n_docs * work.n_items
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def phrases(rows, threshold, longest, first, share):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        held = {p[i:j] for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * c[p[i:j]]}
        best = []
        for p, a in frequent.items():
            if p not in held:
                score, _, left, right = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:first], 1)]
    return sorted(out)


def mined(frame, **how):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(frame, **how).collect())


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    rnd = random.Random(6)
    word = [f"W{i}" for i in range(25)] + ["ÄB", "(x)"]
    texts = ["".join(rnd.choice(word) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(rnd.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", None), ("en", ""), ("en", "good morning dear all. " * 40), ("en", "w1 w2 w3 " * 2000), ("fr", "x" * 5000), (None, "a b " * 30)]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    if small:  # in this process: chunks and merges of summaries
        monkeypatch.setattr(collocations, "CHUNK", 300)
        made = list(collocations.chunks(b"aa b  ccc dd\ne f g h i j k l m n o " * 40, 5, 50))
        assert b"".join(c[:n] for c, n in made) == b"aa b  ccc dd\ne f g h i j k l m n o " * 40 and all(len(c) < 90 for c, _ in made)
    assert mined(frame, threshold=20, first=50) == phrases(rows, 20, 5, 50, 100)
    assert mined(frame, threshold=12, first=7, share=60, longest=3) == phrases(rows, 12, 3, 7, 60)


def test_summary_keeps_every_frequent_hash():
    rng = np.random.default_rng(2)
    stream = np.concatenate((rng.integers(0, 1 << 40, 60_000), np.repeat(rng.integers(0, 1 << 40, 40), rng.integers(95, 130, 40)))).astype(np.uint64)
    rng.shuffle(stream)
    own = collocations.Summary(100, room=5000)
    for part in np.array_split(stream, 50):
        own.add(*np.unique(part, return_counts=True))
    kept = own.survivors()
    values, counts = np.unique(stream, return_counts=True)
    assert set(values[counts >= 100].tolist()) <= set(kept.tolist())
    assert own.taken < 100 and len(own.hashes) <= len(stream) // 100 + 1


def test_a_chunked_text_counts_as_a_whole_one():
    rnd = random.Random(8)
    raw = "".join(rnd.choice(["one", "two", "three", "x"]) + rnd.choice([" ", " ", "  ", "\n"]) for _ in range(3000)).encode()
    whole, parts = collections.Counter(), collections.Counter()
    for step, into in ((1 << 20, whole), (64, parts)):
        for part, own in collocations.chunks(raw, 6, step):
            first, _, hashes, piece = collocations.words(part)
            for _, _, g in collocations.grams(hashes, piece, int(np.searchsorted(first, own)), np.uint64(5), range(1, 6)):
                into.update(g.tolist())
    assert whole == parts


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_two_that_share_a_bucket_beside_more_central_ones_are_joined(spark):
    """Near copies whose common buckets hold no one else, each beside a crowd that shares a passage with it."""
    r = random.Random(21)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    both, left, right = some(720), [some(20) for _ in range(4)], [some(20) for _ in range(4)]
    texts = [sum(left, both), sum(right, both)]
    for passage in left + right:
        texts += [passage + some(2) for _ in range(14)]
    texts = [" ".join(t) for t in texts]
    grams = [order_minhash.shingles(t)[1] for t in texts]
    assert order_minhash.ordered_similarity(grams[0], grams[1], 0.8)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    how = {"sketches": 256, "picked": 1}
    made = order_minhash.sketched(frame, 5, order_minhash.OrderSketch(**how), "doc_id", "text").withColumnRenamed("doc_id", "rep")
    met = order_minhash.buckets(made.select("rep", "sketch"))
    assert met.filter("n > 2 and rep < 2").groupBy("band", "key").count().filter("count > 1").isEmpty()
    assert order_minhash.star(met, 3).filter("a = 0 and b = 1").isEmpty()  # it is the blocks that find them
    for parts in (2, 16):
        out = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(frame.repartition(parts), **how).collect()}
        assert out[0] == out[1] == 0


@pytest.mark.parametrize("rate", [0.002, 0.005, 0.02])
def test_recall_on_planted_near_copies(spark, rate):
    r = random.Random(int(rate * 1000))
    texts = [[f"w{r.randrange(3000)}" for _ in range(r.randint(60, 600))] for _ in range(150)]
    copies = [[f"e{r.randrange(10**6)}" if r.random() < rate else w for w in t] for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    out = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(docs).collect()}
    near = [order_minhash.ordered_similarity(*(order_minhash.shingles(" ".join(t))[1] for t in pair), 0.8) > 0 for pair in zip(texts, copies, strict=True)]
    assert [out[i] == out[150 + i] for i in range(150)] == near
    print(f"rate {rate}: {sum(near)} of 150 copies are at 0.8 or more")
