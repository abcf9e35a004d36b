"""Licence scan with a positional index of rare licence words [native].

Templates are short licence notices; the index posts each of their words, stop words left out,
with template and position.  One scan of the texts finds each file's words and the places of
index words in them; document frequencies of index words over all files give their IDF.  Each
template keeps the postings of its own ``rare`` words of highest IDF, and all places of them in
a file are looked up, so one notice cannot crowd out another; postings of one template meet
where file position minus template position agree, and the IDF found at such an offset against
the template's own gives coverage.  A template holds if coverage is at least ``least``
and its mandatory key phrase stands word for word at its place from that offset.

Only DataFrame functions run.  What is broadcast or collected is bounded by the templates:
their postings, and one count for each index word.  Files keep their words only if they hold
index words at all; nothing is gathered beyond a file.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes that part words, once A-Z are lower.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence notices as (label, notice, key phrase).
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
]
STOP = frozenset("a an and any are as by can except for form forms in into is it may met modify not of or or provided source subject that the this to under use with without you your 0 1 2 3 4 v work code file files".split())


Templates = list[tuple[str, str, str]]


def _index(templates: Templates, stop: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Postings (word, template, position) and the index words."""
    posted = [(w, t, i) for t, (_, notice, _) in enumerate(templates) for i, w in enumerate(notice.split()) if w not in stop]
    return posted, sorted({w for w, _, _ in posted})


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), PARTS), "")


def starts_of(phrase: str) -> Column:
    """Starts, from 0, of a phrase in the column ``w`` of words; empty at once without its rarest word."""
    want = phrase.split()
    found = F.filter(
        F.sequence(F.lit(0), F.size("w") - len(want)),
        lambda i: F.expr("true") if not want else _all(i, want),
    )
    return F.when((F.size("w") >= len(want)) & F.array_contains("w", want[0]) & F.array_contains("w", want[-1]), found).otherwise(F.array().cast("array<int>"))


def _all(i: Column, want: list[str]) -> Column:
    out = F.get("w", i) == want[0]
    for j, x in enumerate(want[1:], 1):
        out = out & (F.get("w", i + j) == x)
    return out


def scan(
    docs: DataFrame, rare: int = 8, least: float = 0.6, templates: Templates = TEMPLATES, stop: frozenset[str] = STOP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    One row per row of docs, repeated rows and null ids too.  A null or empty text has no
    words: counts 0, first_word and last_word null, labels empty, score 0.  Ties of IDF go by
    word, ties of offsets to the smaller.  score is the best coverage of a template that
    holds, 1 where a base phrase stands.  found lists (label, start, coverage) of templates;
    extra columns are not read.  ``templates`` are (label, notice, key phrase) in lower-case
    words, the key phrase a part of its notice; whole licence texts may be given as well.
    """
    posted, vocabulary = _index(templates, stop)
    spark = docs.sparkSession
    spots = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: s["w"].isin(vocabulary))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    wide = text.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        *[starts_of(p).alias(f"at{k}") for k, p in enumerate(BASE)],
        F.when(F.arrays_overlap("w", F.array(*map(F.lit, vocabulary))), spots).alias("spots"),
        "w",
    )
    kept = cut(
        wide.select("doc_id", "n_words", *[f"at{k}" for k in range(len(BASE))], "spots", F.when(F.size("spots") > 0, F.col("w")).alias("w")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    total = kept.count()
    df = {
        r["x"]: r["n"]
        for r in kept.select(F.explode(F.array_distinct("spots.w")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()
    }
    idf = {x: round(math.log((total + 1) / (df.get(x, 0) + 1)) + 1, 9) for x in vocabulary}
    own = {(w, t) for t in range(len(templates)) for w in rarest(t, posted, idf, rare)}
    postings = F.broadcast(
        spark.createDataFrame([(w, t, i, idf[w]) for w, t, i in posted if (w, t) in own], "word string, template int, tpos int, idf double")
    )
    looked = kept.filter(F.size("spots") > 0).select("row", F.explode(F.filter("spots", lambda s: s["w"].isin(sorted({w for w, _ in own})))).alias("s"))
    met = looked.join(postings, F.col("s.w") == F.col("word")).select("row", "template", (F.col("s.i") - F.col("tpos")).alias("offset"), "idf")
    at = met.groupBy("row", "template", "offset").agg(F.sum("idf").alias("mass"))
    whole = F.create_map(*[F.lit(v) for t in range(len(templates)) for v in (t, self_mass(t, posted, idf, rare))])
    hold = at.withColumn("coverage", F.least(F.lit(1.0), F.col("mass") / whole[F.col("template")])).filter(F.col("coverage") >= least)
    phrase = F.array(*[F.array(*map(F.lit, key.split())) for _, _, key in templates])
    place = F.array(*[F.lit(_place(notice, key)) for _, notice, key in templates])
    label = F.array(*[F.lit(x) for x, _, _ in templates])
    want, first = F.get(phrase, F.col("template")), F.col("offset") + F.get(place, F.col("template"))
    true = (
        hold.join(kept.filter(F.size("spots") > 0).select("row", "w"), "row")
        .filter((first >= 0) & (F.slice("w", F.greatest(first, F.lit(0)) + 1, F.size(want)) == want))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(F.get(label, F.col("template")).alias("label"), first.alias("start"), F.round("coverage", 6).alias("coverage")))).alias("found"))
    )
    out = kept.drop("w", "spots").join(true, "row", "left")
    places = [F.col(f"at{k}") for k in range(len(BASE))]
    every = F.concat(*places)
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(x)) for p, x in zip(places, BASE.values(), strict=True)]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("found.label", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.coverage"), F.lit(0.0))).alias("score"),
        "found",
    )


def rarest(template: int, posted: list[tuple[str, int, int]], idf: dict[str, float], rare: int) -> list[str]:
    """A template's own ``rare`` words of highest IDF."""
    return sorted({w for w, t, _ in posted if t == template}, key=lambda w: (-idf[w], w))[:rare]


def self_mass(template: int, posted: list[tuple[str, int, int]], idf: dict[str, float], rare: int) -> float:
    """IDF of a template's own ``rare`` best words, all their places: what a full match finds."""
    top = rarest(template, posted, idf, rare)
    return sum(idf[w] for w, t, _ in posted if t == template and w in top)


def _place(notice: str, key: str) -> int:
    n, k = notice.split(), key.split()
    return next(i for i in range(len(n)) if n[i : i + len(k)] == k)
