"""License scan with a positional index of rare license words, all in DataFrame functions.

Of each template's mandatory phrase the two words that are rarest in the corpus
(highest inverse document frequency) are looked up in the phrase's postings
(word, template, position). A file that holds the phrase holds both. Words that
lie as far apart in the file as in a template agree on one offset; two or more
such words make a candidate, and the mandatory phrase must then stand at its
place from that offset on. Names of licenses are searched in every file besides.

Null and empty texts have no words, no labels and score 0. Every row is
scanned by itself, repeated ones too. Other columns are not read.
"""

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import settled

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Names whose words must stand consecutively, and their labels.
NAMES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public license notices: label, notice, mandatory phrase.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("mit", "Released under the MIT License", "mit license"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
     "gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
]


def split_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(rows: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(texts, texts that hold each vocabulary word), over all texts; the vocabulary bounds the result."""
    found = rows.select(F.explode(F.concat(F.array_intersect("_w", _strings(vocabulary)), F.array(F.lit("")))).alias("word"))
    counts = {r.word: r["count"] for r in found.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def name_places(w: str) -> Column:
    """(start, label) of every license name in the array of words."""
    def at(i, k):
        return F.when(i >= k, F.get(F.col(w), i - k))

    def place(x, i):
        found = F.lit(None).cast("struct<start:int,label:string>")
        for name, label in NAMES.items():
            *before, last = name.split()
            same = x == last
            for k, word in enumerate(reversed(before), 1):
                same = same & F.coalesce(at(i, k) == word, F.lit(False))
            found = F.when(same, F.struct((i - len(before)).alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    return F.array_compact(F.transform(F.col(w), place))


def phrase_start(notice: str, phrase: str) -> int:
    """Place of the mandatory phrase's first word in the notice."""
    words_, key = split_words(notice), phrase.split()
    return next(i for i in range(len(words_)) if words_[i:i + len(key)] == key)


def rare_words(idf: dict[str, float]) -> dict[int, list[str]]:
    """The two rarest words of every template's mandatory phrase; a phrase with a word that no text holds has none."""
    phrases = {t: set(phrase.split()) for t, (_, _, phrase) in enumerate(TEMPLATES)}
    return {t: sorted(key, key=lambda x: (-idf[x], x))[:2] for t, key in phrases.items() if key <= idf.keys()}


def alignments(w: str, rare: dict[int, list[str]]) -> tuple[Column, Column, Column, Column]:
    """The templates whose rare words are all present; their postings; these words' places (x, i); and (t, off, i) per posting they meet, sorted, each once."""
    postings = [(x, t, phrase_start(notice, phrase) + i) for t, (_, notice, phrase) in enumerate(TEMPLATES) for i, x in enumerate(phrase.split()) if x in rare.get(t, [])]
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(t).alias("t"), F.lit(i).alias("i")) for x, t, i in postings or [("", -1, 0)]])
    chosen = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.size(F.array_intersect("_present", _strings(key))) == len(key), F.lit(t)) for t, key in rare.items()]))
    sought = F.filter(table, lambda p: F.array_contains("_chosen", p["t"]))
    hits = F.array_compact(F.transform(F.col(w), lambda x, i: F.when(F.array_contains("_sought_words", x), F.struct(x.alias("x"), i.alias("i")))))
    each = F.flatten(F.transform("_hits", lambda h: F.transform(
        F.filter("_sought", lambda p: p["x"] == h["x"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("off"), p["i"].alias("i")))))
    return chosen, sought, hits, F.array_sort(each)


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    score: the largest share of a verified template's words found at its
    place; at least a half where a license is named.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = settled(docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(text).alias("_w")))
    vocabulary = sorted({x for _, _, phrase in TEMPLATES for x in phrase.split()})
    n, found = document_frequencies(rows, vocabulary)
    rare = rare_words({x: math.log(n / k) for x, k in found.items()})
    lookup = sorted({x for key in rare.values() for x in key}) or [""]
    none = F.array().cast("array<struct<t:int,off:int>>")
    rows = settled(rows.select("doc_id", "_w", F.array_intersect("_w", _strings(lookup)).alias("_present"), F.array_contains("_w", "license").alias("_named")))
    chosen, sought, hits, aligned = alignments("_w", rare)
    rows = settled(rows.withColumn("_chosen", chosen))
    some = F.size("_chosen") > 0
    rows = settled(rows.withColumn("_sought", F.when(some, sought)))
    rows = settled(rows.withColumn("_sought_words", F.array_distinct(F.transform("_sought", lambda p: p["x"]))))
    rows = settled(rows.withColumn("_hits", F.when(some, hits)))
    rows = settled(rows.withColumn("_each", F.when(some, aligned)))
    # Sorted by (template, offset): two neighbours with the same pair are two words that agree.
    later = F.slice("_each", 2, F.greatest(F.size("_each"), F.lit(1)))
    pairs = F.zip_with("_each", later, lambda a, b: F.when((a["t"] == b["t"]) & (a["off"] == b["off"]), F.struct(a["t"].alias("t"), a["off"].alias("off"))))
    rows = settled(rows.withColumn("_cand", F.when(some, F.array_distinct(F.array_compact(pairs))).otherwise(none)).drop("_present", "_chosen", "_sought", "_sought_words", "_hits", "_each"))
    no_place = F.array().cast("array<struct<start:int,label:string>>")
    rows = settled(rows.withColumn("_places", F.when(F.col("_named"), name_places("_w")).otherwise(no_place)))

    def verified(c):
        """(label, share of the template's words in place) of a candidate, or null."""
        out = F.lit(None).cast("struct<label:string,share:double>")
        for t, (label, notice, phrase) in enumerate(TEMPLATES):
            words_, key = split_words(notice), phrase.split()
            at = c["off"] + phrase_start(notice, phrase)
            good = (c["t"] == t) & (at >= 0) & F.coalesce(F.slice("_w", F.greatest(at, F.lit(0)) + 1, len(key)) == _strings(key), F.lit(False))
            lost = F.greatest(-c["off"], F.lit(0))  # words of the notice before the file's first
            same = F.zip_with(F.slice("_w", c["off"] + lost + 1, F.lit(len(words_)) - lost), F.slice(_strings(words_), lost + 1, F.lit(len(words_)) - lost),
                              lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
            share = F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(len(words_)))
            out = F.when(good, F.struct(F.lit(label).alias("label"), share.alias("share"))).otherwise(out)
        return out

    found_ = F.array_compact(F.transform("_cand", verified))
    rows = settled(rows.withColumn("_found", F.when(F.size("_cand") > 0, found_).otherwise(F.array().cast("array<struct<label:string,share:double>>"))))
    base = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(base, F.transform("_found", lambda x: x["label"])))
    starts = F.transform("_places", lambda p: p["start"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("_places") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
