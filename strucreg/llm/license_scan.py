"""Licence notices by a positional index of rare words.

The index holds, for each word of the notices' texts that is not an everyday word, the notices and places where it stands. A
document's licence words are found with their places in one pass over its words. Each is weighed by its rarity among the
documents (IDF). For each notice that a document shares words with, the document's highest-IDF words of that notice are looked
up in the index; a posting and a place in the document give the place where the notice would begin. Postings are intersected by
that beginning: enough of the words looked up must stand in their places. At such a beginning every key phrase that the notice
demands must stand in its place too, word by word.

Base phrases (``PHRASES``) are found wherever their words stand consecutively, and always count.

Only built-in functions. The notices are a small fixed table: the index has a few hundred rows and may be broadcast.

Defined cases: null text is empty and has no words; a null id, ties and repeated rows are documents like others; an empty table
gives no rows; texts are read whole and a notice is found anywhere in them, every time it stands there; a document with many
licence words has many places looked up, none is left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strucreg.llm.common import Tables, text_or_empty

# A word is what stands between characters of ASCII that are neither letters nor digits.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever they stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    """A notice's words, and those of them that must be there word by word."""

    label: str
    text: str
    keys: tuple[str, ...]


# Notices of public licences, in lower case and without punctuation.
NOTICES = (
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "licensed under the terms of the mit license", ("mit license",)),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Notice("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("licensed under the apache license",)),
    Notice("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("agreed to in writing software",)),
    Notice("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Notice("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Notice("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    Notice("bsd", "licensed under the bsd license", ("bsd license",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Notice("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("express or implied warranty",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Notice("cc0", "licensed under the creative commons zero v1 0 universal public domain dedication", ("creative commons zero",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Notice("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
)

# Words too common to be looked up.
EVERYDAY = "a an and any are as at be by for from if in into is it no not of on or that the this to will with you under may use v v1 0 1 2 3 4".split()

# The Kelvin sign: the one character outside ASCII whose lower case is in ASCII.
KELVIN = "\u212a"

# Words looked up per document and notice, and the share of them that must stand in place.
TOP, IN_PLACE = 6, 0.6


def _postings(notices: Sequence[Notice]) -> list[tuple[int, str, int]]:
    """(notice, word, place) of the words that are looked up."""
    return [(i, w, at) for i, n in enumerate(notices) for at, w in enumerate(n.text.split()) if w not in EVERYDAY]


def _phrases(notices: Sequence[Notice], base: Mapping[str, str]) -> list[tuple[str, ...]]:
    """All phrases that are verified word by word."""
    found = [tuple(p.split()) for p in base]
    for n in notices:
        found += [tuple(k.split()) for k in n.keys if tuple(k.split()) not in found]
    return found


def _place_in(notice: Notice, key: str) -> int:
    all_, part = notice.text.split(), key.split()
    return next(i for i in range(len(all_)) if all_[i : i + len(part)] == part)


def _head(phrase: Sequence[str]) -> int:
    """The word of a phrase that leads to it: its first word that is looked up."""
    return next(i for i, w in enumerate(phrase) if w not in EVERYDAY)


def licence_words(docs: DataFrame, text_col: str, id_col: str, notices: Sequence[Notice] = NOTICES, base: Mapping[str, str] = PHRASES) -> DataFrame:
    """``_row, _id, n_words, hits``: the licence words of each document in order, ``hits`` being an array of (at, word, phrases), the
    numbers of the phrases (in the order of ``_phrases``) whose leading word it is."""
    phrases = _phrases(notices, base)
    vocabulary = sorted({w for _, w, _ in _postings(notices)} | {p[_head(p)] for p in phrases})
    # a Kelvin sign stays a character of a word, but is no k
    lowered = F.lower(F.replace(text_or_empty(text_col), F.lit(KELVIN), F.lit("\u00e9")))
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(F.array(F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)))).alias("_words"))
    known = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))

    def standing(x: Column) -> Column:
        found = []
        for number, phrase in enumerate(phrases):
            head = _head(phrase)
            there = F.slice("_words", F.greatest(x["at"] - head + 1, F.lit(1)), len(phrase)) == F.array(*[F.lit(w) for w in phrase])
            found.append(F.when((x["word"] == phrase[head]) & (x["at"] >= head) & there, number))
        return F.array_compact(F.array(*found))

    hits = F.transform(known, lambda x: F.struct(x["at"].cast("bigint").alias("at"), x["word"].alias("word"), standing(x).alias("phrases")))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "_id", F.size("_words").cast("bigint").alias("n_words"), hits.alias("hits"))


def _tables(spark, notices: Sequence[Notice], base: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """The index ``notice, word, place`` and the demanded phrases ``notice, phrase, place``: a few hundred rows."""
    number = {p: i for i, p in enumerate(_phrases(notices, base))}
    index = spark.createDataFrame(_postings(notices), "notice int, word string, place bigint")
    demanded = [(i, number[tuple(k.split())], _place_in(n, k)) for i, n in enumerate(notices) for k in n.keys]
    return F.broadcast(index), F.broadcast(spark.createDataFrame(demanded, "notice int, phrase int, place bigint"))


def found_notices(rows: DataFrame, notices: Sequence[Notice] = NOTICES, base: Mapping[str, str] = PHRASES, top: int = TOP, in_place: float = IN_PLACE) -> DataFrame:
    """``_row, notice, begin, weight, whole``: notices that stand in the documents of ``licence_words``, where they begin, and the IDF of
    the words in place and of all that were looked up, in millionths."""
    index, demanded = _tables(rows.sparkSession, notices, base)
    hits = rows.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    documents = rows.count()
    per_word = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # one row per licence word of the corpus, not more than the vocabulary
    idf = per_word.select("word", F.round(F.log((documents + 1) / F.col("df")) * 1_000_000).cast("bigint").alias("idf"))
    postings = index.join(F.broadcast(idf), "word")
    looked = hits.select("_row", "at", "word").join(F.broadcast(postings), "word")
    words = looked.groupBy("_row", "notice", "word").agg(F.max("idf").alias("idf"))
    best = words.withColumn("nth", F.row_number().over(W.partitionBy("_row", "notice").orderBy(F.desc("idf"), "word"))).filter(F.col("nth") <= top)
    whole = best.groupBy("_row", "notice").agg(F.sum("idf").alias("whole"), F.count(F.lit(1)).alias("sought"))
    begins = (
        looked.join(best.select("_row", "notice", "word"), ["_row", "notice", "word"])
        .groupBy("_row", "notice", (F.col("at") - F.col("place")).alias("begin"), "word")
        .agg(F.max("idf").alias("idf"))
        .groupBy("_row", "notice", "begin")
        .agg(F.sum("idf").alias("weight"), F.count(F.lit(1)).alias("words"))
    )
    enough = begins.join(whole, ["_row", "notice"]).filter(F.col("words") >= F.ceil(F.col("sought") * in_place))
    standing = hits.select("_row", "at", F.explode("phrases").alias("phrase"))
    lead = F.element_at(F.array(*[F.lit(_head(p)) for p in _phrases(notices, base)]), F.col("phrase") + 1)
    keys = standing.join(demanded, "phrase").select("_row", "notice", (F.col("at") - lead - F.col("place")).alias("begin"), "phrase")
    verified = keys.groupBy("_row", "notice", "begin").agg(F.count_distinct("phrase").alias("keys"))
    needed = demanded.groupBy("notice").agg(F.count(F.lit(1)).alias("keys"))
    return enough.join(verified.join(F.broadcast(needed), ["notice", "keys"]), ["_row", "notice", "begin"]).select("_row", "notice", "begin", "weight", "whole")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[Notice] = NOTICES, base: Mapping[str, str] = PHRASES, top: int = TOP, in_place: float = IN_PLACE
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, places (array of first word and label of every base phrase), base_labels, labels
    (arrays, sorted) and notices (array of first word, label and score of every notice found). A notice's score is the share of
    the looked-up words, weighed by IDF, that stand in place."""
    tables = Tables(docs.sparkSession, "licences")
    rows = tables.keep(licence_words(docs, text_col, id_col, notices, base))
    labels = F.array(*[F.lit(n.label) for n in notices])
    score = F.round(F.col("weight") / F.greatest(F.col("whole"), F.lit(1)), 6)
    notice = F.struct(F.col("begin"), F.element_at(labels, F.col("notice") + 1).alias("label"), score.alias("score"))
    found = found_notices(rows, notices, base, top, in_place).groupBy("_row").agg(F.array_sort(F.collect_set(notice)).alias("notices"))
    base_labels = F.array(*[F.lit(v) for v in base.values()])
    heads = F.array(*[F.lit(_head(tuple(p.split()))) for p in base])
    places = F.flatten(
        F.transform(
            "hits",
            lambda h: F.transform(
                F.filter(h["phrases"], lambda p: p < len(base)),
                lambda p: F.struct((h["at"] - F.element_at(heads, p + 1)).alias("at"), F.element_at(base_labels, p + 1).alias("label")),
            ),
        )
    )
    out = rows.withColumn("places", F.array_sort(places)).join(found, "_row", "left")
    told = F.coalesce("notices.label", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        "places",
        F.array_sort(F.array_distinct("places.label")).alias("base_labels"),
        F.array_sort(F.array_union("places.label", told)).alias("labels"),
        F.coalesce("notices", F.array().cast("array<struct<begin:bigint,label:string,score:double>>")).alias("notices"),
    )
