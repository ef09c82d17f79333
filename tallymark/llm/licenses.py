"""License scans by a positional index of rare words.

Every template of a licence notice is indexed under its rarest words, with their positions. A file looks up
its licence words; words that stand at the same distance as in the template vote for one place where the
template would begin, and the place counts when the template's key phrases stand there word for word. How rare
a word is comes from all files. Everything is DataFrame expressions: texts are split once, and only the
few positions of licence words are joined and grouped afterwards.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import durable

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice in lower-case words; the key phrases are mandatory parts of it."""

    label: str
    text: str
    key_phrases: tuple[str, ...]


# Standard notices of public licences.
TEMPLATES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-notice", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "associated documentation files")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "source code form")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
)

# Words too common to be licence words; no phrase begins with one of them alone.
_STOP_WORDS = "a and any are as by for form forms in is it of or the this to under use v with without 0 2 3 4".split()

INDEX_WORDS = 3


def _licence_words(templates: tuple[Template, ...]) -> list[str]:
    words = " ".join([*BASE_PHRASES, *(t.text for t in templates)]).split()
    return [w for w in dict.fromkeys(words) if w not in _STOP_WORDS]


def _anchor(phrase: str) -> tuple[int, str]:
    """The first licence word of a phrase and its position in it."""
    return next((n, w) for n, w in enumerate(phrase.split()) if w not in _STOP_WORDS)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. ``lower`` does more than that, but only where no word of ASCII arises."""
    upper, lowered = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    makes_ascii = text.contains("K") | text.contains("İ")
    return F.array_remove(F.split(F.when(makes_ascii, F.translate(text, upper, lowered)).otherwise(F.lower(text)), _DELIMITERS), "")


def scan_positions(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, hits<position, word>, places<phrase, position>`` per input row, by one pass over the texts.

    ``hits`` are the licence words, ``places`` where base or key phrases stand whole. Most texts have neither
    and are settled by one set test. Null text is empty.
    """
    vocabulary = _licence_words(templates)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(text).alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("position"), w.alias("word")))
    hits = F.when(
        F.arrays_overlap("words", F.array(*map(F.lit, vocabulary))), F.filter(numbered, lambda h: h["word"].isin(vocabulary))
    ).otherwise(F.expr("array_remove(array(named_struct('position', 0, 'word', '')), named_struct('position', 0, 'word', ''))"))
    found = words.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", hits.alias("hits"))
    places = F.flatten(F.array(*[_places(n, phrase) for n, phrase in enumerate(_phrases(templates))]))
    return found.select("doc_id", "n_words", "hits", F.when(F.size("hits") > 0, places).alias("places"))


def _phrases(templates: tuple[Template, ...]) -> list[str]:
    return list(dict.fromkeys([*BASE_PHRASES, *(p for t in templates for p in t.key_phrases)]))


def _places(number: int, phrase: str) -> Column:
    parts = phrase.split()
    offset, anchor = _anchor(phrase)
    here = F.filter("hits", lambda h: (h["word"] == anchor) & (h["position"] >= offset))
    begin = F.transform(here, lambda h: F.struct(F.lit(number).alias("phrase"), (h["position"] - offset).alias("position")))
    return F.filter(begin, lambda p: F.slice(F.col("words"), p["position"] + 1, len(parts)) == F.array(*map(F.lit, parts)))


def scan_licenses(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per input row.

    ``score`` is the largest share of a verified template's rarity that its words in place make up, 0 without
    one. A row's scan does not depend on its doc_id: repeated or null ids are scanned row by row. Empty and
    null texts have no word, no label ('') and null places.
    """
    scanned = durable(scan_positions(df, templates, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    spark = df.sparkSession
    hits = scanned.where(F.size("hits") > 0).select("row", F.inline("hits"))
    n_docs = scanned.count()
    # One row per licence word, however many files there are.
    spread = {r["word"]: r["n"] for r in hits.groupBy("word", "row").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rarity = {w: math.log((n_docs + 1) / (spread.get(w, 0) + 1)) + 1 for w in _licence_words(templates)}

    index, keys, needs = [], [], []
    phrases = {phrase: n for n, phrase in enumerate(_phrases(templates))}
    for number, template in enumerate(templates):
        words = template.text.split()
        rare = sorted({w for w in words if w in rarity}, key=lambda w: (-rarity[w], w))[:INDEX_WORDS]
        index += [(w, number, q, rarity[w]) for q, w in enumerate(words) if w in rare]
        whole = sum(rarity[w] for w in words if w in rare)
        starts = [(phrases[p], len(template.text[:re.search(rf"\b{p}\b", template.text).start()].split())) for p in template.key_phrases]
        keys += [(phrase, number, start) for phrase, start in starts]
        needs.append((number, template.label, whole, len(starts)))
    # All three tables are as large as the templates, which are part of the code.
    index_table = F.broadcast(spark.createDataFrame(index, "word string, template int, at int, rarity double"))
    key_table = F.broadcast(spark.createDataFrame(keys, "phrase int, template int, at int"))
    need_table = F.broadcast(spark.createDataFrame(needs, "template int, label string, whole double, n_keys int"))

    places = scanned.where(F.size("places") > 0).select("row", F.inline("places"))
    votes = hits.join(index_table, "word").select("row", "template", (F.col("position") - F.col("at")).alias("start"), "rarity", F.lit(0).alias("key"))
    held = places.join(key_table, "phrase").select("row", "template", (F.col("position") - F.col("at")).alias("start"), F.lit(0.0).alias("rarity"), F.lit(1).alias("key"))
    aligned = votes.unionByName(held).groupBy("row", "template", "start").agg(F.sum("rarity").alias("rarity"), F.sum("key").alias("n_held"))
    verified = aligned.join(need_table, "template").where((F.col("n_held") == F.col("n_keys")) & (F.col("rarity") > 0))
    own = verified.groupBy("row").agg(F.collect_set("label").alias("own_labels"), F.max(F.round(F.col("rarity") / F.col("whole"), 9)).alias("score"))

    label_of = F.element_at(F.create_map(*[F.lit(x) for n, label in enumerate(BASE_PHRASES.values()) for x in (n, label)]), F.col("phrase"))
    base = places.where(F.col("phrase") < len(BASE_PHRASES)).groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("position").cast("long").alias("first_word"), F.max("position").cast("long").alias("last_word"),
        F.collect_set(label_of).alias("base"))
    nothing = F.array().cast("array<string>")
    joined = scanned.select("row", "doc_id", "n_words").join(base, "row", "left").join(own, "row", "left")
    base_set, own_set = F.coalesce("base", nothing), F.coalesce("own_labels", nothing)
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, own_set)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
