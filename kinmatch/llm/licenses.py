"""Licence scan with a positional rare-token index.

Templates are short, well-known runs of licence words, and each has a mandatory phrase. The index posts the words of
every phrase with their relative positions. A file is looked up under its highest-IDF licence words: as a phrase can only
hold if all of its words are there, these are the phrase's rarest words by corpus IDF. Each gives the places where the
template would begin; the postings of the words are intersected, so a place is proposed only where they agree. There the
phrase is verified word for word, and the place is scored by the share of the template's IDF weight in position.

DataFrame operations only, and none of them moves a text. Templates are data of the plan: one expression serves all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import ascii_lower

#: What stands between words: all of ASCII but digits and letters. Words are the same before and after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Share of a template's weight that must be in place.
THRESHOLD = 0.6
#: Words of a phrase whose postings are intersected.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> tuple[int, list[str]]:
        """Where in the template the mandatory phrase begins, and its words."""
        words, phrase = self.words, self.mandatory.split()
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), phrase


#: The base phrases, and key passages of common licences.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
)
#: Words too common to index.
STOP = frozenset("a an and any are for in into is it of or the this to under use with without".split())


def words_of(text: Column) -> Column:
    """All words of a text in order, by splitting between them, which takes less time than extracting each."""
    return F.array_remove(F.split(text, BETWEEN), "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words} - STOP)


def word_regex(words: list[str]) -> str:
    """A Java regular expression for any of the words as a whole word, letters A-Z in either case; alternatives share beginnings."""

    def branch(rest: list[str]) -> str:
        out = []
        for c in sorted({w[0] for w in rest if w}):
            out.append(c + branch([w[1:] for w in rest if w[:1] == c]))
        inner = "|".join(out)
        return f"(?:{inner})?" if "" in rest and inner else f"(?:{inner})" if len(out) > 1 else inner

    edge = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    return f"(?i)(?<![{edge}]){branch(words)}(?![{edge}])"


def inverse_frequencies(rows: DataFrame, vocab: list[str]) -> dict[str, float]:
    """IDF of the words over all rows (column _text), from one pass; the driver gets one row a word at most."""
    marked = F.col("_text").rlike(word_regex(vocab))
    found = F.array_distinct(F.filter(words_of(ascii_lower(F.col("_text"))), lambda w: w.isin(vocab)))
    # The empty word counts the rows.
    words = F.concat(F.when(marked, found).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    df = {r[0]: r[1] for r in rows.select(F.explode(words).alias("word")).groupBy("word").count().collect()}
    # Rounded, so that a last bit of a logarithm never decides between words.
    return {w: round(math.log((df.get("", 0) + 1) / (df.get(w, 0) + 0.5)), 6) for w in vocab}


def index_of(templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """The templates as one constant: number, rarest words of the phrase, whole phrase, and weighted words, each with its position."""

    def entry(t: int, template: Template) -> Column:
        first, phrase = template.phrase
        place = lambda i, w: F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"))
        rare = sorted(((first + i, w) for i, w in enumerate(phrase) if w in idf), key=lambda x: (-idf[x[1]], x[0]))[:ANCHORS]
        known = [(i, w) for i, w in enumerate(template.words) if w in idf]
        total = sum(idf[w] for _, w in known) or 1.0
        return F.struct(
            F.lit(t).alias("t"),
            F.array(*(place(i, w) for i, w in rare)).alias("rare"),
            F.array(*(place(first + i, w) for i, w in enumerate(phrase))).alias("phrase"),
            F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(idf[w] / total).alias("weight")) for i, w in known)).alias("words"),
        )

    return F.array(*(entry(t, x) for t, x in enumerate(templates)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Only letters A-Z are lower-cased. n_base counts all places of the base phrases; first_word and last_word are their
    smallest and largest first words, null without any; score is the best share of a template found in place, 0 without
    one. A null or empty text has no words. Repeated rows each give a row; null ids pass through; an empty table gives
    no rows; other columns are not read. A row's arrays are bounded by its own text.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    idf = inverse_frequencies(rows, vocabulary(templates))
    ranked = lambda phrase: sorted((w for w in phrase if w in idf), key=lambda w: -idf[w])[:ANCHORS]
    anchors = sorted({w for x in templates for w in ranked(x.phrase[1])})

    text = F.col("_text")
    words = F.when(text.rlike(word_regex(anchors)), words_of(ascii_lower(text))).otherwise(F.array().cast("array<string>"))
    out = rows.select(id_col, F.size(words_of(text)).cast("long").alias("n_words"), words.alias("_words"))
    # Where the file's licence words stand.
    spots = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(anchors))
    out = out.withColumn("_spots", spots)

    def starts(place: Column) -> Column:
        """Where a template begins if its word at this place is one of the file's."""
        return F.transform(F.filter("_spots", lambda x: x["w"] == place["w"]), lambda x: x["at"] - place["i"])

    def stands(at: Column) -> Callable[[Column], Column]:
        return lambda p: F.coalesce(F.get("_words", at + p["i"]) == p["w"], F.lit(False))  # get() gives null outside of the array

    def proposed(x: Column) -> Column:
        rest = F.slice(x["rare"], 2, ANCHORS)
        agreed = F.aggregate(rest, F.array_distinct(starts(F.get(x["rare"], F.lit(0)))), lambda found, place: F.array_intersect(found, starts(place)))
        held = F.filter(agreed, lambda at: F.forall(x["phrase"], stands(at)))
        share = lambda at: F.aggregate(x["words"], F.lit(0.0), lambda sum_, p: sum_ + F.when(stands(at)(p), p["weight"]).otherwise(0.0))
        return F.transform(held, lambda at: F.struct(x["t"].alias("t"), at.alias("at"), F.least(F.round(share(at), 6), F.lit(1.0)).alias("share")))

    judged = F.filter(F.flatten(F.transform(index_of(templates, idf), proposed)), lambda x: x["share"] >= threshold)
    nothing = F.array().cast("array<struct<t:int,at:int,share:double>>")
    out = out.withColumn("_judged", F.when(F.size("_spots") > 0, judged).otherwise(nothing))
    base = [t for t, x in enumerate(templates) if x.base]
    label = F.array(*(F.lit(t.label) for t in templates))
    out = out.withColumn("_base", F.filter("_judged", lambda x: x["t"].isin(base)))

    def joined(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: F.get(label, x["t"])))), ",")

    first = F.transform("_base", lambda x: x["at"])
    return out.select(
        id_col, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"),
        joined("_base").alias("base_labels"), joined("_judged").alias("labels"), F.coalesce(F.array_max(F.transform("_judged", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
