"""License scans over a positional rare-token index, in DataFrame and SQL operations only.

Templates are short license texts. Every template word has a document frequency over the whole
corpus; the rarest words of each template form a positional index (word -> template, place).
A file looks up the index words it holds; each hit says where the template would start, and
the starts on which most of a template's rare words agree are candidates. A candidate counts
when the template's mandatory phrases stand at their places. Nothing is exploded but the hits
of one file, and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 4  # indexed words of each template
AGREE = 0.6  # share of them that must agree on one start

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A license wording with its label and the phrases that must stand in it word for word."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Wordings of public licenses, lower case, words only.
TEMPLATES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-4", "this work is licensed under cc by 4 0", ("licensed under cc by", "4 0")),
    Template("cc-by-sa", "this work is licensed under cc by sa", ("licensed under cc by sa",)),
    Template("cc-by-full", "licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "released under the creative commons zero public domain dedication", ("creative commons zero", "public domain")),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: ASCII letters lower-cased, runs of ASCII digits, letters and anything beyond ASCII; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _phrase_at(w: Column, i: Column, phrase: str) -> Column:
    found = F.lit(True)
    for k, word in enumerate(phrase.split()):
        found = found & F.coalesce(F.get(w, (i + k).cast("int")) == word, F.lit(False))
    return found


def frequencies(split: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each vocabulary word, over all rows; one number for each word reaches the driver."""
    own = F.array_distinct(F.filter(F.col("w"), lambda x: x.isin(*vocabulary)))
    return {r["word"]: r["count"] for r in split.select(F.explode(own).alias("word")).groupBy("word").count().collect()}


def index(df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Word to its (template, place) postings: the ``RARE`` rarest words of each template, all their places."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        own = t.text.split()
        for word in sorted(set(own), key=lambda x: (df.get(x, 0), x))[:RARE]:
            for place, x in enumerate(own):
                if x == word:
                    found.setdefault(word, []).append((k, place))
    return found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, places (sorted starts of base phrases), base_labels and labels (sorted arrays), score.

    ``score`` is the largest share of a verified template's words that stand at their places; files
    with a base phrase only have 0.5, others 0. Null or empty text has no words. Every row comes
    back once; other columns are not read.
    """
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    vocabulary = sorted({x for t in templates for x in t.text.split()})
    postings = index(frequencies(split, vocabulary), templates)
    heads = sorted({p.split()[0] for p in BASE})
    anchors = sorted(set(postings) | set(heads))

    i = F.col("hit.i")
    hits = F.filter(F.transform(F.col("w"), lambda x, k: F.struct(x.alias("x"), k.alias("i"))), lambda s: s["x"].isin(*anchors))
    rows = split.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))

    def base(h: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            label = F.when((h["x"] == phrase.split()[0]) & _phrase_at(F.col("w"), h["i"], phrase), F.lit(name)).otherwise(label)
        return F.struct(h["i"].cast("long").alias("i"), label.alias("label"))

    del i
    bases = F.filter(F.transform("hits", base), lambda b: b["label"].isNotNull())
    # Every hit of an index word names the templates and where each would start.
    none = F.array().cast("array<struct<t:int,s:int,p:int>>")

    def starts(h: Column) -> Column:
        found = none
        for word, places in postings.items():
            found = F.when(
                h["x"] == word, F.array(*[F.struct(F.lit(t).alias("t"), (h["i"] - p).cast("int").alias("s"), F.lit(p).alias("p")) for t, p in places])
            ).otherwise(found)
        return found

    rows = rows.select("doc_id", "w", "n_words", bases.alias("bases"), F.flatten(F.transform("hits", starts)).alias("starts"))
    needs = F.array(*[F.lit(max(1, -(-int(100 * AGREE * sum(1 for ps in postings.values() for t, _ in ps if t == k)) // 100))) for k in range(len(templates))])
    pairs = F.array_distinct(F.transform("starts", lambda h: F.struct(h["t"].alias("t"), h["s"].alias("s"))))
    votes = lambda c: F.size(F.filter(F.col("starts"), lambda h: (h["t"] == c["t"]) & (h["s"] == c["s"])))
    agreed = F.filter(pairs, lambda c: votes(c) >= F.get(needs, c["t"]))

    def verified(c: Column) -> Column:
        """Share of the template's words at their places; null unless its phrases stand."""
        share = F.lit(None).cast("double")
        for k, t in enumerate(templates):
            own = t.text.split()
            held = F.lit(True)
            for phrase in t.phrases:
                p = phrase.split()
                at = next(a for a in range(len(own)) if own[a : a + len(p)] == p)
                held = held & _phrase_at(F.col("w"), c["s"] + at, phrase)
            same = sum((F.coalesce((F.get(F.col("w"), c["s"] + a) == x).cast("int"), F.lit(0)) for a, x in enumerate(own)), F.lit(0))
            share = F.when((c["t"] == k) & held, same / len(own)).otherwise(share)
        names = F.array(*[F.lit(t.label) for t in templates])
        return F.struct(F.get(names, c["t"]).alias("label"), share.alias("share"))

    # A start before the text holds none of the words before its first one.
    rows = rows.select("doc_id", "n_words", "bases", F.filter(F.transform(agreed, lambda c: verified(c)), lambda v: v["share"].isNotNull()).alias("found"))
    base_labels = F.array_sort(F.array_distinct(F.col("bases.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("bases.label"), F.col("found.label"))))
    score = F.coalesce(F.array_max(F.col("found.share")), F.when(F.size("bases") > 0, F.lit(0.5)), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.array_sort(F.col("bases.i")).alias("places"), base_labels.alias("base_labels"), labels.alias("labels"), score.alias("score"))


def digest(found: DataFrame) -> DataFrame:
    """Columns of the query from :func:`scan`."""
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
