"""License scans by a positional index of rare words.

The index holds, for every word of the licence templates, the templates and places where it stands.
How rare a word is comes from all documents (inverse document frequency; only the template
vocabulary is counted, so the driver holds one number per template word). Of each file its rarest licence
words are looked up; a posting at place q of a template and a word at place i of the file propose that the
template begins at word i - q. Proposals are intersected by that relative place: each is scored by the weight of
all template words that stand where they should. A template counts if enough weight agrees and one of
its key phrases is there word for word. Base phrases are looked up by their rarest word, which is never left out.

Everything happens inside the row with array functions; the one shuffle counts words.

Words are runs of digits, letters and non-ASCII characters after lower-casing. Spark's ``lower`` also lowers
other letters; the only such letter that becomes ASCII is the Kelvin sign (k), so no template word has a k.

Defined cases: null and empty texts have no words, no places, null ``first_word`` and ``last_word``,
empty labels and score 0; repeated rows get equal results; an empty table gives an empty result; an
input column named like a result is replaced.
"""

import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

# Base phrases and short licence notices with their key phrases.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple


TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("gpl", "this is licensed under the gnu general public license version 3", ("general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


class Settings(NamedTuple):
    # Rarest licence words looked up per file, beside the anchors of phrases.
    looked_up: int = 12
    # Share of a template's weight that must agree.
    agree: float = 0.6
    # Score of a base phrase outside every template.
    phrase_score: float = 0.5


def words_of(text):
    """Words of a text; null as none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def rarity(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents."""
    known = F.array(*[F.lit(word) for word in vocabulary])
    # The empty word stands for the documents themselves.
    present = F.explode(F.array_append(F.array_intersect(known, F.col("words")), F.lit("")))
    counts = {row["word"]: row["count"] for row in rows.select(present.alias("word")).groupBy("word").count().collect()}
    total = counts.get("", 0)
    return {word: math.log((total + 1) / (counts.get(word, 0) + 1)) + 1e-6 for word in vocabulary}


def strings(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def consecutive(words, start, phrase: list[str]):
    """Whether ``phrase`` stands at ``start``."""
    same = F.lit(True)
    for i, word in enumerate(phrase):
        same = same & F.get(words, start + i).eqNullSafe(F.lit(word))
    return same


def license_scan(docs: DataFrame, text="text", base=BASE_PHRASES, templates=TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """All input columns with the columns of ``RESULTS``."""
    bodies = [template.text.split() for template in templates]
    vocabulary = sorted({w for body in bodies for w in body} | {w for phrase, _ in base for w in phrase.split()})
    assert not any("k" in word for word in vocabulary), "see above"
    rows = packed(docs).withColumn("words", words_of(F.col("doc").getField(text)))
    idf = rarity(rows, vocabulary)
    ranked = sorted(vocabulary, key=lambda w: (-idf[w], w))
    rarest = lambda phrase: min(phrase, key=ranked.index)

    # The index: word -> (template, place) and, per template, its words, weights and key phrases.
    postings = defaultdict(list)
    entries = []
    for t, (template, body) in enumerate(zip(templates, bodies, strict=True)):
        for q, word in enumerate(body):
            postings[word].append((t, q))
        total = sum(idf[w] for w in body)
        spans = [(q, q + len(p)) for p in map(str.split, template.phrases) for q in range(len(body)) if body[q : q + len(p)] == p]
        entries.append(
            F.struct(
                F.lit(template.label).alias("label"),
                F.array(*[F.struct(F.lit(w).alias("word"), F.lit(idf[w] / total).alias("weight")) for w in body]).alias("body"),
                F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in spans]).alias("spans"),
            )
        )
    index = F.array(*entries)
    pairs = lambda found: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in found])
    places = F.create_map(*[x for word, found in sorted(postings.items()) for x in (F.lit(word), pairs(found))])

    phrases = [(phrase.split(), label) for phrase, label in base]
    anchors = sorted({rarest(p) for p, _ in phrases} | {rarest(p.split()) for t in templates for p in t.phrases})
    words = F.col("words")
    own_anchors = F.array_intersect(strings(anchors), words)
    looked = F.array_union(F.slice(F.array_intersect(strings(ranked), words), 1, settings.looked_up), own_anchors)
    rows = rows.withColumn("looked", F.when(F.size(own_anchors) > 0, looked))
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i")))
    rows = rows.withColumn("hits", F.when(F.col("looked").isNotNull(), F.filter(numbered, lambda x: F.array_contains("looked", x["word"]))))

    def phrase_places(phrase, label):
        anchor = rarest(phrase)
        held = F.filter("hits", lambda x: x["word"] == anchor)
        at = [q for q, word in enumerate(phrase) if word == anchor]
        starts = F.flatten(F.transform(held, lambda x: F.array(*[x["i"] - q for q in at])))
        here = F.filter(F.array_distinct(starts), lambda s: consecutive(words, s, phrase))
        return F.transform(here, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))

    found = [phrase_places(phrase, label) for phrase, label in phrases]
    rows = rows.withColumn("base", F.array_sort(F.flatten(F.array(*found))))

    proposed = F.array_distinct(
        F.flatten(
            F.transform(
                "hits",
                lambda x: F.transform(
                    F.coalesce(F.element_at(places, x["word"]), F.array().cast("array<struct<t:int,q:int>>")),
                    lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["q"]).alias("start")),
                ),
            )
        )
    )

    def scored(p):
        entry = F.get(index, p["t"])
        stands = lambda q: F.get(words, p["start"] + q).eqNullSafe(F.get(entry["body"], q)["word"])
        agreeing = F.transform(entry["body"], lambda b, q: F.when(F.get(words, p["start"] + q).eqNullSafe(b["word"]), b["weight"]).otherwise(0.0))
        verified = F.exists(entry["spans"], lambda s: F.forall(F.sequence(s["from"], s["to"] - 1), stands))
        weight = F.aggregate(agreeing, F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.least(weight, F.lit(1.0)).alias("score"), entry["label"].alias("label"), verified.alias("verified"))

    aligned = F.filter(F.transform(proposed, scored), lambda s: s["verified"] & (s["score"] >= settings.agree))
    rows = rows.withColumn("aligned", aligned)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_labels = F.coalesce(F.transform("base", lambda x: x["label"]), strings([]))
    more = F.coalesce(F.transform("aligned", lambda x: x["label"]), strings([]))
    best = F.coalesce(F.array_max(F.transform("aligned", lambda x: x["score"])), F.lit(0.0))
    n_base = F.coalesce(F.size("base"), F.lit(0))
    n_base = F.when(F.col("base").isNull(), F.lit(0)).otherwise(n_base)
    starts = F.transform("base", lambda x: x["start"])
    rows = rows.select(
        "doc",
        F.size("words").cast("bigint").alias("n_words"),
        n_base.cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.array_union(base_labels, more)).alias("labels"),
        F.greatest(best, F.when(n_base > 0, F.lit(settings.phrase_score)).otherwise(0.0)).alias("score"),
    )
    return unpacked(rows, RESULTS)
